"""Phrase collocation mining over integer n-grams.

Words that are frequent in their language get integer ids; text is broken at all other words, as no frequent phrase can
hold one. n-grams of ids are packed into binary keys of one width, radix-sorted and counted as runs in each task, dealt by
ranges of keys, sorted again and counted as runs to the end. Each length is counted among the frequent phrases that are
one word shorter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP, P, attach, key_filter, partitions, rebatch, stage, tidy
from .tokens import byte_classes, words

#: Words are parted by space and tab, pieces of text by marks and line ends.
PIECES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Bytes of the dictionary that every worker gets: the most frequent words, as far as they fit. Others are joined.
HEAD_BYTES = 32_000_000
#: Words, and n-grams, that a task holds before it hands on their counts.
HELD, GRAMS = 400_000, 3_000_000
#: Rows of candidates that one task ranks at first.
RANKED = 200_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words for each language, summed as far as a task can hold them."""
    found: list[pa.Table] = []
    held = 0

    def summed() -> pa.Table:
        return pa.concat_tables(found).group_by(["lang", "word"]).aggregate([("n", "sum")]).select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"])

    for batch in batches:
        for lang, texts, _ in by_language(batch):
            w = words(texts, PIECES)
            n = np.bincount(w.codes, minlength=len(w.distinct)).astype(np.int64)
            found.append(pa.table({"lang": pa.repeat(lang, len(n)), "word": w.distinct, "n": n}))
            held += len(n)
            if held > HELD:
                found = [summed()]
                held = found[0].num_rows
                if held > HELD // 2:
                    yield from found[0].to_batches(max_chunksize=50_000)
                    found, held = [], 0
    if found:
        yield from summed().to_batches(max_chunksize=50_000)


def by_language(whole: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, pa.RecordBatch]]:
    """(language, texts, rows) of some megabytes each."""
    for batch in rebatch([whole], "text", 4_000_000):
        for lang in batch["lang"].unique().to_pylist():
            rows = batch.filter(pc.equal(batch["lang"], lang))
            yield lang, rows["text"], rows


class Dictionary:
    """Ids of the most frequent words: a table (lang, word, id) in order of language."""

    def __init__(self, head: pa.Table) -> None:
        self.words: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang in head["lang"].unique().to_pylist():
            some = head.filter(pc.equal(head["lang"], lang)).combine_chunks()
            self.words[lang] = some["word"].combine_chunks(), some["id"].to_numpy()

    def ids(self, lang: str, distinct: pa.Array) -> np.ndarray:
        """The id of each word, 0 for one that the dictionary lacks."""
        if lang not in self.words:
            return np.zeros(len(distinct), np.uint32)
        known, ids = self.words[lang]
        return np.append(ids, 0).astype(np.uint32)[pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy()]


def sequence(ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with a 0 wherever a new piece begins, and the place of each id in it."""
    new = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(ids) else np.zeros(0, np.int64)
    at = np.arange(len(ids)) + np.cumsum(np.bincount(new, minlength=len(ids)))
    out = np.zeros(len(ids) + len(new), np.uint32)
    out[at] = ids
    return out, at


def _sequences(head: Callable[[], pa.Table]):
    """Id sequences of the texts of a batch, where the head holds all frequent words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = Dictionary(head())
        for batch in batches:
            for lang, texts, _ in by_language(batch):
                w = words(texts, PIECES)
                yield sequence(known.ids(lang, w.distinct)[w.codes], w.piece)[0]

    return read


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Id sequences of encoded rows, with the ids of the rarer words put in."""
    for batch in batches:
        for ids, late in zip(batch["ids"].to_pylist(), batch["late"].to_pylist(), strict=True):
            found = np.frombuffer(ids, np.uint32).copy()
            for x in late or ():
                found[x["position"]] = x["id"]
            yield found


def _encode(head: Callable[[], pa.Table]):
    """Each text as ids, and each of its words that the head lacks with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(head())
        for batch in batches:
            for lang, texts, rows in by_language(batch):
                w = words(texts, PIECES)
                seq, at = sequence(known.ids(lang, w.distinct)[w.codes], w.piece)
                starts = np.append(np.searchsorted(w.row, np.arange(len(rows))), len(w.row))
                bounds = [int(at[s]) - 1 if s < len(at) else len(seq) for s in starts]  # a piece, so a text, begins with a 0
                names = rows["row"].to_numpy()
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([rows["row"], pa.repeat(lang, len(rows)), pa.array([seq[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()), none(len(rows), pa.int32()), none(len(rows), pa.binary())], ["row", "lang", "ids", "position", "word"])
                lost = np.flatnonzero(seq[at] == 0)
                for cut in range(0, len(lost), 50_000):
                    some = lost[cut : cut + 50_000]
                    place = at[some] - np.array(bounds)[w.row[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(names[w.row[some]]), pa.repeat(lang, len(some)), none(len(some), pa.binary()), pa.array(place.astype(np.int32)), w.distinct.take(pa.array(w.codes[some]))], ["row", "lang", "ids", "position", "word"])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of 32-bit numbers, by stable passes over their 16-bit digits from the last to the first."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, column] >> shift).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of sorted keys and the sums of their n."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(n, first)


def hashed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of ids."""
    h = np.zeros(len(keys), np.uint64)
    for column in keys.astype(np.uint64).T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _packed(keys: np.ndarray, width: int) -> pa.Array:
    """Rows of ids as binary keys of `width` numbers, most significant byte first, so that keys sort as ids do."""
    wide = np.zeros((len(keys), width), ">u4")
    wide[:, : keys.shape[1]] = keys
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 4 * width).astype(np.int32)), pa.py_buffer(wide.tobytes())])


def _unpacked(keys: pa.Array, width: int) -> np.ndarray:
    start = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset] if len(keys) else 0
    return np.frombuffer(keys.buffers()[2], ">u4", len(keys) * width, start).reshape(-1, width).astype(np.uint32) if len(keys) else np.zeros((0, width), np.uint32)


def _grams(read: Callable, length: int, width: int, shorter: Callable[[], tuple[np.ndarray, int]] | None):
    """Runs of the n-grams of a task: (key, n). Those that hold an infrequent phrase one word shorter are left out where
    the filter of the frequent ones knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shorter() if shorter else (None, 0)

        def grams(seq: np.ndarray) -> np.ndarray:
            n = max(0, len(seq) - length + 1)
            keys = np.stack([seq[i : i + n] for i in range(length)], axis=1)
            keys = keys[(keys > 0).all(axis=1)]
            return keys if bits is None else keys[may_be_frequent(keys[:, :-1]) & may_be_frequent(keys[:, 1:])]

        def may_be_frequent(keys: np.ndarray) -> np.ndarray:
            at = hashed(keys) % size
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        def handed(some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(some)
            found, n = runs(keys[radix_order(keys)], np.ones(len(keys), np.int64))
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([_packed(found[at : at + 100_000], width), pa.array(n[at : at + 100_000])], ["key", "n"])

        held: list[np.ndarray] = []
        count = 0
        for seq in read(batches):
            held.append(grams(seq))
            count += len(held[-1])
            if count > GRAMS:
                yield from handed(held)
                held, count = [], 0
        if count:
            yield from handed(held)

    return run


def _run_lengths(length: int, width: int, least: int):
    """Runs of sorted keys whose sum is at least `least`; a run may go over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            many = n >= least
            keys = keys[many]
            return pa.RecordBatch.from_arrays([_packed(keys, width), pa.array(n[many]), pa.array(hashed(keys[:, :length]))], ["key", "f", "h"])

        keys, n = np.zeros((0, width), np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            keys, n = runs(np.concatenate([keys, _unpacked(batch["key"], width)]), np.concatenate([n, batch["n"].to_numpy()]))
            if len(keys) > 1:
                yield out(keys[:-1], n[:-1])
                keys, n = keys[-1:], n[-1:]
        yield out(keys, n)

    return run


def _dictionary(frequent: DataFrame, most_bytes: int) -> tuple[pa.Table, DataFrame, int]:
    """(head, frequent words with ids, number outside the head). The head is the most frequent words, cut between classes of
    counts (eight to a doubling), so that it takes at most most_bytes."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = frequent.groupBy(level.alias("level")).agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 16).alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, held, inside = math.inf, 0, 0
    for r in sizes:  # a few hundred classes at most
        if held + r.bytes > most_bytes:
            break
        least, held, inside = r.level, held + r.bytes, inside + r.n
    every = sum(r.n for r in sizes)
    if every >= 1 << 32:
        raise ValueError("more frequent words than 32-bit ids")
    spark = frequent.sparkSession
    at = F.monotonically_increasing_id()
    parts = stage(frequent.select("*", (level >= F.lit(least)).alias("head"), F.shiftrightunsigned(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "parts")
    first, before = [], 1
    for r in parts.groupBy("part").count().orderBy("part").collect():  # a row for each part
        first.append((r.part, before))
        before += r["count"]
    start = spark.createDataFrame(first, "part long, start long")
    known = stage(parts.join(F.broadcast(start), "part").select("lang", "word", "n", "head", (F.col("start") + F.col("at")).alias("id")), "dictionary")
    head = known.where("head").select("lang", "word", "id").toArrow()  # at most most_bytes
    return head, known, every - inside


def _lookup(rows: DataFrame, key: str, phrases: DataFrame, **names: str) -> DataFrame:
    """rows with columns of the phrases that `key` names, hot keys spread."""
    size = f"{P}rows"
    rows = stage(rows, "rows")
    sizes = rows.groupBy(key).agg(F.count("*").alias(size))
    groups = phrases.select(F.col("key").alias(key), *[F.col(c).alias(n) for n, c in names.items()]).join(sizes, key)
    return attach(rows, stage(groups, "asked"), key, size, rows.count(), F.col("key")).drop(size)


def _key(key: Column, first: int, n: int, width: int) -> Column:
    """The key of n words of a key, from word `first` on."""
    return F.rpad(F.substring(key, first * 4 + 1, n * 4), 4 * width, F.lit(b"\0"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    Texts, A-Z lower-cased, are split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into words. a is
    how often a phrase stands in pieces, n the language's words, and a phrase counts from `least` occurrences on. Each cut of
    it into two parts that occur l and r times scores floor(10**6 * a * a / (l * r)); the lowest score counts, of equal ones
    that after the fewest words. A phrase inside a longer one that occurs at least inside_percent % as often is left out.
    Ranks run by score, then a, then phrase in UTF-8 order.

    Null text counts as empty, null lang as `und`. Repeated rows count each, other columns play no part, an empty table
    gives an empty table. Counts are exact up to 10**14 - 1.

    Words beyond the most frequent ones that `head_bytes` holds get their ids by a join; each of them is rare against the
    corpus, so no key of it is hot.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts = stage(rows.mapInArrow(tidy(_count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent = counts.where(F.col("n") >= least)
    head, known, late = _dictionary(frequent, head_bytes)
    shared = spark.sparkContext.broadcast(head)
    source, read = rows, _sequences(lambda: shared.value)
    if late:
        named = rows.withColumn("row", F.monotonically_increasing_id())
        encoded = stage(named.mapInArrow(tidy(_encode(lambda: shared.value)), "row long, lang string, ids binary, position int, word binary"), "encoded")
        rare = encoded.where(F.col("word").isNotNull()).select("row", "lang", "position", "word").join(known.where("not head").select("lang", "word", "id"), ["lang", "word"])
        put = rare.groupBy("row").agg(F.collect_list(F.struct("position", "id")).alias("late"))
        source = stage(encoded.where(F.col("ids").isNotNull()).select("row", "ids").join(put, "row", "left").select("ids", "late"), "sequences")
        read = _encoded

    number = F.col("id")
    single = F.unhex(F.rpad(F.lpad(F.hex(number), 8, "0"), 8 * longest, "0"))
    phrases = [stage(known.select(single.alias("key"), F.col("n").alias("f"), "lang", F.col("word").cast("string").alias("phrase")), "phrases")]
    shorter = None
    for length in range(2, longest + 1):
        some = stage(source.mapInArrow(tidy(_grams(read, length, longest, shorter)), "key binary, n long"), "grams", compression="zstd")
        dealt = some.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
        found = stage(dealt.mapInArrow(tidy(_run_lengths(length, longest, least)), "key binary, f long, h long"), "frequent")
        if length < longest:
            shorter = _filter(found.select("h"))
        phrases.append(stage(_scored(found.drop("h"), phrases, length, longest), "phrases"))

    every = reduce(DataFrame.unionByName, phrases[1:])
    longer = [longer for i, longer in enumerate(phrases[1:], 2) for longer in _inside(longer, i, longest)]
    if longer:
        held = reduce(DataFrame.unionByName, longer).groupBy("key").agg(F.max("f").alias("longer"))
        every = every.join(held, "key", "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("f"), F.lit(True))).drop("longer")
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    every = stage(every, "kept")
    salts = max(1, -(-every.count() // RANKED))
    first = every.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _filter(hashes: DataFrame) -> Callable[[], tuple[np.ndarray, int]]:
    """The key filter of hashes as one bitmap for workers, at most 32 MB."""
    maps, size = key_filter(hashes)
    bits = np.zeros(size // 8, np.uint8)
    for r in maps.collect():  # at most MOST_BITS / 8 bytes
        at = (r[0] - 1) * BITMAP // 8
        bits[at : at + BITMAP // 8] = np.frombuffer(bytes(r[1]), np.uint8)[: len(bits) - at]
    shared = hashes.sparkSession.sparkContext.broadcast(bits)
    return lambda: (shared.value, size)


def _scored(found: DataFrame, phrases: list[DataFrame], length: int, width: int) -> DataFrame:
    """(key, f, lang, phrase, l, r, score) of candidates of one length, from the shorter phrases."""
    rows, cuts = found, []
    for k in range(1, length):
        rows = rows.withColumns({"left": _key(F.col("key"), 0, k, width), "right": _key(F.col("key"), k, length - k, width)})
        last = k == length - 1
        rows = _lookup(rows, "left", phrases[k - 1], **{f"l{k}": "f"}, **({"lang": "lang", "start": "phrase"} if last else {}))
        rows = _lookup(rows, "right", phrases[length - k - 1], **{f"r{k}": "f"}, **({"end": "phrase"} if last else {})).drop("left", "right")
        wide = lambda name: F.col(name).cast("decimal(14,0)")
        rows = rows.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (wide("f") * wide("f")), "below": wide(f"l{k}") * wide(f"r{k}")})
        rows = rows.withColumn(f"s{k}", F.expr("above div below")).drop("above", "below")
        cuts.append(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return rows.withColumn("best", best).select("key", "f", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def _inside(longer: DataFrame, length: int, width: int) -> Iterator[DataFrame]:
    """(key, f) of every shorter run of words in phrases of one length, from two words on."""
    for n in range(2, length):
        for first in range(length - n + 1):
            yield longer.select(_key(F.col("key"), first, n, width).alias("key"), "f")
