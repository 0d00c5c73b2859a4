"""BPE encoding over a minimal acyclic transducer of frequent words, and decoding.

The words that the corpus has most are compiled, with their ids as output, into an automaton that shares beginnings and
ends. It is a file of flat arrays that each worker maps into memory and walks for all distinct words of a batch at once,
a byte at a time. Words that it lacks are merged as the tokenizer's file says, so ids are exact with any lexicon.
"""

from __future__ import annotations

import io
import math
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, rebatch, stage, tidy, work_dir
from .words import Merges, laid_out, token_names

#: Words of a lexicon, at most, and bytes of the longest.
WORDS, LONGEST = 200_000, 48
#: Distinct words whose counts a task holds, and bytes of texts that are looked at together.
HELD, TOGETHER = 200_000, 2_000_000
#: Arrays of a lexicon's file, in this order.
PARTS = (("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("final", np.bool_), ("offsets", np.int32), ("ids", np.int32))


def minimal(words: list[bytes]) -> tuple[list[tuple[tuple[int, int], ...]], list[bool], int]:
    """(arcs, final, root) of the least automaton of sorted distinct words: arcs of a state are (byte, state) in order of
    bytes, and a state's arcs lead to states of lesser numbers. Equal states are found as soon as a word has left them."""
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[list] = [[[], False]]  # the states of the last word, not yet numbered: [arcs, final]

    def close(depth: int, word: bytes) -> None:
        """Number the states of the last word that are deeper than `depth`."""
        while len(path) - 1 > depth:
            state = path.pop()
            key = (tuple(state[0]), state[1])
            if (number := known.get(key)) is None:
                number = known[key] = len(arcs)
                arcs.append(key[0])
                final.append(key[1])
            path[-1][0].append((word[len(path) - 1], number))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        close(shared, last)
        path.extend([[], False] for _ in range(len(word) - shared))
        path[-1][1] = True
        last = word
    close(0, last)
    arcs.append(tuple(path[0][0]))
    final.append(path[0][1])
    return arcs, final, len(arcs) - 1


def compiled(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon. entries: distinct words with their ids.

    Each arc skips as many words as come before those that go on by it, so the skips of a word's path add up to its place
    in byte order, under which its ids are found.
    """
    entries = sorted(entries)
    arcs, final, _ = minimal([w for w, _ in entries])
    held = np.zeros(len(arcs), np.int64)  # words from each state on
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        n = int(final[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(n)
            n += int(held[target])
        held[state] = n
    values = [keys, targets, skips, final, np.cumsum([0, *(len(i) for _, i in entries)]), [x for _, i in entries for x in i]]
    file = io.BytesIO()
    arrays = [np.asarray(v, kind) for v, (_, kind) in zip(values, PARTS, strict=True)]
    file.write(np.array([len(a) for a in arrays], np.int64).tobytes())
    for a in arrays:
        file.write(a.tobytes() + bytes(-a.nbytes % 8))
    return file.getvalue()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        at = 8 * len(PARTS)
        for n, (name, kind) in zip(np.frombuffer(data[:at], np.int64).tolist(), PARTS, strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, data[at : at + size].view(kind))
            at += size + -size % 8
        self.root = len(self.final) - 1

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word (binary) among those of the lexicon, -1 for one that it lacks."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        on = np.arange(len(words))  # words still on a path, with their state and what was skipped
        state, skipped, depth = np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(on):
            over = ends[on] + depth == ends[on + 1]
            done = over & self.final[state]
            out[on[done]] = skipped[done]
            on, state, skipped = on[~over], state[~over], skipped[~over]
            key = state.astype(np.int64) << 8 | data[ends[on] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            arc = arc[found]
            on, state, skipped, depth = on[found], self.targets[arc], skipped[found] + self.skips[arc], depth + 1
        return out

    def lists(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the words at places, one after the other."""
        start, length = self.offsets[places].astype(np.int64), (self.offsets[places + 1] - self.offsets[places]).astype(np.int64)
        before = np.cumsum(length) - length
        return self.ids[np.arange(int(length.sum())) + np.repeat(start - before, length)], length


class Encoder:
    """Ids of texts by a lexicon, by merges where it lacks a word."""

    def __init__(self, tokenizer_file: str, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = Merges(tokenizer_file), lexicon

    def of_words(self, distinct: pa.Array) -> pa.ListArray:
        """Ids of distinct words."""
        places = self.lexicon.places(distinct)
        have, lack = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        ids, lengths = self.lexicon.lists(places[have])
        merged = [array("i", self.merges.ids(w)).tobytes() for w in distinct.take(pa.array(lack)).to_pylist()]
        lengths = np.concatenate([lengths, np.fromiter(map(len, merged), np.int64, len(merged)) // 4])
        flat = np.concatenate([ids, np.frombuffer(b"".join(merged), np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat))
        order = np.empty(len(distinct), np.int64)
        order[np.concatenate([have, lack])] = np.arange(len(distinct))
        return lists.take(pa.array(order))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        split = self.merges.split(texts.fill_null(""))
        return laid_out(split, self.of_words(split.distinct), len(texts))


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, name: str) -> Encoder:
    """One for each worker process; `name` is that of a file that Spark handed to the executors."""
    return Encoder(tokenizer_file, Lexicon(SparkFiles.get(name)))


@lru_cache(maxsize=2)
def _merges(tokenizer_file: str) -> Merges:
    return Merges(tokenizer_file)


@lru_cache(maxsize=2)
def _tokens(tokenizer_file: str) -> pa.Array:
    return pa.array(token_names(tokenizer_file), pa.string())


def _count(tokenizer_file: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer_file)
        found: list[pa.Table] = []
        held = 0

        def summed() -> pa.Table:
            return pa.concat_tables(found).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for whole in batches:
            for batch in rebatch([whole], whole.schema.names[0], TOGETHER):
                split = merges.split(batch.column(0).fill_null(""))
                table = pa.table({"word": split.distinct, "n": np.bincount(split.codes, minlength=len(split.distinct)).astype(np.int64)})
                found.append(table.filter(pc.less_equal(pc.binary_length(table["word"]), longest)))
                held += found[-1].num_rows
                if held > HELD:
                    found = [summed()]
                    held = found[0].num_rows
                    if held > HELD // 2:
                        yield from found[0].to_batches(max_chunksize=50_000)
                        found, held = [], 0
        if found:
            yield from summed().to_batches(max_chunksize=50_000)

    return run


def build_lexicon(docs: DataFrame, tokenizer_file: str, text_col: str = "text", most: int = WORDS, longest: int = LONGEST) -> str:
    """The name of a file (see SparkFiles) with the lexicon of the words that docs have most: at most `most` words, of at
    most `longest` bytes; where more words are equally frequent than have room, none of these is in it.

    Words are counted over all rows. Null and empty texts have none; without words the lexicon is empty. What reaches the
    driver is bounded by `most` and `longest`.
    """
    spark = docs.sparkSession
    counts = stage(docs.select(text_col).mapInArrow(tidy(_count(tokenizer_file, longest)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = math.inf, most
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels at most
        if r["count"] > room:
            break
        least, room = r.level, room - r["count"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merges.ids(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    frequent = counts.where(level >= F.lit(least)).select("word").mapInArrow(tidy(encode), "word binary, ids array<int>").toArrow() if least < math.inf else pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int32()))})
    return _handed_out(spark, compiled(list(zip(frequent["word"].to_pylist(), frequent["ids"].to_pylist(), strict=True))))


def _handed_out(spark: SparkSession, data: bytes) -> str:
    """The name under which executors find a file with these bytes, which is kept in the shared folder."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


@any_names
def encode_words(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "ids", lexicon: str | None = None) -> DataFrame:
    """All columns of docs but the text, with `out`: the ids of the text (array of int), as the tokenizers library gives
    them without special tokens of its own; the file's added tokens are found in texts.

    lexicon: the name that build_lexicon gave; by default one is built of docs. Null and empty texts have no ids. A column
    named as `out` is replaced; repeated rows stay; an empty table gives an empty table. A text is encoded in one piece.
    """
    name = lexicon or build_lexicon(docs, tokenizer_file, text_col)
    rest = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer_file, name)
        for whole in batches:
            for batch in rebatch([whole], f"{P}text", TOGETHER):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], coder.encode(batch.column(batch.num_columns - 1))], [*batch.schema.names[:-1], f"{P}ids"])
        coder.merges.known.clear()  # workers outlive their tasks

    rows = docs.select(*rest, F.col(text_col).alias(f"{P}text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(f"{P}ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed(f"{P}ids", out)


@any_names
def decode_words(tokens: DataFrame, tokenizer_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of tokens with `out`: the tokens of the ids, joined by one space, as the library decodes with a file that
    names no decoder. Null ids give an empty text; ids that the file lacks give nothing. A column named as `out` is
    replaced; repeated rows stay; an empty table gives an empty table."""
    rows = tokens.drop(out)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _tokens(tokenizer_file)
        for whole in batches:
            for batch in _by_ids(whole, columns.index(ids_col)):
                lists = batch.column(columns.index(ids_col))
                lists = pc.if_else(pc.is_valid(lists), lists, pa.scalar([], lists.type))
                ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                named = names.take(pa.array(np.where((ids >= 0) & (ids < len(names)), ids, len(names)), mask=(ids < 0) | (ids >= len(names))))
                if named.null_count:
                    ends = np.append(0, np.cumsum(named.is_valid().to_numpy(zero_copy_only=False)))[ends]
                    named = named.drop_null()
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), named), " ")
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def _by_ids(whole: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` ids at most; a single longer row is a part of its own."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(whole.column(column).value_lengths(), 0).to_pylist()):
        if held and held + n > most:
            yield whole.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < whole.num_rows:
        yield whole.slice(start)
