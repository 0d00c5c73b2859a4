"""Near copies by Jaccard similarity of word shingles: wide SimHash fingerprints, deletion variants, verification.

A fingerprint of the set of a text's shingles is cut into segments. Two texts are candidates if some segment of theirs
differs in at most one bit, that is, if they share a variant of it with one bit wildcarded. The wildcard lies in one
half of the segment, so the other half is equal: rows are dealt by it, once for each half, and within a task the
variants of the half with the wildcard are joined by equality. Candidates whose fingerprints do not rule it out are
verified on their sets of shingles. Sets are much larger than fingerprints, so candidates come in bundles of a few
hundred texts, and a text's set goes once to each bundle instead of once to each candidate.

At a similarity of s each bit differs with probability p = acos(2 s / (1 + s)) / pi, so a segment of w bits serves with
q = (1 - p) ** w + w p (1 - p) ** (w - 1), and a pair is found with 1 - (1 - q) ** segments: for 384 bits in 20 segments
this is 0.98 at 0.8 and over 0.99 from 0.82. Unrelated texts meet in a share of segments * (w + 1) / 2 ** w, 0.0007, of
all pairs, which are ruled out at about 10 ns each; wider and more segments lower that share for larger corpora.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, P, any_names, attach, attach_copies, key_filter, may_hold, partitions, rebatch, stage, tidy
from .components import components
from .simhash import CHUNK, segment, segment_bounds, shingle_hashes

#: The increment and multipliers that turn one hash of 64 bits into several (as in SplitMix64).
STEP, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Share of bits that may differ in a candidate: at a similarity of 0.8 it is 0.151 on average, with a deviation of 0.018
#: for 384 bits; of unrelated texts it is 0.5. Leaders are chosen by LEADER_BLOCKS blocks with a wider share.
MOST_BITS, LEADER_BITS, LEADER_BLOCKS = 0.184, 0.25, 2
#: Rounds of links to leaders before all candidates are looked at.
ROUNDS = 2
#: Texts and bytes of sets of which two blocks make up a bundle, and pairs after which bundles are handed on.
BLOCK_TEXTS, BLOCK_BYTES, HELD_PAIRS = 512, 8_000_000, 1 << 20
#: Rows of the index that are matched together at least, if a task has so many.
TOGETHER = 1 << 16
#: Pairs looked at together, and the size from which a product of two runs is taken label by label.
PAIRS, LARGE = 1 << 18, 4096
#: Rows of a part of a group that holds many: a thousandth of all rows, within these bounds.
LEAST_PART, MOST_PART = 20_000, 1_000_000


def fingerprint(text: str | None, shingle: int, blocks: int) -> tuple[list[int], bytes]:
    """Blocks of 64 bits of the set of shingles, and that set as sorted hashes of 32 bits."""
    hashes = np.unique(shingle_hashes(text, shingle, 0))
    if not len(hashes):
        return [0] * blocks, b""
    counts, steps = np.zeros(64 * blocks, np.int64), np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(STEP)
    for at in range(0, len(hashes), CHUNK):
        x = hashes[at : at + CHUNK, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist(), np.unique(hashes.astype("<u4")).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, blocks: int) -> DataFrame:
    """(id, __qg_text, f0.., __qg_set) of all rows; __qg_text is a hash of the text, which with the id names a row.

    Null texts count as empty, whose fingerprint is 0 and whose set is empty; null ids and repeated rows stay; other columns
    play no part; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], f"{P}body"):
                found = [fingerprint(text.as_py(), shingle, blocks) for text in batch.column(2)]
                columns = [pa.array([f[i] for f, _ in found], pa.int64()) for i in range(blocks)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([s for _, s in found], pa.binary())], names)

    fields = [docs.schema[id_col], T.StructField(f"{P}text", T.LongType()), *(T.StructField(f"f{i}", T.LongType()) for i in range(blocks)), T.StructField(f"{P}set", T.BinaryType())]
    names = [f.name for f in fields]
    return docs.select(id_col, F.xxhash64(text_col).alias(f"{P}text"), F.col(text_col).alias(f"{P}body")).mapInArrow(tidy(run), T.StructType(fields))


def _blocks(batch: pa.RecordBatch, columns: range) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().view(np.uint64) for i in columns], axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _nearest(labelled: DataFrame, blocks: int, segments: int) -> DataFrame:
    """Pairs (a, b): each class (node, label, links, size, f0..) with the nearest, in its first blocks, of the leaders of
    its segments that have another label. A segment's leader is the class with most links, of those that share it whole.

    These few pairs connect most of a large group of near copies, whose centre gathers links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _blocks(batch, range(3, 3 + blocks))
            keys = [segment(f, s, e).astype(np.int64) | i << 40 for i, (s, e) in enumerate(segment_bounds(64 * blocks, segments))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.concat_arrays([batch.column(i)] * segments) for i in range(3 + LEADER_BLOCKS))], [key, *names])

    key, names = f"{P}segment", ["links", "node", "label", *(f"f{i}" for i in range(LEADER_BLOCKS))]
    rows = labelled.select((-F.col("links")).alias("links"), "node", "label", *(f"f{i}" for i in range(blocks))).mapInArrow(tidy(run), T.StructType([T.StructField(n, T.LongType()) for n in (key, *names)]))
    first = rows.groupBy(key).agg(F.min(F.struct(*names)).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    pairs = attach(rows, first.select(key, "rows", *[F.col(f"first.{n}").alias(f"{P}{n}") for n in names[1:]]), key, "rows", labelled.count() * segments, F.col("node"))
    bits = sum(F.bit_count(F.col(n).bitwiseXOR(F.col(f"{P}{n}"))) for n in names[3:])
    pairs = pairs.where((F.col("label") != F.col(f"{P}label")) & (bits <= int(LEADER_BITS * 64 * LEADER_BLOCKS)))
    best = pairs.groupBy("node").agg(F.min(F.struct(bits.alias("bits"), F.col(f"{P}node").alias("other"))).alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def _halves(f: np.ndarray, blocks: int, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, rest) of each half of each segment: key names the half and its value, rest is the other half."""
    for i, (start, end) in enumerate(segment_bounds(64 * blocks, segments)):
        value, width = segment(f, start, end).astype(np.int64), (end - start) // 2
        low, high = value & ((1 << width) - 1), value >> width
        yield 2 * i << 32 | low, high
        yield (2 * i + 1) << 32 | high, low


def runs_joined(code: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, start, length) of the runs of sorted codes that share a variant with one of `width` bits wildcarded.

    First each run with itself, then, for each bit, the runs that differ in it alone.
    """
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    length, value = np.diff(np.append(start, len(code))), code[start]
    yield start, length, start, length
    for bit in range(width):
        mine = np.flatnonzero(value >> bit & 1 == 0)
        other = np.minimum(np.searchsorted(value, value[mine] | 1 << bit), len(value) - 1)
        same = value[other] == value[mine] | 1 << bit
        mine, other = mine[same], other[same]
        yield start[mine], length[mine], start[other], length[other]


def products(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the products of ranges a..a+n and b..b+m, about PAIRS at once."""
    size = n * m
    part = np.cumsum(size) // PAIRS
    for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(part)) + 1) if len(a) else ():
        count = size[some]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(m[some], count)
        yield np.repeat(a[some], count) + at // wide, np.repeat(b[some], count) + at % wide


def apart(label: np.ndarray, a: int, n: int, b: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one large product without those of the commonest label with itself, about PAIRS at once."""
    values, count = np.unique(np.concatenate([label[a : a + n], label[b : b + m]]), return_counts=True)
    common = values[count.argmax()]
    left, right = np.arange(a, a + n), np.arange(b, b + m)
    for mine, theirs in ((left[label[left] != common], right), (left[label[left] == common], right[label[right] != common])):
        step = max(1, PAIRS // max(1, len(theirs)))
        for at in range(0, len(mine) if len(theirs) else 0, step):
            some = mine[at : at + step]
            yield np.repeat(some, len(theirs)), np.tile(theirs, len(some))


def _first_shared(f: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, blocks: int, segments: int) -> np.ndarray:
    """Whether no half of a segment before `kind` is shared too; so each pair is taken under the first key of its keys."""
    good = np.ones(len(i), bool)
    for k, (start, end) in enumerate(segment_bounds(64 * blocks, segments)):
        apart = segment(f[i] ^ f[j], start, end)
        half = (end - start) // 2
        low, high = np.bitwise_count(apart & np.uint64((1 << half) - 1)), np.bitwise_count(apart >> np.uint64(half))
        good &= ~(((low == 0) & (high <= 1) & (2 * k < kind)) | ((high == 0) & (low <= 1) & (2 * k + 1 < kind)))
    return good


def _bundles(i: np.ndarray, j: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """(nodes, pairs) of index pairs: pairs whose ends stand in the same two blocks of texts go into one bundle, and small
    bundles are joined. nodes are sorted; pairs are indexes in them, as unsigned 32-bit integers."""

    def bundle(some: np.ndarray) -> tuple[np.ndarray, bytes]:
        nodes, at = np.unique(np.concatenate([node[i[some]], node[j[some]]]), return_inverse=True)
        return nodes, np.unique(np.sort(at.reshape(2, -1).T, axis=1), axis=0).astype("<u4").tobytes()

    block = np.cumsum(size) // BLOCK_BYTES + np.arange(len(size)) // BLOCK_TEXTS
    code = block[i] * (block[-1] + 1) + block[j]
    by = np.argsort(code, kind="stable")
    held, texts, weight = [], 0, 0
    for some in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
        n, w = 2 * len(some), int(size[i[some]].sum() + size[j[some]].sum())
        if held and (texts + n > BLOCK_TEXTS or weight + w > BLOCK_BYTES):
            yield bundle(np.concatenate(held))
            held, texts, weight = [], 0, 0
        held.append(some)
        texts, weight = texts + n, weight + w
    yield bundle(np.concatenate(held))


def _match(blocks: int, segments: int):
    """Bundles of candidates from rows (part, key, rest, node, label, size, f0..) sorted by part and key, where those of one
    stand together."""
    width = max((e - s + 1) // 2 for s, e in segment_bounds(64 * blocks, segments))
    most = int(MOST_BITS * 64 * blocks)

    def linked(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, key, rest, node, label, size, f = columns
        group = np.cumsum(np.concatenate(([False], (part[1:] != part[:-1]) | (key[1:] != key[:-1]))))
        code = group << width | rest
        by = np.argsort(code, kind="stable")
        code, node, label, size, f, kind = code[by], node[by], label[by], size[by], f[by], key[by] >> 32
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def close(i: np.ndarray, j: np.ndarray) -> int:
            good = label[i] != label[j]
            i, j = i[good], j[good]
            good = _distance(f[i], f[j]) <= most
            i, j = i[good], j[good]
            if len(i):
                good = _first_shared(f, i, j, kind[i], blocks, segments)
                found.append((i[good], j[good]))
            return sum(len(x) for x, _ in found)

        def bundled() -> Iterator[pa.RecordBatch]:
            i, j = (np.concatenate([x[side] for x in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
            found.clear()
            if len(i):
                for nodes, pairs in _bundles(i, j, node, size):
                    yield pa.RecordBatch.from_arrays([pa.array([nodes], pa.list_(pa.int64())), pa.array([pairs], pa.binary())], ["nodes", "pairs"])

        for a, n, b, m in runs_joined(code, width):
            large = n * m > LARGE
            for i, j in products(*(x[~large & (n * m > (a == b))] for x in (a, n, b, m))):
                if close(i, j) > HELD_PAIRS:
                    yield from bundled()
            for at in np.flatnonzero(large):
                for i, j in apart(label, a[at], n[at], b[at], m[at]):
                    if close(i, j) > HELD_PAIRS:
                        yield from bundled()
        yield from bundled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [*(batch.column(i).to_numpy().astype(np.int64) for i in range(6)), _blocks(batch, range(6, 6 + blocks))]
            held.append(columns)
            if sum(len(c[0]) for c in held) < TOGETHER:
                continue
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            if cut := int(np.argmax(last)):  # whole groups only; one that goes on over batches is waited for
                held[-1] = [c[:cut] for c in columns]
                yield from linked([np.concatenate(c) for c in zip(*held, strict=True)])
                held = [[c[cut:] for c in columns]]
        if held:
            yield from linked([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _candidates(labelled: DataFrame, blocks: int, segments: int) -> DataFrame:
    """Bundles (nodes, pairs) of classes (node, label, size, f0..) of different labels that share a variant and differ in at
    most MOST_BITS of their bits.

    A group (half of a segment) of many rows is cut into parts, and each pair of its parts meets in a task of its own.
    Rows of one large label need not meet each other, so they are cut by themselves and meet only the other parts.
    """
    f = [f"f{i}" for i in range(blocks)]
    total = labelled.count()
    large = labelled.groupBy("label").count().where(F.col("count") > max(total // HOT_SHARE, 100)).select("label", F.col("label").alias("large"))
    rows = stage(labelled.join(F.broadcast(large), "label", "left").select("node", "label", "large", "size", *f), "large_labels")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2).dictionary_encode()
            mark, of = pa.concat_arrays([pa.nulls(1, pa.int64()), marks.dictionary]), marks.indices.fill_null(-1).to_numpy() + 1
            for key, _ in _halves(_blocks(batch, range(4, 4 + blocks)), blocks, segments):
                both, n = np.unique(key * len(mark) + of, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // len(mark)), mark.take(pa.array(both % len(mark))), pa.array(n)], ["key", "large", "n"])

    part = min(max(total * 2 * segments // HOT_SHARE, LEAST_PART), MOST_PART)
    # a row for each half's value, so at most segments * 2 ** (1 + half's width), and a few for each large label
    counted = stage(rows.mapInArrow(tidy(sizes), "key long, large long, n long").groupBy("key", "large").agg(F.sum("n").alias("n")), "sizes")
    hot = counted.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > part).select("key")
    cut = counted.join(F.broadcast(hot), "key").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    plans = cut.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("large", "parts"))).alias("plan"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for key, rest in _halves(_blocks(batch, range(4, 4 + blocks)), blocks, segments):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest.astype(np.int16)), *batch.columns], names)

    names = ["key", "rest", "node", "label", "large", "size", *f]
    types = [T.LongType(), T.ShortType(), *[T.LongType()] * (4 + blocks)]
    out = rows.mapInArrow(tidy(index), T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))
    if hot.isEmpty():
        out = out.withColumn("part", F.lit(0))
    else:
        out = out.join(F.broadcast(plans), "key", "left")
        before = F.aggregate(F.filter("plan", lambda p: F.coalesce(p.large < F.col("large"), p.large.isNull() & F.col("large").isNotNull())), F.lit(0), lambda n, p: n + p.parts)
        mine = F.filter("plan", lambda p: p.large.eqNullSafe(F.col("large")))[0].parts
        every = F.aggregate("plan", F.lit(0), lambda n, p: n + p.parts)
        out = out.withColumns({"before": before, "mine": mine, "every": every}).withColumn("own", F.col("before") + F.pmod(F.xxhash64("node"), F.col("mine")).cast("int"))
        meets = F.filter(F.sequence(F.lit(0), F.col("every") - 1), lambda p: F.col("large").isNull() | (p < F.col("before")) | (p >= F.col("before") + F.col("mine")))
        meets = F.transform(meets, lambda p: F.shiftleft(F.least(p, "own").cast("long"), 32) + F.greatest(p, "own"))
        out = out.withColumn("part", F.explode(F.when(F.col("plan").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)))
    out = out.select(F.col("part").cast("long").alias("part"), "key", "rest", "node", "label", "size", *f)
    dealt = out.repartition(partitions(labelled.sparkSession), "part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(tidy(_match(blocks, segments)), "nodes array<long>, pairs binary")


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least `least`; two empty ones have."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _sets_of(ends: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, uses, set) of the nodes of `ends` (node, uses). Only rows that a filter over these points at move."""
    ends = stage(ends, "ends")
    rows = may_hold(marked.select(F.col(f"{P}node").alias("node"), f"{P}set"), key_filter(ends.select(F.xxhash64("node").alias("h"))), F.xxhash64("node"), "asked").where("asked")
    return stage(rows.groupBy("node").agg(F.first(f"{P}set").alias("set")).join(ends, "node"), "sets")


def similar_in_bundles(bundles: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the candidates of bundles whose sets have a Jaccard similarity of at least `least`."""

    def verify(members: pa.Table, given: pa.Table) -> pa.Table:
        by = np.argsort(node := members.column("node").to_numpy())
        node, sets = node[by], members.column("set").take(pa.array(by)).to_pylist()
        sets = [np.frombuffer(x, "<u4") for x in sets]
        pairs = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in given.column("pairs").to_pylist()])
        good = np.array([_alike(sets[i], sets[j], least) for i, j in pairs.tolist()], bool)
        return pa.table({side: pa.array(node[pairs[good, c]], pa.int64()) for c, side in enumerate("ab")})

    bundles = stage(bundles, "bundles").withColumn("bundle", F.monotonically_increasing_id())  # of a written table
    members = bundles.select("bundle", F.explode("nodes").alias("node"))
    sets = _sets_of(members.groupBy("node").agg(F.count("*").alias("uses")), marked)
    members = attach_copies(members, sets, "node", "uses", F.col("bundle")).select("bundle", "node", "set")
    found = members.groupBy("bundle").cogroup(bundles.select(F.col("bundle").alias("of"), "pairs").groupBy("of")).applyInArrow(verify, "a long, b long")
    return stage(found.distinct(), "similar")


def similar_pairs(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of at least `least`; each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stage(pairs, "candidates")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("uses")), marked)
    for side in "ab":
        pairs = attach_copies(pairs, sets.withColumnsRenamed({"node": side, "set": f"set_{side}"}), side, "uses", F.xxhash64("a", "b"))
    return stage(pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long"), "similar")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8, blocks: int = 6, segments: int = 20) -> DataFrame:
    """(id, __qg_text, component_id, kept) of every row; __qg_text hashes the text, so that with the id it names the row.

    Texts link if the Jaccard similarity of their sets of word shingles (words in lower case, split at ASCII white space)
    is at least `similar`. component_id is the least id that links reach. Of a component those rows are kept that have
    the least id (null is the greatest) and of these the least hash of the text: one document, though repeated rows of
    it stay together. Texts of fewer words than a shingle have one shingle; null texts count as empty, and texts without
    words are alike. Equal fingerprints are one class, of which one text is compared; a class is named by 64 bits of its
    fingerprint. An empty table gives an empty table; other columns play no part.

    In ROUNDS rounds each class is verified against the nearest of the classes that lead its segments and are not yet
    connected with it. Then all candidates between what is still apart are verified, so large groups of near copies are
    not compared pair by pair.
    """
    f = [f"f{i}" for i in range(blocks)]
    marked = fingerprints(docs, id_col, text_col, shingle, blocks)
    marked = stage(marked.withColumn(f"{P}node", F.xxhash64(*f)), "fingerprints")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(f"{P}text").alias("text"))
    classes = stage(marked.groupBy(f"{P}node", *f).agg(F.min(rank).alias("first"), F.count("*").alias("size"), F.max(F.octet_length(f"{P}set")).cast("long").alias("bytes")), "classes")
    start = classes.select(F.col(f"{P}node").alias("node"), F.col(f"{P}node").alias("label"), F.lit(0).cast("long").alias("links"), F.col("bytes").alias("size"), *f)
    start = labelled = stage(start, "labelled")
    close = docs.sparkSession.createDataFrame([], "a long, b long")
    for _ in range(ROUNDS):
        close = close.union(similar_pairs(_nearest(labelled, blocks, segments), marked, similar)).distinct()
        links = close.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        known = stage(components(close).withColumnRenamed("root", "label").join(links, "node"), "known")
        labelled = start.drop("label", "links").join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), "size", *f)
        labelled = stage(labelled, "labelled")
    close = close.union(similar_in_bundles(_candidates(labelled, blocks, segments), marked, similar))
    roots = components(close).select(F.col("node").alias(f"{P}node"), "root")
    rooted = stage(classes.join(roots, f"{P}node", "left").select(f"{P}node", "first", "size", F.coalesce("root", f"{P}node").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("classes"))
    owners = stage(attach(rooted, best, "root", "classes", rooted.count(), F.col(f"{P}node")).select(f"{P}node", "best", "size"), "owners")
    found = attach(marked.select(id_col, f"{P}text", f"{P}node"), owners, f"{P}node", "size", marked.count(), F.xxhash64(id_col, f"{P}text"))
    kept = F.col("best.id").eqNullSafe(F.col(id_col)) & (F.col("best.text") == F.col(f"{P}text"))
    return found.select(id_col, f"{P}text", F.col("best.id").alias("component_id"), kept.alias("kept"))


@any_names
def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of docs that near_copies keeps, with all their columns.

    Only rows that a filter over the dropped ones points at take part in the join; the others do not move. Null texts count
    as empty and come back null, null ids are the greatest, repeated rows are dropped or kept together; columns may have any
    names; an empty table gives an empty table.
    """
    gone = stage(near_copies(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias(f"{P}id"), F.col(f"{P}text").alias(f"{P}gone")).distinct(), "gone")
    name = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    rows = may_hold(docs, key_filter(gone.select(F.xxhash64(f"{P}id", f"{P}gone").alias("h"))), name, f"{P}asked")
    same = F.col(id_col).eqNullSafe(F.col(f"{P}id")) & (F.xxhash64(text_col) == F.col(f"{P}gone"))
    left = rows.where(f"{P}asked").join(gone, same, "left_anti")
    return rows.where(f"not {P}asked").select(*docs.columns).unionByName(left.select(*docs.columns))
