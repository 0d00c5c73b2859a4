"""SimHash near-duplicates found by deletion variants of fingerprint segments.

Two fingerprints that differ in at most k bits, cut into m > k // 2 segments, have a segment that differs in at most
one bit. With 64 bits and k = 2 there are two segments, each half of the fingerprint. Each is indexed under all its
variants with one bit wildcarded; an equality join on the variants gives candidates, which are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, attach, partitions, rebatch, stage, tidy
from .components import components

SEED = 42
BITS, SEGMENTS, MOST = 64, 2, 2
#: A segment value held by more distinct fingerprints than this is crowded, see links().
CROWDED = 64
#: Shingles taken at once, which bounds memory for very long texts.
CHUNK = 1 << 14


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a text in lower case (A-Z), repeats included; of a shorter text's words as a whole."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    data, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(data[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64 bits; bit i is 1 if it is set in over half the hashes of the word shingles."""
    hashes, counts = shingle_hashes(text, shingle, SEED), np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, f0) of all rows, repeated ones too, whatever other columns there are. Null text counts as empty, whose
    fingerprint is zero; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], f"{P}body"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], [id_col, "f0"])

    schema = T.StructType([docs.schema[id_col], T.StructField("f0", T.LongType())])
    return docs.select(id_col, F.col(text_col).alias(f"{P}body")).mapInArrow(tidy(run), schema)


def segment_bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    cuts = [bits * i // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def segment(f: np.ndarray, start: int, end: int) -> np.ndarray:
    """Bits start to end of fingerprints given as rows of 64-bit blocks."""
    block, shift, width = start // 64, start % 64, end - start
    value = f[:, block] >> np.uint64(shift)
    if shift + width > 64:
        value = value | (f[:, block + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << width) - 1)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the one-wildcard variants of its segments: kind names the segment and the bit.

    Bit SEGMENTS of the crowded column puts a fingerprint under the points at distance 0 and 1 as well, of kind -1; the
    lower bits leave out that segment's variants.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            f, crowded = batch.column(0).to_numpy()[at : at + 4096].view(np.uint64), batch.column(1).to_numpy()[at : at + 4096]
            kinds, values, of = [], [], []
            for s, (start, end) in enumerate(segment_bounds(BITS, SEGMENTS)):
                rows = np.flatnonzero(crowded >> s & 1 == 0)
                value = segment(f[rows, None], start, end)
                for bit in range(end - start):
                    kinds.append(np.full(len(rows), start + bit, np.int16))
                    values.append(value & ~np.uint64(1 << bit))
                    of.append(rows)
            if len(rows := np.flatnonzero(crowded >> SEGMENTS)):
                for flip in (0, *(1 << i for i in range(BITS))):
                    kinds.append(np.full(len(rows), -1, np.int16))
                    values.append(f[rows] ^ np.uint64(flip))
                    of.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(values).view(np.int64)), pa.array(f[np.concatenate(of)].view(np.int64))], ["kind", "value", "f0"])


def _verified(kind: np.ndarray, value: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal kind and value, none of which is long: over points each to the first, else all pairs."""
    first = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]))))
    length = np.diff(np.append(first, len(kind)))
    ball = (kind[first] < 0) & (length > 1)
    count = length[ball] - 1
    left = np.repeat(first[ball], count)
    pairs = [(left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count))]
    first, length = first[kind[first] >= 0], length[kind[first] >= 0]
    for gap in range(1, int(length.max(initial=0))):
        first, length = first[length > gap], length[length > gap]
        count = length - gap
        left = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pairs.append((left, left + gap))
    i, j = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
    good = np.bitwise_count(f[i] ^ f[j]) <= MOST
    if good.any():
        ends = np.unique(np.stack([f[i[good]], f[j[good]]], axis=1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, c])) for c in (0, 1)], ["a0", "b0"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links from rows sorted by kind and value, where equal ones stand together."""
    rest = None
    for batch in batches:
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
        last = (columns[0] == columns[0][-1:]) & (columns[1] == columns[1][-1:])
        cut = int(np.argmax(last)) if len(last) else 0
        rest = [c[cut:] for c in columns]
        if cut:
            yield from _verified(*(c[:cut] for c in columns))
    if rest is not None and len(rest[0]):
        yield from _verified(*rest)


def _crowded(classes: DataFrame) -> DataFrame:
    """Adds __qg_crowded, whose bit s says that segment s is within one bit of a value that over CROWDED fingerprints have.

    The bit above these says that some segment is within two bits of such a value: a neighbour that differs there in one
    bit may have left out its variants.
    """
    spark, bounds = classes.sparkSession, segment_bounds(BITS, SEGMENTS)
    none = classes.withColumn(f"{P}crowded", F.lit(0))
    halves = [F.shiftrightunsigned("f0", start).bitwiseAND(F.lit((1 << (end - start)) - 1)) for start, end in bounds]
    keys = [h.bitwiseOR(F.lit(s << 40)) for s, h in enumerate(halves)]
    counts = classes.select(F.explode(F.array(*keys)).alias("half")).groupBy("half").agg(F.count("*").alias("size"))
    full = stage(counts.where(F.col("size") > CROWDED), "crowded")
    if full.isEmpty():
        return none
    ones = [1 << i for i in range(32)]
    twos = [a | b for a in ones for b in ones if a < b]
    flips = spark.createDataFrame([(0, 1), *((x, 1) for x in ones), *((x, 2) for x in twos)], "flip long, level int")
    around = full.crossJoin(F.broadcast(flips)).select(F.col("half").bitwiseXOR(F.col("flip")).alias("half"), F.when(F.col("flip") == 0, F.col("size")).otherwise(1).alias("size"), "level")
    around = stage(around.groupBy("half").agg(F.max("size").alias("size"), F.min("level").alias("level")), "around")
    total = classes.count()
    for s, key in enumerate(keys):
        mine = around.withColumnsRenamed({"half": f"{P}half", "size": f"{P}size{s}", "level": f"{P}level{s}"})
        classes = attach(classes.withColumn(f"{P}half", key), mine, f"{P}half", f"{P}size{s}", total, F.xxhash64("f0")).drop(f"{P}half")
    ball = F.when(F.coalesce(*[F.col(f"{P}level{s}") for s in range(2)]).isNotNull(), 1 << SEGMENTS).otherwise(0)
    flag = sum((F.when(F.col(f"{P}level{s}") == 1, 1 << s).otherwise(0) for s in range(2)), ball)
    classes = classes.withColumn(f"{P}crowded", flag).drop(*[f"{P}{c}{s}" for c in ("size", "level") for s in range(2)])
    return stage(classes.repartition(partitions(spark), F.xxhash64("f0")), "flagged")


def links(classes: DataFrame) -> DataFrame:
    """Links (a0, b0) between distinct fingerprints f0 at a distance of at most MOST bits; they connect all that such pairs
    connect.

    No pair within the distance is without a shared variant, and no large group is ever compared pair by pair: a
    fingerprint whose segment is (within one bit of) a crowded value is indexed for that segment under the 65 points at
    distance 0 or 1 of itself, and one whose segment is two bits off such a value is under these points besides its
    variants. So if two are linked over a segment and one has left out its variants there, the other is under the points
    too. Two fingerprints share such a point just when they differ in at most two bits, so a point has at most 65 of them
    and linking each to the first is enough. A variant has at most 2 * CROWDED fingerprints.

    Repeated fingerprints link to themselves, which connects nothing; nulls are not allowed. Columns other than f0 play no
    part, and an empty table gives an empty table.
    """
    flagged = _crowded(classes.select("f0"))
    index = flagged.select("f0", F.col(f"{P}crowded").cast("int")).mapInArrow(tidy(_variants), "kind short, value long, f0 long")
    dealt = index.repartition(partitions(classes.sparkSession), "kind", "value").sortWithinPartitions("kind", "value", "f0")
    return dealt.mapInArrow(tidy(_match), "a0 long, b0 long").distinct()


@any_names
def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, f0, component_id) of every row; component_id is the least id that links reach.

    Null text counts as empty; texts without words have fingerprint zero and link like others. Equal fingerprints are
    one class, which keeps copies from being compared. Null ids take part; a component of null ids alone has a null
    component_id. Repeated rows stay. An empty table gives an empty table. Other columns play no part.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(marked.groupBy("f0").agg(F.min(id_col).alias(f"{P}least"), F.count("*").alias(f"{P}size")), "classes")
    roots = components(links(classes), "a0", "b0").withColumnsRenamed({"node": "f0", "root": f"{P}root"})
    labelled = stage(classes.join(roots, "f0", "left").withColumn(f"{P}root", F.coalesce(f"{P}root", "f0")), "labelled")
    first = labelled.groupBy(f"{P}root").agg(F.min(f"{P}least").alias("component_id"), F.count("*").alias(f"{P}classes"))
    owners = attach(labelled, first, f"{P}root", f"{P}classes", classes.count(), F.col("f0"))
    owners = stage(owners.select("f0", "component_id", f"{P}size"), "owners")
    return attach(marked, owners, "f0", f"{P}size", marked.count(), F.col(id_col)).select(id_col, "f0", "component_id")
