"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts are cut into chunks that overlap. Each chunk is pre-tokenised on its own, in any task. Pre-tokenising depends
only on where it starts, so once two neighbours have a boundary in common inside their overlap, the later chunk's
boundaries are the true ones from there on; the chunks are stitched at that point and their pieces are encoded.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, partitions, rebatch, stage, tidy

#: Characters of a chunk, and characters that it shares with the next one.
CHUNK, OVERLAP = 20_000, 1_000
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 300_000


class Encoder:
    """Ids of pieces under a rank file; remembers the pieces seen."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import tiktoken

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        known = self.known
        if new := set(pieces).difference(known):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(pieces)
            for piece in new:
                known[piece] = np.array(self.bpe.encode_ordinary(piece), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(rank_file, pattern)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text) of the chunks of a text; all but the last reach `overlap` characters into the next."""
    for start in range(0, max(len(text), 1), chunk):
        yield start, text[start : start + chunk + overlap]
        if start + chunk + overlap >= len(text):
            return


def boundaries(pattern: regex.Pattern, text: str, last: bool) -> list[int]:
    """Where pre-tokens of a chunk start, and its end if it is the last one.

    What follows the chunk may lengthen or split its last pre-tokens, so in the others the boundaries after the last
    start that is certain are left out: those within the last run of characters of one kind and its neighbour.
    """
    starts = [m.start() for m in pattern.finditer(text)]
    return [*starts, len(text)] if last else starts[:-2]


def part(pattern: regex.Pattern, text: str, since: int, until: int | None) -> list[str]:
    """Pre-tokens of a chunk between two boundaries; what follows is seen, as white space is split by what comes next."""
    return [m[0] for m in takewhile(lambda m: until is None or m.start() < until, pattern.finditer(text, since))]


def _cut_rows(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = list(cut(text, chunk, overlap))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts]), pa.array([i == len(parts) - 1 for i in range(len(parts))])], ["key", "chunk", "start", "text", "last"])

    return run


def _pretokenise(rank_file: str, pattern: str, chunk: int, overlap: int):
    """Adds the boundaries (absolute) in the overlap with the chunk before (head) and with the one after (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file, pattern)
        for batch in batches:
            head, tail = [], []
            for start, text, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                found = boundaries(coder.pattern, text, last)
                head.append([start + b for b in found[: bisect_left(found, min(len(text), overlap) + 1)]])
                tail.append([start + b for b in found[bisect_left(found, min(chunk, len(text))) :]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"])

    return run


def _encode_parts(rank_file: str, pattern: str):
    """Ids of the part of each chunk between two stitches; -1 as an end stands for the end of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file, pattern)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            ids = [coder.ids(part(coder.pattern, text, since - start, None if until < 0 else until - start)) for _, _, start, text, since, until in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["key", "chunk", "ids"])

    return run


def _encode_whole(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file, pattern)
        for whole in batches:
            for batch in rebatch([whole], whole.schema.names[-1]):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([coder.ids(coder.pattern.findall(t or "")) for t in texts], pa.binary())], [*batch.schema.names[:-1], f"{P}ids"])
        coder.known.clear()  # workers outlive their tasks

    return run


@any_names
def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of docs but the text, with `out`: the ids as little-endian unsigned 32-bit integers (binary).

    Texts of at most `chunk` characters are one chunk and are encoded where they are. Longer ones are cut, so one long
    text keeps many tasks busy. A text whose neighbouring chunks have no boundary in common in an overlap (a run of
    letters longer than the overlap, say) is encoded whole. Null counts as empty, which gives no ids. An input column
    named as `out` is replaced; repeated rows stay; an empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in (text_col, out)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = docs.where(F.length(text) <= chunk).select(*rest, text.alias(f"{P}text"))
    schema = T.StructType([*short.schema.fields[:-1], T.StructField(f"{P}ids", T.BinaryType())])
    done = short.mapInArrow(tidy(_encode_whole(rank_file, pattern)), schema)
    long = stage(docs.where(F.length(text) > chunk).select(*rest, text.alias(f"{P}text"), F.monotonically_increasing_id().alias(f"{P}key")), "long")
    parts = long.select(f"{P}key", f"{P}text").mapInArrow(tidy(_cut_rows(chunk, overlap)), "key long, chunk int, start long, text string, last boolean")
    parts = parts.repartition(partitions(docs.sparkSession), "key", "chunk").mapInArrow(tidy(_pretokenise(rank_file, pattern, chunk, overlap)), "key long, chunk int, start long, text string, last boolean, head array<long>, tail array<long>")
    parts = stage(parts, "parts")
    order = Window.partitionBy("key").orderBy("chunk")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitches = parts.select("key", "chunk", "last", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(common).alias("since"))
    stitches = stitches.withColumn("until", F.when(F.col("last"), F.lit(-1).cast("long")).otherwise(F.lead("since").over(order)))
    stitches = stage(stitches, "stitches")
    torn = stitches.where(F.col("since").isNull()).select("key").distinct()
    good = parts.join(stitches.drop("last"), ["key", "chunk"]).join(torn, "key", "left_anti").select("key", "chunk", "start", "text", "since", "until")
    ids = good.mapInArrow(tidy(_encode_parts(rank_file, pattern)), "key long, chunk int, ids binary").groupBy("key")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda part: part.ids.cast("string")), "").cast("binary")
    stitched = long.drop(f"{P}text").join(ids.agg(joined.alias(f"{P}ids")).withColumnRenamed("key", f"{P}key"), f"{P}key").select(*rest, f"{P}ids")
    whole = long.join(torn.withColumnRenamed("key", f"{P}key"), f"{P}key", "left_semi").select(*rest, f"{P}text")
    whole = whole.mapInArrow(tidy(_encode_whole(rank_file, pattern)), schema)
    return done.union(stitched).union(whole).withColumnRenamed(f"{P}ids", out)


@any_names
def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of tokens with `out`: the raw bytes of the ids, joined (binary; null ids give no bytes). A column named
    as `out` is replaced; repeated rows stay; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file, pattern)
        for whole in batches:
            for batch in rebatch([whole], ids_col):
                raw = [coder.decode(ids or b"") for ids in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, out])

    rows = tokens.drop(out)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
