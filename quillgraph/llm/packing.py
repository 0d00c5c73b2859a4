"""Best-fit-decreasing packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, rebatch, stage, tidy
from .words import word_encoder

#: Tails that are packed together: enough of them that best fit leaves little open, few enough for any task.
SHARD_ROWS = 2_000
#: Bytes of texts that a worker takes at once.
TOGETHER = 8_000_000


class OpenWindows:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the open windows that have just so much left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, n: int) -> None:
        node = left + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, window: int, left: int) -> None:
        self.at[left].append(window)
        self._add(left, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window with the least capacity of at least `need`: (window, capacity)."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.size
        self._add(left, -1)
        return self.at[left].pop(), left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, none over capacity; windows are filled without gaps."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, n = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if found := open_windows.tightest(need):
            window[i], left = found
        else:
            window[i], left, n = n, capacity, n + 1
        offset[i] = capacity - left
        if left > need:
            open_windows.put(int(window[i]), left - need)
    return window, offset


def tokenise_and_cut(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens) of at most `capacity` ids: full windows and a tail.

    A worker takes `together` bytes of texts at once and remembers the ids of a word for every 40 of them; less of both
    takes less memory and more time.

    A document is the ids of its text and end_id. Null text counts as empty: a document of end_id alone. Rows with a null
    or the same id are documents each; other columns play no part; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_encoder(tokenizer_file, together // 40), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in rebatch([whole], text_col, together):
                found = coder.encode(batch.column(1))
                ends, flat = found.offsets.to_numpy().tolist(), found.values.to_numpy()
                rows, start, length, crc, total = [], [], [], [], []
                for row, (since, until) in enumerate(zip(ends, ends[1:], strict=False)):
                    n = until - since + 1
                    for at in range(0, n, capacity):
                        rows.append(row)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        ids = flat[since + at : min(since + at + capacity, until)].tobytes()
                        crc.append(zlib.crc32(ids if at + capacity < n else ids + end))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names)
        coder.known.clear()  # workers outlive their tasks

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names[1:])])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


@any_names
def pack(pieces: DataFrame, capacity: int, length_col: str = "length", shards: int | None = None) -> DataFrame:
    """All rows and columns of pieces with sequence_id and offset: no sequence holds over `capacity`, none has a gap.

    Full pieces are sequences of their own and never move. The others are dealt evenly over shards, each packed by
    best-fit decreasing in a task; a shard leaves at most a few windows part full, so padding stays small. By default
    there is a shard for every SHARD_ROWS rows. Rows with a null length are left out, having nothing to
    pack; lengths over capacity are an error. An empty table gives an empty table.
    """
    rows = stage(pieces.drop("sequence_id", "offset").where(F.col(length_col).isNotNull()), "pieces")
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    whole = F.col(length_col) == capacity
    full = rows.where(whole).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        lengths = shard[length_col].to_numpy(np.int64)
        if len(lengths) and lengths.max() > capacity:
            raise ValueError(f"a piece is longer than {capacity}")
        window, offset = best_fit_decreasing(lengths, capacity)
        at = shard[f"{P}shard"].to_numpy(np.int64)
        return shard.drop(columns=f"{P}shard").assign(sequence_id=2 * ((at << 32) + window), offset=offset)

    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    tails = rows.where(~whole)
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))  # of a written table, so the same on every try
    return full.unionByName(tails.withColumn(f"{P}shard", shard).groupBy(f"{P}shard").applyInPandas(run, schema))
