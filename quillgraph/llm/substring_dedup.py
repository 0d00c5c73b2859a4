"""Removal of repeated word windows, found by difference-cover anchors.

D is a difference cover modulo PERIOD: for any two positions i and j some shift s < PERIOD takes both into D modulo
PERIOD. Hashing short anchors only at positions in D is therefore enough: two equal windows of `width` words contain
equal anchors of width - PERIOD + 1 words at the same shift, at positions that both documents hash. Anchors that occur
once rule out every window around them; where they repeat, they are extended to the windows of full width that hold
them, and those are compared by a hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, partitions, rebatch, tidy

#: A perfect difference cover: every difference modulo 21 is one of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text hashed together in a task.
BATCH_BYTES = 2_000_000
#: Bytes of text for each bucket of hashes, which bounds what a task holds; there are as many buckets as shuffle
#: partitions at least.
BUCKET_BYTES = 32_000_000
#: Fixed odd multipliers of the rolling hashes, and the values of bytes under them.
_RANDOM = np.random.Generator(np.random.PCG64(20240901))
RADIX = [int(x) | 1 for x in _RANDOM.integers(0, 1 << 63, 2, np.uint64)]
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, (2, 256), np.uint64)
SEPARATORS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, remembered."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, BATCH_BYTES), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


class Words:
    """The words of many texts, one after another, as bytes joined by single spaces."""

    def __init__(self, raw: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        blank = SEPARATORS[data]
        first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        last = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
        length = last - first + 1
        self.end = np.cumsum(length + 1)  # in self.data, after the space behind the word
        self.start = self.end - length - 1
        keep = ~blank
        keep[last + 1] = True
        self.data = np.where(blank, np.uint8(32), data)[keep]
        ends = np.cumsum([len(r) + 1 for r in raw])
        bounds = np.searchsorted(first, ends)
        self.n_words = np.diff(np.concatenate(([0], bounds)))
        self.first_word = bounds - self.n_words
        self.doc = np.repeat(np.arange(len(raw)), self.n_words)
        self.at = np.arange(len(first)) - self.first_word[self.doc] if len(first) else np.zeros(0, np.int64)

    def hashes(self, word: np.ndarray, width: int, which: int) -> np.ndarray:
        """64-bit hashes of the `width` words that start at each of the given word numbers."""
        if not len(word):
            return np.zeros(0, np.uint64)
        n = len(self.data) + 1
        up = _powers(RADIX[which], n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[which][self.data] * up[:-1], dtype=np.uint64)))
        down = _powers(pow(RADIX[which], -1, 1 << 64), n)
        start, end = self.start[word], self.end[word + width - 1]
        x = (sums[end] - sums[start]) * down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def kept(self, removed: np.ndarray) -> list[bytes]:
        """The words of each text that are not removed, joined by one space."""
        count = np.bincount(self.doc[~removed], minlength=len(self.n_words))
        stays = np.repeat(~removed, self.end - self.start)
        data = self.data[stays].tobytes()
        size = np.bincount(self.doc, weights=np.where(removed, 0, self.end - self.start), minlength=len(self.n_words)).astype(np.int64)
        ends = np.cumsum(size)
        return [data[e - s : e - 1] if c else b"" for s, e, c in zip(size.tolist(), ends.tolist(), count.tolist(), strict=True)]


def anchors(words: Words, width: int) -> np.ndarray:
    """Numbers of the words at which an anchor starts."""
    length = width - PERIOD + 1
    fits = words.at + length <= words.n_words[words.doc]
    return np.flatnonzero(fits & np.isin(words.at % PERIOD, COVER))


def candidates(words: Words, repeated: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a window of full width starts that holds a repeated anchor."""
    n = len(words.doc)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(repeated - PERIOD + 1, words.first_word[words.doc[repeated]]), 1)
    np.add.at(mark, repeated + 1, -1)
    fits = words.at + width <= words.n_words[words.doc]
    return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & fits)


def covered(words: Words, windows: np.ndarray, width: int) -> np.ndarray:
    mark = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(mark, windows, 1)
    np.add.at(mark, windows + width, -1)
    return np.cumsum(mark[:-1]) > 0


#: Columns of the rows that ask which hashes repeat: those of one batch and one bucket. Of a hash that repeats within
#: the batch only one row is asked about, and `known` says that it repeats; its other places wait in `twins`.
ASKED = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("hash", "more", "known", "key", "at"))])


def _ask(key: np.ndarray, at: np.ndarray, hashes: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ASKED, one for each bucket of hashes."""
    if not len(at):
        return
    order = np.lexsort(hashes[::-1])
    key, at, hashes = key[order], at[order], [h[order] for h in hashes]
    new = np.concatenate(([True], np.any([h[1:] != h[:-1] for h in hashes], axis=0)))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    # places already known to repeat are dealt evenly, as they need no answer; one for each hash is asked about for the others' sake
    bucket = np.where(new, hashes[0] >> np.uint64(33), key.view(np.uint64) ^ at.astype(np.uint64)) % np.uint64(buckets)
    kind = np.where(new, many.astype(np.uint8), np.uint8(2))
    by = np.lexsort((at, key, kind == 2, bucket))  # keys side by side compress well
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=np.uint64(buckets)))
    rows = [[], [], [], [], [], []]
    more = (hashes[1] >> np.uint64(32)).astype(np.uint32) if len(hashes) > 1 else np.zeros(len(at), np.uint32)
    for some in np.split(by, cuts[1:]):
        ask = some[kind[some] < 2]
        rows[0].append(int(bucket[some[0]]))
        for column, values in zip(rows[1:], (hashes[0][ask], more[ask] if len(hashes) > 1 else more[:0], kind[some], key[some], at[some].astype(np.uint32)), strict=True):
            column.append(values.tobytes() if values.dtype != np.uint32 else _planes(values))
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ASKED.names)


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers with their bytes apart, which compresses better."""
    return values.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _answer(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (key, at) of a bucket whose hash repeats."""
    hashes = np.frombuffer(b"".join(table.column("hash").to_pylist()), np.uint64)
    more = np.concatenate([_from_planes(x) for x in table.column("more").to_pylist()])
    parts = [(np.frombuffer(k, np.uint8), np.frombuffer(w, np.int64), _from_planes(a)) for k, w, a in zip(*(table.column(c).to_pylist() for c in ("known", "key", "at")), strict=True)]
    kind, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    repeats = kind > 0
    asked = np.flatnonzero(kind < 2)
    columns = [hashes, more] if len(more) else [hashes]
    order = np.lexsort(columns[::-1])
    new = np.concatenate(([True], np.any([h[order][1:] != h[order][:-1] for h in columns], axis=0)))[: len(order)]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1.0 + (kind[asked[order]] == 1))
    repeats[asked[order]] = total[group] > 1
    doc, at = doc[repeats], at[repeats]
    return doc, at


#: Rows of answers: the places found to repeat of the keys of one share.
ANSWERED = T.StructType([T.StructField("share", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("at", T.BinaryType())])


def _repeated(asked: DataFrame, shares: int) -> DataFrame:
    """(key, places): for each document the places whose hash occurs more than once anywhere."""

    def answer(table: pa.Table) -> pa.Table:
        """Places of a bucket whose hash repeats, dealt by the shares of their keys."""
        key, at = _answer(table)
        share = key.view(np.uint64) % np.uint64(shares)
        by = np.argsort(share, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(share[by], prepend=np.uint64(shares))), len(by))
        rows = [by[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"share": pa.array([int(share[r[0]]) for r in rows], pa.int32()), "key": pa.array([key[r].tobytes() for r in rows], pa.binary()), "at": pa.array([_planes(at[r]) for r in rows], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """One row for each key of a share."""
        key = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("key").to_pylist()])
        at = np.concatenate([_from_planes(x) for x in table.column("at").to_pylist()])
        by = np.argsort(key, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(key[by], prepend=~key[by[:1]])), len(by))
        rows = [by[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"key": pa.array([int(key[r[0]]) for r in rows], pa.int64()), "places": pa.array([_planes(np.sort(at[r])) for r in rows], pa.binary())})

    found = asked.repartition(shares, "bucket").groupBy("bucket").applyInArrow(answer, ANSWERED)
    return found.repartition(shares, "share").groupBy("share").applyInArrow(gather, "key long, places binary")


def _places(column: pa.Array) -> list[np.ndarray]:
    return [_from_planes(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in column.to_pylist()]


def _numbers(words: Words, places: list[np.ndarray]) -> np.ndarray:
    """Word numbers of places given for each text."""
    return np.concatenate([words.first_word[i] + p for i, p in enumerate(places)]) if places else np.zeros(0, np.int64)


@any_names
def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, buckets: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; kept has the words left, joined by one space, as bytes.

    Words are maximal runs of anything but ASCII white space. A word goes if a window of `width` consecutive words of
    one text that covers it starts anywhere else too, be it in the same text; all occurrences go. Windows are judged
    on the input. Null text counts as empty. Repeated rows are texts of their own, so all their windows repeat. Windows are
    compared by 96 bits of hash, rows named by 64. An empty table gives an empty table; other columns play no part.
    """
    if width < PERIOD:
        raise ValueError(f"windows have at least {PERIOD} words")
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_buckets = buckets or max(partitions(docs.sparkSession), total // BUCKET_BYTES)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    id_field = T.StructField("id", docs.schema[id_col].dataType)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], "text", BATCH_BYTES):
                words = Words([t.encode() for t in batch.column(0).to_pylist()])
                word = anchors(words, width)
                key = batch.column(1).to_numpy()[words.doc[word]]
                yield from _ask(key, words.at[word], [words.hashes(word, width - PERIOD + 1, 0)], n_buckets)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [packer.compress(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), batch.column(2)], ["id", "text", "key"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
        opener = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in rebatch([whole], "text", BATCH_BYTES // 3):
                yield batch, Words([opener.decompress(t) for t in batch.column("text").to_pylist()])

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in texts(batches):
            word = candidates(words, _numbers(words, _places(batch.column("places"))), width)
            key = batch.column("key").to_numpy()[words.doc[word]]
            yield from _ask(key, words.at[word], [words.hashes(word, width, which) for which in (0, 1)], n_buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in texts(batches):
            gone = covered(words, _numbers(words, _places(batch.column("places"))), width)
            n_removed = np.bincount(words.doc[gone], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.n_words), pa.array(n_removed), pa.array(words.kept(gone), pa.binary())], [id_col, "n_words", "n_removed", "kept"])

    squeezed = rows.select("id", "text", "key").mapInArrow(tidy(squeeze), T.StructType([id_field, T.StructField("text", T.BinaryType()), T.StructField("key", T.LongType())]))
    near = _repeated(rows.select("text", "key").mapInArrow(tidy(ask_anchors), ASKED), n_buckets)
    far = _repeated(squeezed.join(near, "key").select("key", "text", "places").mapInArrow(tidy(ask_windows), ASKED), n_buckets)
    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    return squeezed.join(far, "key", "left").select("id", "text", "places").mapInArrow(tidy(finish), schema)
