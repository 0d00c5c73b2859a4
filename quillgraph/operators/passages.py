"""Texts as passages: chunks with offsets, exact grounding of quotes, size-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeezed
from ..storage import written

#: Words whose hash a passage is looked up by.
ANCHOR_WORDS = 6
#: Passages of fewer words that a scan of the texts looks for.
SHORT_PASSAGES = 1_000


def strides(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk, start, end, content) of chunks of a fixed number of characters that overlap."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step).cast("int"))
    rows = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    start = F.col("chunk") * step
    return rows.select("id", "chunk", start.alias("start"), F.least(start + size, F.length("text")).alias("end"), F.substring("text", start + 1, F.lit(size)).alias("content"))


def split_words(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks of at most `most` characters of a text with single spaces.

    A chunk takes whole words as long as they fit, if these reach into its second half; else, as with a word that is longer
    than what is left, it takes `most` characters. The next chunk begins `overlap` characters before, or with the first
    word that begins there or later, but not after the chunk's end.
    """
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32) != ord(" ")
    edges = np.flatnonzero(np.diff(np.concatenate(([0], letters.view(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    start, stop = 0, len(text)
    while stop:
        whole = ends[np.searchsorted(ends, start + most, "left") - 1 :][:1]  # the last word that ends before the limit
        fits = len(whole) and whole[0] >= max(start + most // 2, start + 1) and whole[0] < start + most
        end = stop if stop <= start + most else int(whole[0]) if fits else start + most
        yield start, end
        if end == stop:
            return
        start = max(start + 1, end - overlap)
        word = begins[np.searchsorted(begins, start) :][:1]
        if len(word) and word[0] <= end:
            start = int(word[0])


def word_chunks(docs: DataFrame, id_col: str, text_col: str, most: int = 3600, overlap: int = 400) -> DataFrame:
    """(id, chunk, start, end, content): chunks that end between words, of the text with its white space squeezed, which
    start and end count in; blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, s, e, text[s:e]) for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) if text and text.strip() for k, (s, e) in enumerate(split_words(text, most, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "end", "content"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("chunk int, start int, end int, content string").fields])
    return docs.select(id_col, squeezed(text_col)).mapInPandas(run, schema)


def locate(passages: DataFrame, docs: DataFrame, passage_id: str, passage_text: str, id_col: str, text_col: str) -> DataFrame:
    """(passage, id, start, end): first exact occurrence of each passage in each text that has it, in code points.

    A text with a passage also has its inner words (all but the first and last) in a row, so an equality join on the
    hash of ANCHOR_WORDS of them finds every such text; the passage itself is then looked for. Passages of fewer words
    are looked for in every text, SHORT_PASSAGES of them at a time.
    """
    words = F.filter(F.split(F.col(passage_text), r"\s+"), lambda w: w != "")
    asked = passages.select(F.col(passage_id).alias("passage"), F.col(passage_text).alias("quote"), words.alias("words")).where(F.col("quote") != "")
    long, short = asked.where(F.size("words") >= ANCHOR_WORDS + 2), asked.where(F.size("words") < ANCHOR_WORDS + 2)
    anchors = long.select("passage", "quote", F.xxhash64(F.slice("words", 2, ANCHOR_WORDS)).alias("anchor"))
    spread = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "").alias("words"))
    grams = spread.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - ANCHOR_WORDS + 1)), lambda i: F.xxhash64(F.slice("words", i, ANCHOR_WORDS))))).alias("anchor"))
    near = grams.join(anchors, "anchor").select("passage", "quote", "id").distinct()
    found = near.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").select("passage", "quote", "id", "text")
    parts = -(-short.count() // SHORT_PASSAGES)
    if parts:
        short = written(short.select("passage", "quote", F.pmod(F.xxhash64("quote"), F.lit(parts)).alias("part")), "short")
    for part in range(parts):
        some = short.where(F.col("part") == part).select("passage", "quote")
        found = found.unionByName(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.expr("contains(text, quote)")).select("passage", "quote", "id", "text"))
    start = F.expr("locate(quote, text)") - 1
    return found.where(F.expr("contains(text, quote)")).select("passage", "id", start.alias("start"), (start + F.length("quote")).alias("end"))


def grounded(spans: DataFrame, units: DataFrame) -> DataFrame:
    """spans (unit_id, start, end, quote) with `exact`: whether the unit's text has just the quote there."""
    rows = spans.join(units.select("unit_id", F.col("text").alias("__text")), "unit_id", "left")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("__text"))
    same = F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    return rows.withColumn("exact", F.coalesce(inside & same, F.lit(False))).drop("__text")


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """rows with `batch`: within each group, in order, a new batch starts when a row would exceed either bound.

    Where a batch starts depends on all rows before it in its group, so a group's orders and sizes (and nothing else)
    pass through one task, in chunks; groups are a file's or a client's rows. `order` is unique in a group. A row over
    most_size is an error, null groups are one group.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, held, n = None, 0, 0, 0
        for pdf in batches:
            out = []
            for g, s in zip(pdf["g"], pdf["s"], strict=True):
                if s > most_size:
                    raise ValueError(f"a row has size {s}; at most {most_size}")
                if g != now:
                    now, batch, held, n = g, 0, 0, 0
                elif n and (held + s > most_size or n == most_rows):
                    batch, held, n = batch + 1, 0, 0
                held, n = held + s, n + 1
                out.append(batch)
            yield pdf[["g", "o"]].assign(batch=out)

    narrow = rows.select(F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    narrow = narrow.repartition("g").sortWithinPartitions("g", "o")
    found = narrow.mapInPandas(run, T.StructType([T.StructField("g", T.StringType()), T.StructField("o", rows.schema[order].dataType), T.StructField("batch", T.LongType())]))
    joined = rows.withColumn("__g", F.to_json(F.struct(F.col(group).alias("g")))).join(found.withColumnsRenamed({"g": "__g", "o": order}), ["__g", order])
    return joined.select(*rows.columns, "batch")


def manifest(docs: DataFrame, kind: str, source: str, text: str) -> DataFrame:
    """(kind, n, n_sources, bytes, most_bytes) of exported passages."""
    size = F.octet_length(text)
    return docs.groupBy(kind).agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources"), F.sum(size).alias("bytes"), F.max(size).alias("most_bytes"))


def content_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content_id, first_id, n): texts that are equal but for white space."""
    return docs.groupBy(F.sha2(squeezed(text_col), 256).alias("content_id")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
