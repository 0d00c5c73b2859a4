"""Lookup and retrieval: triples, nodes, keywords, vectors, fused ranks and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

#: Parameters of keyword scores and of rank fusion.
K1, B = 1.2, 0.75
FUSION = 60
#: Words of queries, and bytes of vectors, that go to all tasks at once, and cells of a block of scores in a task.
PAIRS, BLOCK_BYTES, CELLS = 500_000, 32_000_000, 1_000_000
#: Words of documents that a task looks up at once.
WORDS = 250_000


def triples(claims: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    """Claims that match a pattern; None matches anything, predicates in any case."""
    for name, value in (("subject", subject), ("predicate", predicate and predicate.upper()), ("object", object_)):
        if value is not None:
            claims = claims.where(F.col(name) == value)
    return claims


def find_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose id, label or an alias has the query in any case, with rank 0 for an exact match and 1 for others.

    A blank query finds nothing.
    """
    wanted = query.lower().strip()
    terms = F.array("id", "label")
    if "aliases" in nodes.columns:
        terms = F.concat(terms, F.coalesce("aliases", F.array().cast("array<string>")))
    terms = F.transform(terms, F.lower)
    hit = F.exists(terms, lambda t: F.coalesce(t.contains(wanted), F.lit(False))) if wanted else F.lit(False)
    return nodes.where(hit).withColumn("rank", F.when(F.array_contains(terms, wanted), 0).otherwise(1))


def top_nodes(nodes: DataFrame, query: str, k: int) -> DataFrame:
    """The first k nodes by rank, label and id, with their position and the total found."""
    found = find_nodes(nodes, query)
    total = found.agg(F.count("*").alias("total"))
    best = found.orderBy("rank", F.lower("label"), "id").limit(k)
    order = Window.orderBy("rank", F.lower("label"), "id")  # of k rows
    return best.withColumn("position", F.row_number().over(order)).join(F.broadcast(total))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def keyword_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str = "query_id", query_text: str = "query", k: int | None = None, block: int = PAIRS) -> DataFrame:
    """(query_id, id, score): BM25 of every document that has a word of the query, or with `k` of those that may be among
    the k best, from which best() takes them.

    Queries go to all tasks in blocks of about `block` words. Documents are read once a block and keep the words of its
    queries, with their numbers; these rows are written, their sums taken, and scored where they lie, so neither a frequent
    word nor a frequent query is gathered. Ids are unique; null texts have no words.
    """
    asked = written(queries.select(query_col, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")), "asked")
    parts = max(1, -(-asked.count() // block))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(text_col, F.lit(""))).alias("words"))
    rows = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64(query_col), F.lit(parts)) == part).toArrow()  # about `block` rows
        found = _keyword_block(words, some, query_col, asked.schema[query_col].dataType, k)
        rows = found if rows is None else rows.unionByName(found)
    return rows


def _by_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about WORDS words; a longer document is a part of its own."""
    ends = np.cumsum(batch["words"].value_lengths().to_numpy())
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _keyword_block(words: DataFrame, asked: pa.Table, query_col: str, kind: T.DataType, k: int | None) -> DataFrame:
    term, query = (asked[c].combine_chunks().dictionary_encode() for c in ("term", query_col))
    terms, names = term.dictionary, query.dictionary
    by = np.argsort(term.indices.to_numpy(), kind="stable")
    queries_of = np.split(query.indices.to_numpy()[by], np.cumsum(np.bincount(term.indices.to_numpy(), minlength=len(terms)))[:-1])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in _by_words(whole_batch)):
            lists = batch["words"]
            size = lists.value_lengths().to_numpy()
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
            pair = (np.repeat(np.arange(len(size)), size) * len(terms) + at)[at >= 0]
            pair, tf = np.unique(pair, return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(size) + 1) * len(terms)).astype(np.int32)
            hits = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size.astype(np.int32)), *hits], ["id", "size", "terms", "tf"])

    hits = written(words.mapInArrow(find, T.StructType([words.schema["id"], *T.StructType.fromDDL("size int, terms array<int>, tf array<int>").fields])), "hits")
    whole = hits.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    df = np.zeros(len(terms))
    for r in hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row for each word of the block
        df[r.t] = r.df
    idf, mean = np.log(1 + (whole.n - df + 0.5) / (df + 0.5)), whole.mean or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(names), -np.inf)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step := max(1, CELLS // max(1, len(names)))):
                batch = whole_batch.slice(at, step)
                doc = np.repeat(np.arange(batch.num_rows), batch["terms"].value_lengths().to_numpy())
                t, tf = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * batch["size"].to_numpy()[doc] / mean))
                scores, order = np.zeros((batch.num_rows, len(names))), np.argsort(t, kind="stable")
                for here in np.split(order, np.flatnonzero(np.diff(t[order])) + 1) if len(order) else ():
                    scores[np.ix_(doc[here], queries_of[t[here[0]]])] += weight[here, None]
                yield from _best_cells(scores, scores > 0, batch["id"], names, query_col, k, least)

    return hits.mapInArrow(score, T.StructType([T.StructField(query_col, kind), words.schema["id"], T.StructField("score", T.DoubleType())]))


def _best_cells(scores: np.ndarray, given: np.ndarray, ids: pa.Array, names: pa.Array, query_col: str, k: int | None, least: np.ndarray, of: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the cells that are given; with `k`, of those that a column's k best may be among once they are rounded.

    least: the k-th best score so far of each query of the task, which is raised here; of: the queries of the columns.
    """
    if k is not None:
        of = np.arange(scores.shape[1]) if of is None else of
        if len(scores) > k:
            ranked = np.where(given, scores, -np.inf)
            ranked.partition(len(scores) - k, axis=0)
            least[of] = np.maximum(least[of], ranked[len(scores) - k])
        given = given & (scores >= least[of] - 1e-5)
    row, column = np.nonzero(given)
    for at in range(0, len(row), 100_000):
        r, c = row[at : at + 100_000], column[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), ids.take(pa.array(r)), pa.array(scores[r, c])], [query_col, "id", "score"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has length 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(dot, norm(a) * norm(b))


def vector_scores(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_col: str = "query_id", query_vector: str = "vector", k: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score): the cosine of every vector and each of a stated set of queries, or with `k` of those that may
    be among the k best, from which best() takes them.

    Queries go to all tasks in blocks of about block_bytes. Vectors that are null, of length 0 or of another number of
    dimensions than a query have no score with it.
    """
    asked = written(queries.select(query_col, F.transform(query_vector, lambda x: x.cast("double")).alias("__query")).where("__query IS NOT NULL"), "queries")
    size = asked.agg(F.sum(F.size("__query") * 8)).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    rows = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64(query_col), F.lit(parts)) == part).toArrow()  # about block_bytes
        found = _vector_block(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), some, query_col, asked.schema[query_col].dataType, k)
        rows = found if rows is None else rows.unionByName(found)
    return rows


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each number of dimensions, scaled to length 1, with their places; null and zero vectors are left out."""
    sizes, flat = pc.fill_null(lists.value_lengths(), 0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends, out = np.cumsum(sizes), {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        rows = flat[(ends[at] - n)[:, None] + np.arange(n)]
        norm = np.sqrt((rows * rows).sum(axis=1))
        good = norm > 0
        out[n] = rows[good] / norm[good, None], at[good]
    return out


def _vector_block(vectors: DataFrame, asked: pa.Table, query_col: str, kind: T.DataType, k: int | None) -> DataFrame:
    known, names = _matrices(asked["__query"].combine_chunks()), asked[query_col].combine_chunks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(names), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, CELLS // max(1, len(names)))):
                batch = whole.slice(at, step)
                for n, (rows, place) in _matrices(batch["vector"]).items():
                    if n in known and len(place):
                        queries, of = known[n]
                        scores = rows @ queries.T
                        yield from _best_cells(scores, np.isfinite(scores), batch["id"].take(pa.array(place)), names.take(pa.array(of)), query_col, k, least, of)

    return vectors.mapInArrow(score, T.StructType([T.StructField(query_col, kind), vectors.schema["id"], T.StructField("score", T.DoubleType())]))


def best(scores: DataFrame, k: int, query_col: str = "query_id") -> DataFrame:
    """The k best of each query, ranked from 1; equal scores by id."""
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fused(channels: list[DataFrame], query_col: str = "query_id") -> DataFrame:
    """(query_id, id, score, n_channels, rank): reciprocal ranks summed over channels; an item counts once in each, at
    its best."""
    rows = None
    for i, channel in enumerate(channels):
        one = channel.groupBy(query_col, "id").agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    scores = rows.groupBy(query_col, "id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"), F.count("*").alias("n_channels"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), "id")))


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int, query_col: str = "query_id") -> DataFrame:
    """(n_queries, n_hits, hit_rate, mrr): queries with a relevant item among the first k, and mean reciprocal rank."""
    first = ranked.where(F.col("rank") <= k).join(relevant, [query_col, "id"], "left_semi").groupBy(query_col).agg(F.min("rank").alias("first"))
    per = relevant.select(query_col).distinct().join(first, query_col, "left")
    return per.agg(F.count("*").alias("n_queries"), F.count("first").alias("n_hits"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
