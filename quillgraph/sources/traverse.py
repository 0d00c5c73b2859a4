"""Whole traversals of a provider that shows no more than so many results of a query.

Queries are partitions (ranges of days, prefixes of ids). Those over the bound are split in rounds until all are small
enough; the pages of the small ones list ids, ids are fetched in batches, and an audit compares what was counted, listed
and fetched. Every round is a table, so the driver holds no more than counts of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import with_ordinals
from ..storage import written

#: Results of one query that the provider shows, results of a page, ids of a batch.
SHOWN, PAGE, BATCH = 9_999, 10_000, 200


def asked(count: Callable[[dict], int]) -> Callable[[DataFrame], DataFrame]:
    """Partitions with n, what the caller's function gives for each (a dict of its columns), asked in tasks."""

    def counted(parts: DataFrame) -> DataFrame:
        names = parts.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf.assign(n=[count(dict(zip(names, row, strict=True))) for row in pdf.itertuples(index=False)])

        return parts.mapInPandas(run, T.StructType([*parts.schema.fields, T.StructField("n", T.LongType())]))

    return counted


def days(parts: DataFrame) -> DataFrame:
    """Ranges of days (first, last) split: ranges of years in two halves, others into months, months into days.

    A single day gives no parts.
    """
    first, last = F.col("first"), F.col("last")
    middle = F.floor((F.year(first) + F.year(last)) / 2).cast("int")
    end = F.make_date(middle, F.lit(12), F.lit(31))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    halves = F.array(span(first, end), span(F.date_add(end, 1), last))
    starts = F.sequence(F.trunc(first, "month"), last, F.expr("INTERVAL 1 MONTH"))
    months = F.transform(starts, lambda m: span(F.greatest(m, first), F.least(F.last_day(m), last)))
    singles = F.transform(F.sequence(first, last), lambda d: span(d, d))
    several_months = F.trunc(first, "month") < F.trunc(last, "month")
    found = F.when(F.year(first) < F.year(last), halves).when(several_months, months).when(first < last, singles)
    return parts.select(F.col("__id").alias("__of"), F.explode(found).alias("p")).select("__of", "p.*")


def prefixes(alphabet: str, longest: int) -> Callable[[DataFrame], DataFrame]:
    """Prefixes (prefix) split by their next character; prefixes of `longest` characters give no parts."""

    def split(parts: DataFrame) -> DataFrame:
        letters = F.array(*[F.lit(c) for c in alphabet])
        return parts.where(F.length("prefix") < longest).select(F.col("__id").alias("__of"), F.explode(F.transform(letters, lambda c: F.concat("prefix", c))).alias("prefix"))

    return split


@dataclass(frozen=True)
class Partitions:
    """leaves: partitions with n that are small enough, none empty; too_large: those that no split makes smaller; torn:
    split ones whose parts do not add up to them (n, of_parts)."""

    leaves: DataFrame
    too_large: DataFrame
    torn: DataFrame


def partitioned(start: DataFrame, counted: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame], most: int = SHOWN, rounds: int = 64) -> Partitions:
    """Split the partitions of `start` until each has at most `most` results.

    counted: adds n to partitions. split: gives the parts of partitions, each with the `__id` of its whole as `__of`. What
    has neither few results nor parts is too large. More than `rounds` rounds are an error. An empty start gives none.
    """
    names, now = start.columns, start
    leaves, large, torn = [], [], []
    whole = None
    for number in range(rounds):
        now = written(counted(now).withColumn("__id", F.concat(F.lit(f"{number}:"), F.monotonically_increasing_id().cast("string"))), "frontier")
        if whole is not None:
            sums = now.groupBy("__of").agg(F.sum("n").alias("of_parts"))
            torn.append(whole.join(sums.withColumnRenamed("__of", "__id"), "__id").where(F.col("n") != F.col("of_parts")).select(*names, "n", "of_parts"))
        leaves.append(now.where((F.col("n") > 0) & (F.col("n") <= most)).select(*names, "n"))
        over = now.where(F.col("n") > most)
        parts = written(split(over), "parts")
        split_ones = parts.select(F.col("__of").alias("__id")).distinct()
        large.append(over.join(split_ones, "__id", "left_anti").select(*names, "n"))
        whole, now = over.select("__id", *names, "n"), parts
        if parts.isEmpty():
            none = start.sparkSession.createDataFrame([], T.StructType([*start.schema.fields, T.StructField("n", T.LongType()), T.StructField("of_parts", T.LongType())]))
            return Partitions(_union(leaves), _union(large), _union([none, *torn]))
    raise ValueError(f"partitions are over {most} after {rounds} rounds")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def listed(leaves: DataFrame, page: Callable[[dict, int, int], list[str]], size: int = PAGE) -> DataFrame:
    """(columns of the leaf, n, offset, id): the ids of each page of the partitions, each page asked in a task.

    A page without ids has one row with a null id, so audits see it.
    """
    names = leaves.columns
    pages = leaves.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))))
    columns = pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                found = page({c: row[c] for c in names}, int(row["offset"]), min(size, int(row["n"]) - int(row["offset"])))
                yield pd.DataFrame({**{c: [row[c]] * max(1, len(found)) for c in columns}, "id": found or [None]})

    dealt = pages.repartition(F.xxhash64(*pages.columns))
    return dealt.mapInPandas(run, T.StructType([*pages.schema.fields, T.StructField("id", T.StringType())]))


def fetched(ids: DataFrame, fetch: Callable[[list[str]], list[tuple[str, str]]], size: int = BATCH) -> DataFrame:
    """(batch, position, id, payload): what the caller's function gives for the distinct ids, in batches of sorted ids."""
    numbered = with_ordinals(ids.where(F.col("id").isNotNull()).select("id").distinct(), "", "", ["id"])
    batches = numbered.groupBy(F.floor((F.col("_record") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, some in zip(pdf["batch"], pdf["ids"], strict=True):
                found = fetch(list(some))
                yield pd.DataFrame({"batch": batch, "position": range(len(found)), "id": [i for i, _ in found], "payload": [p for _, p in found]})

    return batches.repartition("batch").mapInPandas(run, "batch long, position int, id string, payload string")


def records(rows: DataFrame) -> DataFrame:
    """(id, payload): of records that came several times the last one; rows without an id are left out."""
    last = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("payload", F.struct("batch", "position")).alias("payload"))
    return last


def id_differences(ids: DataFrame, found: DataFrame) -> DataFrame:
    """(id, kind): `missing` ids that were listed but not fetched, `unexpected` ones that were fetched unasked."""
    a = ids.where(F.col("id").isNotNull()).select("id").distinct().withColumn("listed", F.lit(True))
    b = found.where(F.col("id").isNotNull()).select("id").distinct().withColumn("fetched", F.lit(True))
    kind = F.when(F.col("fetched").isNull(), "missing").when(F.col("listed").isNull(), "unexpected")
    return a.join(b, "id", "full").select("id", kind.alias("kind")).where("kind IS NOT NULL")


def mismatches(ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_listed): partitions that listed another number of ids than they counted."""
    return ids.groupBy(*keys, "n").agg(F.count("id").alias("n_listed")).where(F.col("n") != F.col("n_listed"))


def audit(parts: Partitions, ids: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: partitions, their results, distinct ids, fetched ones, and what is wrong; complete if nothing is.

    A traversal that lists no ids is not complete.
    """
    sums = ids.agg(F.count_distinct("id").alias("n_ids"))
    leaves = parts.leaves.agg(F.count("*").alias("n_partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_counted"))
    wrong = id_differences(ids, found).agg(F.count_if(F.col("kind") == "missing").alias("n_missing"), F.count_if(F.col("kind") == "unexpected").alias("n_unexpected"))
    number = lambda df, name: df.agg(F.count("*").alias(name))
    one = leaves.join(sums).join(wrong).join(number(records(found), "n_records")).join(number(mismatches(ids, keys), "n_mismatched")).join(number(parts.too_large, "n_too_large")).join(number(parts.torn, "n_torn"))
    bad = sum((F.col(c) for c in ("n_missing", "n_unexpected", "n_mismatched", "n_too_large", "n_torn")), F.lit(0))
    return one.withColumn("complete", (bad == 0) & (F.col("n_ids") > 0))
