"""Audits of gathered records: pages, pairs, partitions, coverage, repeated submissions and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed, written
from .ranks import carried
from .spread import attached


def membership_union(rows: DataFrame, key: str, order: str, payload: str, membership: str) -> DataFrame:
    """(key, payload of the first row, its distinct memberships in order of appearance, n rows)."""
    first_seen = rows.groupBy(key, membership).agg(F.min(order).alias("__seen"), F.count("*").alias("__n"), F.min_by(payload, order).alias("__p"))
    return first_seen.groupBy(key).agg(
        F.min_by("__p", "__seen").alias(payload),
        F.transform(F.array_sort(F.collect_list(F.struct("__seen", F.col(membership).alias("m")))), lambda x: x.m).alias("memberships"),
        F.sum("__n").alias("n"),
    )


def pagination(rows: DataFrame, query: str, page: str, item: str, reported: Column | None = None) -> DataFrame:
    """(query, n_rows, n_items, n_missing_pages, complete): whether the pages from least to greatest are all there.

    reported: the count that the provider gave, if any; a complete query has as many rows, all distinct.
    """
    counts = rows.groupBy(query).agg(F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_items"), (F.max(page) - F.min(page) + 1 - F.count_distinct(page)).cast("long").alias("n_missing_pages"), *([F.max(reported).alias("__reported")] if reported is not None else []))
    complete = (F.col("n_missing_pages") == 0) & (F.col("n_rows") == F.col("n_items"))
    if reported is not None:
        complete &= F.col("__reported").eqNullSafe(F.col("n_rows"))
    return counts.withColumn("complete", F.coalesce(complete, F.lit(False))).drop("__reported")


def cursor_chain(rows: DataFrame, query: str, order: str, request: str, following: str) -> DataFrame:
    """rows with `chained`: whether the request is what the page before named as the next; true for the first page. `order` is
    unique within a query; a query with very many pages spans several tasks."""
    found = carried(rows, query, order, __before=F.struct(F.col(following).alias("following")))
    same = F.coalesce(F.col("__before.following") == F.col(request), F.lit(False))
    return found.withColumn("chained", F.col("__before").isNull() | same).drop("__before")


def pair_audit(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n_rows, n_pairs, n_duplicates) of pairs; repeated pairs are counted before they meet in one place."""
    per = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def prefix_totals(rows: DataFrame, key: str, lengths: tuple[int, ...]) -> DataFrame:
    """(length, prefix, n, n_children_sum): for each prefix the rows under it, and the sum over its longer prefixes."""
    text = F.col(key).cast("string")
    longest = rows.groupBy(F.left(text, F.lit(lengths[-1])).alias("prefix")).agg(F.count("*").alias("n"))
    parts = None
    for short, long in zip(lengths, lengths[1:], strict=False):
        parent = rows.groupBy(F.left(text, F.lit(short)).alias("prefix")).agg(F.count("*").alias("n"))
        child = longest.groupBy(F.left("prefix", F.lit(long)).alias("child")).agg(F.sum("n").alias("n")).groupBy(F.left("child", F.lit(short)).alias("prefix")).agg(F.sum("n").alias("n_children_sum"))
        one = parent.join(child, "prefix", "left").select(F.lit(short).alias("length"), "prefix", "n", "n_children_sum")
        parts = one if parts is None else parts.union(one)
    return parts


def coverage_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): expected keys that were not found are missing, found ones that were not expected are unexpected."""
    a = expected.select(key).distinct().withColumn("__a", F.lit(True))
    b = found.select(key).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, key, "full").where("__a IS NULL OR __b IS NULL")
    return both.select(key, F.when(F.col("__b").isNull(), "missing").otherwise("unexpected").alias("side"))


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending order, nulls first; of rows that tie one is taken."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def submissions(rows: DataFrame, request: str, fingerprint: str, order: str) -> DataFrame:
    """rows with `code`: 201 for the first of a request, 200 for repeats of the same content, 409 for other content. `order` is
    unique; null requests are one request."""
    keyed = rows.withColumn("__key", F.to_json(F.struct(F.col(request).alias("k"))))
    first = written(keyed.groupBy("__key").agg(F.min_by(F.struct(F.col(order).alias("at"), F.col(fingerprint).alias("content")), order).alias("__first"), F.count("*").alias("__n")), "first")
    found = attached(keyed, first, "__key", "__n", rows.count(), F.col(order))
    code = F.when(F.col(order) == F.col("__first.at"), 201).when(F.col(fingerprint).eqNullSafe(F.col("__first.content")), 200).otherwise(409)
    return found.withColumn("code", code).select(*rows.columns, "code")


def trailing_counts(rows: DataFrame, ts: str, order: str, seconds: int, out: str = "recent") -> DataFrame:
    """rows with the number of rows in the `seconds` up to theirs; one exactly `seconds` older does not count.

    Time is cut into stretches of that length and each row also goes to the next stretch, so the stretches are counted
    independently, in parallel: a row has all rows of the stretch before and those of its own up to it, less those that
    have become too old, which one running sum gives. Rows of the same time count each other. A null time has a null count.
    """
    width = seconds * 1_000_000
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = rows.where(F.col(ts).isNotNull()).withColumn("__t", now).withColumn("__own", F.floor(F.col("__t") / width))
    both = timed.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumns({"__stretch": F.col("__own") + F.col("__late"), "__at": F.col("__t") + F.col("__late") * F.lit(width)})
    whole = Window.partitionBy("__stretch").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.partitionBy("__stretch").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    late = F.col("__late").cast("long")
    counted = both.withColumn(out, F.sum(late).over(whole) + F.sum(1 - 2 * late).over(so_far)).where("__late = 0").drop("__t", "__own", "__late", "__stretch", "__at")
    return counted.unionByName(rows.where(F.col(ts).isNull()).withColumn(out, F.lit(None).cast("long")))


def with_ordinals(rows: DataFrame, source: str, dataset: str, order: list[str]) -> DataFrame:
    """rows with _source, _dataset and _record: where they come from and their number from 1 in the order.

    The number comes from a distributed sort: rows are sorted by range, counted within each part, and the parts'
    counts, one for each, are summed.
    """
    session = rows.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = checkpointed(sorted_rows.withColumns({"__id": F.monotonically_increasing_id()}).withColumn("__part", F.shiftright("__id", 33)))
    counts = {r[0]: r[1] for r in numbered.groupBy("__part").agg(F.count("*")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    table = session.createDataFrame(offsets, "__part long, __before long")
    record = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(F.broadcast(table), "__part").select(*rows.columns, F.lit(source).alias("_source"), F.lit(dataset).alias("_dataset"), record.alias("_record"))
