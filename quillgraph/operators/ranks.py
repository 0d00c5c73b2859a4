"""Elements at ranks, numbers of rows in order and values carried along, from a sort by range: no key passes through one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .spread import attached


def numbered(rows: DataFrame, order: Sequence[str], **flags: Column) -> DataFrame:
    """rows with a column for each flag: how many rows up to this one, in order, have it, or the sum if it is a number. `order`
    should be unique."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumns({f"__{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in flags.items()})
    placed = written(marked.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "emitted")
    sums, before = [], dict.fromkeys(flags, 0)
    for r in placed.groupBy("__part").agg(*[F.sum(f"__{n}").alias(n) for n in flags]).orderBy("__part").collect():  # a row for each part
        sums.append((r["__part"], *before.values()))
        before = {n: before[n] + r[n] for n in flags}
    offsets = spark.createDataFrame(sums, "__part int, " + ", ".join(f"__before_{n} long" for n in flags))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.join(F.broadcast(offsets), "__part")
    return counted.select(*rows.columns, *[(F.col(f"__before_{n}") + F.sum(f"__{n}").over(own)).alias(n) for n in flags])


def elements(rows: DataFrame, key: str, value: str, **at: Callable[[Column], Column]) -> DataFrame:
    """(key, n, the element at each rank): a rank from 1 is a function of n, how many values that are not null a key has.

    Exact; equal values are as many ranks. Keys without values are left out, null keys are one key. Equal values are
    counted first and a key's values are sorted by range, so a key with most of the rows spans many tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__times"))
    named = counts.withColumn("__key", F.to_json(F.struct(F.col(key).alias("k"))))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(named.repartitionByRange(parts, "__key", value).withColumn("__part", F.spark_partition_id()), "values")
    sums = written(placed.groupBy("__part", "__key").agg(F.sum("__times").alias("__sum"), F.count("*").alias("__rows")), "sums")
    # a key is in as many parts as it needs: their sums before each part, and in all
    of_key = Window.partitionBy("__key")
    sums = sums.select("__part", "__key", (F.sum("__sum").over(of_key.orderBy("__part")) - F.col("__sum")).alias("__before"), F.sum("__sum").over(of_key).alias("n"), "__rows").withColumn("__at", F.concat_ws(" ", F.col("__part"), "__key")).drop("__part", "__key")
    rows_ = attached(placed.withColumn("__at", F.concat_ws(" ", F.col("__part"), "__key")), sums, "__at", "__rows", placed.count(), F.col(value))
    # rows of a part stay in order within one task, the part's
    own = Window.partitionBy("__part", "__key").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    last = rows_.withColumn("__last", F.col("__before") + F.sum("__times").over(own))
    hit = {name: F.max(F.when((F.col("__last") >= rank(F.col("n"))) & (F.col("__last") - F.col("__times") < rank(F.col("n"))), F.col(value))).alias(name) for name, rank in at.items()}
    return last.groupBy(F.col(key).alias(key), "__key").agg(F.max("n").alias("n"), *hit.values()).drop("__key")


def carried(rows: DataFrame, key: str, order: str, **values: Column) -> DataFrame:
    """rows with the last value that is not null among the rows of the key before this one, for each of `values`.

    Rows are sorted by range over all tasks, so a key with a large share of all rows spans several; what a part hands on
    are the last values of its first and last key. `order` is unique within a key; null keys are one key.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"__{n}": c for n, c in values.items()})
    placed = written(named.repartitionByRange(parts, key, order).withColumn("__part", F.spark_partition_id()), "placed")
    place = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"))
    bounds = written(placed.groupBy("__part").agg(F.min(place).alias("__lo"), F.max(place).alias("__hi")), "bounds")
    joined = placed.join(F.broadcast(bounds), "__part")  # a row for each part
    last = [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(n) for n in values]
    ends = joined.where((place == F.col("__lo")) | (place == F.col("__hi"))).groupBy("__part", "__lo", "__hi", place.alias("at")).agg(*last)
    given, now, before = [], None, dict.fromkeys(values)
    held = {(r["__part"], r.at): r for r in ends.collect()}  # two rows for each part
    for part, r in sorted((p, r) for (p, at), r in held.items() if at == r["__lo"]):
        goes_on = now == r["__lo"]
        given.append((part, *[before[n] if goes_on else None for n in values]))
        end = held[part, r["__hi"]]
        before = {n: before[n] if end[n] is None and goes_on and r["__lo"] == r["__hi"] else end[n] for n in values}
        now = r["__hi"]
    kinds = dict(placed.dtypes)
    offsets = spark.createDataFrame(given, "__part int, " + ", ".join(f"__given_{n} {kinds[f'__{n}']}" for n in values))
    own = Window.partitionBy("__part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = joined.join(F.broadcast(offsets), "__part")
    return found.select(*rows.columns, *[F.coalesce(F.last(f"__{n}", ignorenulls=True).over(own), F.when(place == F.col("__lo"), F.col(f"__given_{n}"))).alias(n) for n in values])


def index_rank(p: float) -> Callable[[Column], Column]:
    """The rank of the element at int(p * (n - 1)), without interpolation."""
    return lambda n: 1 + F.floor(F.lit(p) * (n - 1))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the mean of the two middle values."""
    found = elements(rows, key, value, low=lambda n: F.floor((n + 1) / 2), high=lambda n: F.floor((n + 2) / 2))
    return found.select(key, ((F.col("low") + F.col("high")) / 2).alias("median"))
