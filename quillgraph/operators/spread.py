"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows of a part of a key that holds many on both sides; a task joins one part of each side.
PART = 2000
#: Rows of a table that one part of it should have at most, wherever tasks sort or hash it.
PART_ROWS = 250_000


def parts_of(*tables: DataFrame) -> int:
    """How many parts tables of this many rows should be dealt into; of Parquet only the footers are read."""
    return -(-sum(t.count() for t in tables) // PART_ROWS)


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys into `parts` parts, so that what a task holds does not grow with the table; as they are if the
    session has as many parts anyway. Joins and groups by the keys then need no further shuffle."""
    if parts is None or parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(parts, *keys)


def attached(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with groups, which has one row for each key, small values and the number of its rows in `size`.

    Hot keys are broadcast, at most HOT_SHARE of them. Their rows, and rows with a null key, are dealt by `spread`, the
    others meet their group in a shuffled join.
    """
    values = [c for c in groups.columns if c != key]
    most = max(total // HOT_SHARE, 100)
    hot = groups.where(F.col(size) > most).select(key, *[F.col(c).alias(f"__hot_{c}") for c in values])
    # the salt of the cold side is 0, but no literal, which would leave the join's keys
    cold = groups.where(F.col(size) <= most).select(key, *[F.col(c).alias(f"__cold_{c}") for c in values], F.pmod(F.col(size).cast("long"), F.lit(1)).alias("__salt"))
    salt = F.when(F.col(f"__hot_{size}").isNotNull() | F.col(key).isNull(), F.xxhash64(spread).bitwiseOR(1)).otherwise(0)
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).join(cold, [key, "__salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])


def joined_in_blocks(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], part: int = PART) -> DataFrame:
    """Inner join on a key, whose rows are cut into parts of about `part` rows on each side; every part of the left meets
    every part of the right in a task of its own, so no task joins more than two parts, however hot a key is.

    spread: columns of the left and of the right that tell rows of one key apart. The sides are read twice, so they
    should be written tables. Rows with a null key have no partner.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("__l")).join(right.groupBy(key).agg(F.count("*").alias("__r")), key)
    plan = sizes.where((F.col("__l") > part) | (F.col("__r") > part)).select(key, F.ceil(F.col("__l") / part).cast("int").alias("__parts_l"), F.ceil(F.col("__r") / part).cast("int").alias("__parts_r"), "__l", "__r")
    if plan.isEmpty():  # no key is hot: each side moves once
        return left.join(right, key)

    def cut(side: DataFrame, mine: str, own: str, other: str, by: str) -> DataFrame:
        total = side.count()
        rows = attached(side, plan.select(key, f"__parts_{mine}", f"__parts_{other}", f"__{mine}"), key, f"__{mine}", total, F.col(by))
        own_part = F.coalesce(F.pmod(F.xxhash64(by), F.col(f"__parts_{mine}")).cast("int"), F.lit(0))
        others = F.coalesce(F.sequence(F.lit(0), F.col(f"__parts_{other}") - 1), F.array(F.lit(0)))
        return rows.withColumns({f"__{own}": own_part, f"__of_{own}": F.explode(others)}).drop(f"__parts_{mine}", f"__parts_{other}", f"__{mine}")

    a = cut(left.where(F.col(key).isNotNull()), "l", "a", "r", spread[0]).withColumnRenamed("__of_a", "__b")
    b = cut(right.where(F.col(key).isNotNull()), "r", "b", "l", spread[1]).withColumnRenamed("__of_b", "__a")
    return a.join(b, [key, "__a", "__b"]).drop("__a", "__b")
