"""Whether tables that were built again equal the committed ones, as bags of rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Parts of a table whose digests are compared before any rows are.
BUCKETS = 1024


def spelled(rows: DataFrame) -> Column:
    """A row as JSON, columns by name, nulls written out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})


def digests(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, total, mixed): for each part of the rows how many there are, and two sums of their hashes, whatever their
    order. Equal rows are in one part and count each."""
    h = F.xxhash64(spelled(rows))
    hashed = rows.select(h.alias("h"))
    again = F.xxhash64("h", F.lit(7)).cast("decimal(38,0)")
    return hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.sum(again).alias("mixed"))


def row_differences(committed: DataFrame, rebuilt: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(row, times): rows as JSON that one table has more often; times is by how much, above 0 where the rebuilt table has
    more, below where it has less. Tables of other columns differ in every row.

    Only parts with unequal digests are compared row by row, with equal rows summed where they are.
    """
    a, b = (digests(t, buckets).select("bucket", F.struct("n", "total", "mixed").alias(n)) for t, n in ((committed, "a"), (rebuilt, "b")))
    unequal = written(a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket"), "unequal")
    sides = []
    for table, sign in ((committed, -1), (rebuilt, 1)):
        text = table.select(spelled(table).alias("row"))
        some = text.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).join(F.broadcast(unequal), "bucket", "left_semi")  # at most `buckets` rows
        sides.append(some.select("row", F.lit(sign).alias("sign")))
    return sides[0].unionByName(sides[1]).groupBy("row").agg(F.sum("sign").alias("times")).where("times <> 0")


def compared(committed: Mapping[str, DataFrame], rebuilt: Mapping[str, DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """(name, n_committed, n_rebuilt, n_removed, n_added, equal) of every table of either; one that is missing has no rows and
    is never equal."""
    rows = []
    for name in sorted({*committed, *rebuilt}):
        a, b = committed.get(name), rebuilt.get(name)
        known = a if a is not None else b
        both = a is not None and b is not None
        a, b = (t if t is not None else known.limit(0) for t in (a, b))
        times = F.col("times")
        found = row_differences(a, b, buckets).agg(F.coalesce(F.sum(F.when(times < 0, -times)), F.lit(0)).alias("n_removed"), F.coalesce(F.sum(F.when(times > 0, times)), F.lit(0)).alias("n_added"))
        counts = a.agg(F.count("*").alias("n_committed")).join(b.agg(F.count("*").alias("n_rebuilt")))
        equal = F.lit(both) & (F.col("n_removed") == 0) & (F.col("n_added") == 0)
        rows.append(counts.join(found).select(F.lit(name).alias("name"), "n_committed", "n_rebuilt", "n_removed", "n_added", equal.alias("equal")))
    return reduce(DataFrame.unionByName, rows)
