"""What the operators of this subpackage share: work folders, skew-safe lookups, text batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that columns of the input never clash with them.
P = "__qg_"
#: A key is hot when it holds more than one row in HOT_SHARE, or more than HOT_ROWS rows; so there are at most
#: HOT_SHARE + rows / HOT_ROWS hot keys.
HOT_SHARE, HOT_ROWS = 1000, 1_000_000
#: Rows of a key that share one copy of what is attached to it, where that is large.
COPY_ROWS = 2000
#: Bits of a key filter: so many for each key, and at most so many (32 MB).
KEY_BITS, MOST_BITS = 32, 1 << 28
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share.

    Only where a local session names none (as in tests) a folder of this machine is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillgraph/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join rows with groups, which has one row for each key and the number of its rows in `size`.

    Hot keys (see HOT_SHARE) are broadcast, so what groups hold should be small; their rows and rows with a null key are
    then dealt by `spread` instead of the key, so no task of the shuffled join gets a hot group. Rows whose key is null or
    has no group get nulls; repeated rows stay; columns of rows that groups have too are replaced; empty sides are fine.
    """
    # the cold side's salt is 0 but no literal: a literal would drop out of the join's keys, and hot rows meet again
    values = [c for c in groups.columns if c != key]
    most = max(min(total // HOT_SHARE, HOT_ROWS), 100)
    hot = groups.where(F.col(size) > most).select(key, *[F.col(c).alias(f"{P}hot_{c}") for c in values])
    cold = groups.where(F.col(size) <= most).select(key, *[F.col(c).alias(f"{P}cold_{c}") for c in values], F.pmod(F.col(size).cast("long"), F.lit(1)).alias(f"{P}salt"))
    salt = F.when(F.col(f"{P}hot_{size}").isNotNull() | F.col(key).isNull(), F.xxhash64(spread).bitwiseOR(1)).otherwise(0)
    joined = rows.join(F.broadcast(hot), key, "left").withColumn(f"{P}salt", salt).join(cold, [key, f"{P}salt"], "left")
    kept = [c for c in rows.columns if c not in values]
    return joined.select(*kept, *[F.coalesce(f"{P}hot_{c}", f"{P}cold_{c}").alias(c) for c in values])


def attach_copies(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Inner join of rows with groups as in attach, without `size`, for groups that hold much: nothing of them is broadcast.

    A group goes out in a copy for each COPY_ROWS of its rows, which are dealt to the copies by `spread`. Rows whose key is
    null or has no group are left out; repeated rows stay; empty sides give an empty table.
    """
    copies, salt = F.ceil(F.col(size) / COPY_ROWS).cast("int"), f"{P}copy"
    counted = attach(rows, groups.select(key, size), key, size, rows.count(), spread)
    dealt = counted.withColumn(salt, F.pmod(F.xxhash64(spread), copies).cast("int")).drop(size)
    return dealt.join(groups.withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1))).drop(size), [key, salt]).drop(salt)


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps of a table of 64-bit hashes `h`, and their number of bits, for may_hold.

    They take KEY_BITS bits a key and at most MOST_BITS, whatever the number of keys; with very many keys more rows that
    are none of them pass, but never fewer that are. Repeated hashes count once, a null hash is none; without keys nothing
    passes.
    """
    bits = BITMAP
    while bits < min(keys.count() * KEY_BITS, MOST_BITS):
        bits *= 2
    at = F.pmod(F.col("h"), F.lit(bits)) + 1
    maps = keys.select(F.bitmap_bucket_number(at).alias(f"{P}bucket"), F.bitmap_bit_position(at).alias("bit"))
    return stage(maps.groupBy(f"{P}bucket").agg(F.bitmap_construct_agg("bit").alias(f"{P}map")), "key_filter"), bits


def may_hold(rows: DataFrame, keys: tuple[DataFrame, int], h: Column, flag: str) -> DataFrame:
    """rows with a boolean `flag`: true for all whose hash h is in the key filter, and for a few others."""
    at = F.pmod(h, F.lit(keys[1])) + 1
    rows = rows.withColumn(f"{P}bucket", F.bitmap_bucket_number(at)).join(F.broadcast(keys[0]), f"{P}bucket", "left")
    bit = F.bitmap_bit_position(at)
    byte = F.ascii(F.decode(F.substring(f"{P}map", F.floor(bit / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    held = F.getbit(byte.cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1
    return rows.withColumn(flag, F.coalesce(held, F.lit(False))).drop(f"{P}bucket", f"{P}map")


def tidy(run: Callable) -> Callable:
    """A batch function that gives memory back to the system when its task ends, as workers go on to other tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def any_names(operator: Callable) -> Callable:
    """An operator whose first argument, and result, may have columns with dots or backticks in their names."""

    @functools.wraps(operator)
    def named(docs: DataFrame, *args, **options) -> DataFrame:
        odd = {c: f"{P}named_{i}" for i, c in enumerate(docs.columns) if "." in c or "`" in c}
        if not odd:
            return operator(docs, *args, **options)
        back = {safe: c for c, safe in odd.items()}
        found = operator(docs.toDF(*[odd.get(c, c) for c in docs.columns]), *args, **options)
        return found.toDF(*[back.get(c, c) for c in found.columns])

    return named


def rebatch(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about most_bytes at most (a single longer row is a batch of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
