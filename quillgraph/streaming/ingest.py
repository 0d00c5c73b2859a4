"""Ordered ingest that resumes: batches go out in rounds of tasks, and their acknowledgements are kept as a table.

What counts after an interruption is the greatest unbroken run of acknowledged batches from the first on. Batches behind
it are sent again, so the receiver must take a row with a known id as the same row (an upsert).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.passages import greedy_batches
from ..operators.select import differences
from ..operators.spread import dealt
from ..storage import written

#: Takes the rows of a batch, in order, and returns the receiver's token for it; what it raises fails the batch.
Send = Callable[[list[dict]], str]

ACKS = "export string, batch long, n long, token string, error string, round long"
MOST_ROW, MOST_BATCH, MOST_ROWS = 64 << 10, 1 << 20, 100


class Interrupted(RuntimeError):
    """Some batches failed; those before the first of them are kept."""


def in_batches(rows: DataFrame, order: str, most_row: int = MOST_ROW, most_bytes: int = MOST_BATCH, most_rows: int = MOST_ROWS) -> DataFrame:
    """rows with `batch`, numbered from 0 in order: at most most_rows rows and most_bytes bytes of their JSON each.

    A row over most_row bytes is an error when the plan runs. `order` is unique. Nulls are left out of the JSON.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    checked = F.when(size <= most_row, size).otherwise(F.raise_error(F.concat(F.lit(f"a row has over {most_row} bytes: "), F.col(order).cast("string"))).cast("int"))
    sized = rows.withColumns({"__size": checked, "__one": F.lit(1)})
    return greedy_batches(sized, "__one", order, "__size", most_bytes, most_rows).drop("__size", "__one")


def contiguous(acks: DataFrame, keys: Sequence[str], batch: str, parts: int | None = None) -> DataFrame:
    """(keys, acknowledged): how many batches from number 0 on are acknowledged without a gap, for each of the keys.

    The first that lacks is the least successor (or 0) that is no batch itself, so no group is sorted in one task.
    Repeated acknowledgements count once, null batches do not. parts: how many parts numbers are dealt into (see
    spread.dealt).
    """
    number = F.col(batch).cast("long")
    both = F.array(F.struct(number.alias("__number"), F.lit(True).alias("__done")), F.struct((number + 1).alias("__number"), F.lit(False).alias("__done")))
    numbers = dealt(acks.select(*keys, F.explode(both).alias("__n")).select(*keys, "__n.*"), parts, *keys, "__number")
    each = numbers.groupBy(*keys, "__number").agg(F.bool_or("__done").alias("__done"))
    ends = F.min(F.when(~F.col("__done") & (F.col("__number") >= 0), F.col("__number")))
    begun = F.bool_or(F.col("__done") & (F.col("__number") == 0))
    return each.groupBy(*keys).agg(F.when(begun, ends).otherwise(0).alias("acknowledged"))


def digest(export: DataFrame) -> str:
    """A name of the rows of an export, whatever their order."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(export.columns))))
    found = export.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("x")).first()
    return f"{found.n}-{found.s or 0}-{found.x or 0}"


def _sent(rows: DataFrame, send: Send, order: str, export: str, number: int) -> DataFrame:
    """The acknowledgements of the batches of rows; a batch is a task's run of sorted rows."""
    columns = [c for c in rows.columns if c != "batch"]
    schema = pa.schema([("export", pa.string()), ("batch", pa.int64()), ("n", pa.int64()), ("token", pa.string()), ("error", pa.string()), ("round", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: int, held: list[dict]) -> pa.RecordBatch:
            try:
                token, error = send(held), None
            except Exception as e:  # noqa: BLE001 - whatever the receiver's client raises
                token, error = None, f"{type(e).__name__}: {e}"[:2000]
            return pa.RecordBatch.from_pylist([{"export": export, "batch": batch, "n": len(held), "token": token, "error": error, "round": number}], schema)

        now, held = None, []
        for part in parts:
            for row in part.to_pylist():
                if row["batch"] != now and held:
                    yield one(now, held)
                    held = []
                now = row["batch"]
                held.append({c: row[c] for c in columns})
        if held:
            yield one(now, held)

    return rows.repartition("batch").sortWithinPartitions("batch", order).mapInArrow(run, ACKS)


def acknowledgements(spark: SparkSession, root: str) -> DataFrame:
    """All acknowledgements kept under a folder, failed ones too; an empty table before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/acks")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ACKS)
    return spark.read.schema(ACKS).parquet(f"{root}/acks")


def ingest(export: DataFrame, send: Send, order: str, root: str, at_once: int = 64) -> int:
    """Send the batches of an export (see in_batches) in order of rounds of `at_once`; the number of batches sent now.

    Acknowledgements are appended to root/acks after each round. A folder belongs to one export: other rows are an error.
    When batches fail, the round's acknowledgements are kept and Interrupted is raised; the next call goes on after the
    greatest unbroken run. A call after the last batch sends nothing. An empty export sends nothing.
    """
    spark = export.sparkSession
    export = written(export, "export")
    name, kept = digest(export), acknowledgements(spark, root)
    if not (other := kept.where(F.col("export") != name).limit(1)).isEmpty():
        raise ValueError(f"the folder belongs to another export: {other.first().export}")
    found = export.agg(F.max("batch").alias("last")).first()
    total, last_round = 0 if found.last is None else found.last + 1, (kept.agg(F.max("round").alias("r")).first().r or 0)
    good = contiguous(kept.where("error IS NULL"), [], "batch").first()
    start, sent = (good.acknowledged if good and good.acknowledged is not None else 0), 0
    while start < total:
        last_round += 1
        some = export.where((F.col("batch") >= start) & (F.col("batch") < start + at_once))
        _sent(some, send, order, name, last_round).write.mode("append").parquet(f"{root}/acks")
        this = acknowledgements(spark, root).where(F.col("round") == last_round)
        failed = this.where("error IS NOT NULL").orderBy("batch").first()
        sent += this.where("error IS NULL").count()
        if failed:
            raise Interrupted(f"batch {failed.batch}: {failed.error}")
        start += at_once
    return sent


def read_back(export: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """(key, change) of rows that the receiver lacks or has otherwise; rows that only it has are no difference."""
    rows = export.drop("batch")
    return differences(rows, received.select(*rows.columns), key).where("change <> 'added'")


def ordered(send: Send, order: str, root: str, at_once: int = 64, **bounds: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that ingests each micro-batch in order; one that is run again goes on where it broke off."""

    def write(batch: DataFrame, number: int) -> None:
        ingest(in_batches(batch, order, **bounds), send, order, f"{root}/epoch={number}", at_once)

    return write
