"""Structured Streaming counterparts: an idempotent inbox, page arrivals with the last write kept, trailing counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CODES = "request_id string, order long, code int"


def submission_codes(stream: DataFrame, request: str, fingerprint: str, order: str) -> DataFrame:
    """(request_id, order, code) of a stream of submissions: 201 the first of a request, 200 the same again, 409 other
    content. The state of a request is the fingerprint that was first accepted."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("order")
        codes = []
        for content in rows["fingerprint"]:
            codes.append(201 if accepted is None else 200 if content == accepted else 409)
            accepted = content if accepted is None else accepted
        state.update((accepted,))
        yield pd.DataFrame({"request_id": key[0], "order": rows["order"], "code": codes})

    rows = stream.select(F.col(request).cast("string").alias("request_id"), F.coalesce(F.col(fingerprint).cast("string"), F.lit("")).alias("fingerprint"), F.col(order).cast("long").alias("order"))
    return rows.groupBy("request_id").applyInPandasWithState(run, CODES, "accepted string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n) over sliding windows; rows later than the watermark are left out."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = rows.groupBy(F.window("__ts", width, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upsert(path: str, key: str, order: str):
    """A foreachBatch function that keeps the last write of each key in a Parquet table of versions.

    Each batch writes a new version (path/v=<batch>) from the one before and its own rows; a batch that is run again
    writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}").unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write
