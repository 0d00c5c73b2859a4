"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions run here. Texts are equal when identical after lower-casing A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, any_names, ascii_lower, attach, key_filter, may_hold, stage

#: Characters that the second step hashes.
PREFIX = 128


def content_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def _shared(rows: DataFrame, keys: list[str], flag: str, among: DataFrame, name: str) -> DataFrame:
    """rows with a flag that is true for all whose keys more than one row of `among` has, and for a few others.

    The keys are looked up in a filter of bounded size, so rows need not move, however many keys there are.
    """
    found = among.groupBy(*keys).count().where("count > 1").select(F.xxhash64(*keys).alias("h"))
    return may_hold(rows, key_filter(stage(found, name)), F.xxhash64(*keys), flag)


@any_names
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with keep_id, group_size and kept.

    keep_id is the largest id of the rows with an equal text, kept says whether the row has it.
    Step 1 groups by length in bytes; step 2 hashes the first PREFIX characters of rows whose length is shared;
    step 3 reads in full only the rows whose length and prefix hash are shared. Only these meet in a shuffle, by their
    full hash; the others do not move.

    Null text counts as empty. A null id never wins against another; if all ids of a group are null, its keep_id is
    null and its rows are kept. Repeated rows with the same id count each in group_size and are kept together.
    Columns named keep_id, group_size or kept are replaced. An empty table gives an empty table.
    """
    n_bytes, prefix, full, by_len, by_prefix = f"{P}bytes", f"{P}prefix", f"{P}full", f"{P}by_len", f"{P}by_prefix"
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept")]
    rows = docs.select(*columns).withColumn(n_bytes, F.octet_length(text))
    rows = _shared(rows, [n_bytes], by_len, rows, "lengths")
    rows = rows.withColumn(prefix, F.when(F.col(by_len), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX)))))
    rows = _shared(rows, [n_bytes, prefix], by_prefix, rows.where(by_len), "prefixes")
    left = F.col(by_len) & F.col(by_prefix)
    hashed = rows.where(left).withColumn(full, content_hash(text))
    groups = stage(hashed.groupBy(full).agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hashed = attach(hashed.select(*columns, full), groups, full, "group_size", total, F.col(id_col))
    many = F.col("group_size").isNotNull()
    met = hashed.select(*columns, F.when(many, F.col("keep_id")).otherwise(F.col(id_col)).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    alone = rows.where(~left).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(met).withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col)))
