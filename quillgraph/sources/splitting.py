"""Large XML documents cut into the children of their root by many tasks.

A file is read as rows that end at `>`, so it splits like any text. The depth of each row is the number of tags opened and
not closed before it, which sums over sorted parts give; rows of one child are then put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import carried, numbered
from ..operators.spread import attached
from ..storage import written

ORDER = ["file", "block", "at"]


def _tag() -> Column:
    """What stands behind the last < of a row, without comments, sections and declarations."""
    return F.when(F.col("value").contains("<"), F.regexp_extract("value", r"(?s)<([^<]*)$", 1))


def root_children(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, xml) of each child of the root of every file under a path, numbered from 1 in each file.

    xml is a document of its own: what stands before the root, the root's opening tag, the child, and the closing tag, so
    that names, prefixes and entities mean what they do in the file. Text, comments and declarations between children are
    left out; a child with text alone is not one. No task holds more than one child and what stands before the root, which
    is small.

    Comments and CDATA sections may hold > and tags. Files are well-formed XML in UTF-8 or ASCII; one whose tags do not add
    up (as with a > in an attribute's value, which no XML writer leaves) is an error when the plan is made.
    """
    text = spark.read.option("lineSep", ">").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows.withColumn("place", F.struct("block", "at")), "rows")
    value = F.col("value")
    opens = F.when(value.contains("<!--") & ~value.endswith("--"), "comment").when(value.contains("<![CDATA[") & ~value.endswith("]]"), "section")
    marked = carried(rows, "file", "place", state=opens.otherwise(F.when(value.endswith("--") | value.endswith("]]"), "")))
    inside = F.coalesce(F.col("state"), F.lit("")) != ""
    tag = _tag()
    aside = inside | value.contains("<!--") | value.contains("<![CDATA[") | tag.startswith("!") | tag.startswith("?")
    plain = tag.isNotNull() & ~F.coalesce(aside, F.lit(False))
    close, empty = plain & tag.startswith("/"), plain & tag.endswith("/")
    opened = plain & ~close & ~empty
    kinds = marked.select("value", *ORDER, opened.alias("open"), close.alias("close"), empty.alias("empty"))
    deep = written(numbered(kinds, ORDER, opened=F.col("open"), closed=F.col("close")).withColumn("after", F.col("opened") - F.col("closed")), "depths")
    wrong = deep.groupBy("file").agg((F.count_if("open") - F.count_if("close")).alias("left"), F.min("after").alias("least"), F.count_if(F.col("open") & (F.col("after") == 1)).alias("roots"))
    if not (bad := wrong.where("left <> 0 OR least < 0 OR roots > 1").limit(3)).isEmpty():
        raise ValueError("tags do not add up in " + ", ".join(r.file for r in bad.collect()))
    before = F.col("after") - F.col("open").cast("int") + F.col("close").cast("int")
    starts = (before == 1) & (F.col("open") | F.col("empty"))
    counted = numbered(deep.withColumns({"before": before, "starts": starts}), ORDER, record=F.col("starts"))
    # the sums go over all files; what a file begins with is what its first row, which no child can be, has
    first = counted.groupBy("file").agg(F.min("record").alias("__records"), F.min(F.col("opened") - F.col("open").cast("int")).alias("__opened"), F.count("*").alias("__rows"))
    first = written(first, "files")
    piece = F.when(F.col("starts"), F.concat(F.lit("<"), _tag())).otherwise(value)
    inner = counted.where((F.col("before") > 1) | F.col("starts"))
    place = F.struct("block", "at", F.concat(piece, F.lit(">")).alias("piece"))
    children = inner.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: p.piece), "").alias("child"))
    since = F.col("opened") - F.col("__opened")
    head = attached(deep, first, "file", "__rows", deep.count(), F.col("at")).where((since == 0) | (F.col("open") & (since == 1)))
    head = head.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", F.concat("value", F.lit(">")).alias("piece")))), lambda p: p.piece), "").alias("head"))
    root = F.regexp_extract("head", r"(?s)<([^\s<>/!?]+)[^<]*>$", 1)
    head = head.select("file", F.regexp_replace("head", r"^\s*<\?xml[^>]*\?>", "").alias("head"), root.alias("root")).join(first, "file")
    children = written(children, "children")
    whole = attached(children, head, "file", "__rows", deep.count(), F.col("record"))  # files of many rows have their heads broadcast
    return whole.select("file", (F.col("record") - F.col("__records")).alias("record"), F.concat("head", "child", F.lit("</"), "root", F.lit(">")).alias("xml"))
