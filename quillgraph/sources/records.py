"""Files of records as DataFrames. Values stay strings: nothing is inferred."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..storage import checkpointed

# The columns of the gene association format.
GAF_COLUMNS = (
    "db", "db_object_id", "db_object_symbol", "qualifier", "go_id", "db_reference", "evidence_code", "with_or_from", "aspect",
    "db_object_name", "db_object_synonym", "db_object_type", "taxon", "date", "assigned_by", "annotation_extension", "gene_product_form_id",
)
#: A header stands within so many lines.
HEAD = 1_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): all lines with their number from 1 in their file; gzip by name, a byte order mark dropped.

    Large files are read by many tasks: lines are counted within each block, and the blocks' counts, a few numbers
    for each file, give every block its first line's number.
    """
    meta = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = checkpointed(meta.withColumn("__id", F.monotonically_increasing_id()))
    blocks = rows.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("n")).orderBy("file", "__block").collect()
    table, at, last = [], 0, None
    for b in blocks:
        at = at if b.file == last else 0
        table.append((b.file, b["__block"], b["__first"], at))
        at, last = at + b.n, b.file
    starts = spark.createDataFrame(table, "file string, __block long, __first long, __before long")
    numbered = rows.join(F.broadcast(starts), ["file", "__block"]).withColumn("line", F.col("__before") + F.col("__id") - F.col("__first") + 1)
    return numbered.select("file", "line", F.when(F.col("line") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("value"))


def _columns(value: Column, names: Sequence[str], sep: str = "\t") -> list[Column]:
    parts = F.split(value, f"\\Q{sep}\\E", -1)
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file with one JSON object a line (gzip too), under a given schema; blank lines are left out.

    A line that is not strict JSON (a repeated key, NaN) is an error.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(~blank("value"))
    checked = F.when(blank("value") | F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not strict JSON: "), F.left("value", F.lit(80)))))
    return rows.select(F.from_json(checked.cast("string"), schema).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Objects of a file that holds one JSON array, or an object with the array under a key."""
    whole = spark.read.text(path, wholetext=True)
    items = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>"
    kind = items if key is None else f"struct<{key}:{items}>"
    parsed = F.from_json("value", kind)
    return whole.select(F.explode(parsed if key is None else parsed[key]).alias("r")).select("r.*")


def commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV file with # lines before its header; a # line that has a tab is the header itself.

    Other # lines and blank ones are left out; empty values stay. A file without a header is an error.
    """
    text = spark.read.text(path)
    header = next((r.value for r in text.take(HEAD) if r.value.strip() and (not r.value.startswith("#") or "\t" in r.value)), None)
    if header is None:
        raise ValueError(f"{path} has no header within {HEAD} lines")
    rows = text.where(~blank("value") & ~F.col("value").startswith("#") & (F.col("value") != header))
    return rows.select(*_columns(F.col("value"), header.lstrip("#").strip().split("\t")))


def delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A file with a header and any delimiter; all columns are strings."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False)


def named(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """A file without header under given names; missing values are null, further ones are left out."""
    return spark.read.text(path).where(F.col("value") != "").select(*_columns(F.col("value"), names, sep))


def after_preamble(spark: SparkSession, path: str, skip: int, sep: str = ",", separators: int = 1, footer: str | None = None) -> DataFrame:
    """An export with `skip` lines before its header, `separators` lines after it, and a footer line with all below.

    A row with another number of fields than the header is an error.
    """
    rows = lines(spark, path)
    header = rows.where(F.col("line") == skip + 1).first()
    if header is None:
        raise ValueError(f"{path} has no line {skip + 1}")
    names = [n.strip().strip('"') for n in header.value.split(sep)]
    body = rows.where((F.col("line") > skip + 1 + separators) & ~blank("value"))
    end = None
    if footer is not None:
        end = body.where(F.col("value").startswith(footer)).agg(F.min("line")).first()[0]
        body = body if end is None else body.where(F.col("line") < end)
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "mode": "PERMISSIVE"})
    width = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), f"\\Q{sep}\\E", -1))
    outside = (F.col("line") <= skip + 1 + separators) | blank("value") | (F.lit(False) if end is None else F.col("line") >= end)
    checked = F.when(outside | (width == len(names)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(f" does not have {len(names)} fields"))))
    return body.withColumn("value", checked.cast("string")).select(fields.alias("r")).select("r.*")


def associations(spark: SparkSession, path: str) -> DataFrame:
    """Gene association rows (17 columns); comments (!) and shorter rows are left out, NOT qualifiers stay."""
    rows = spark.read.text(path).where(~F.col("value").startswith("!") & (F.size(F.split("value", "\t", -1)) >= len(GAF_COLUMNS)))
    return rows.select(*_columns(F.col("value"), GAF_COLUMNS))


def positional(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A report with a declared list of columns, its native columns as an array and its source line.

    A row with fewer columns, or with something in a column that is not declared, is an error.
    """
    parts = F.split("value", "\t", -1)
    good = (F.size(parts) >= len(names)) & F.forall(F.slice(parts, len(names) + 1, 10_000), lambda x: x == "")
    checked = F.when(good | blank("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" does not fit the declared columns"))))
    rows = lines(spark, path).where(~blank("value")).withColumn("value", checked.cast("string"))
    return rows.select(*_columns(F.col("value"), names), F.slice(parts, 1, len(names)).alias("native_columns"), F.col("line").alias("source_line"))


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(stanza, tags) of an OBO file: tags maps each tag to all its values in order; the header's stanza is 'header'."""
    blocks = spark.read.text(path, lineSep="\n[")
    kind = F.regexp_extract("value", r"^\[?([A-Za-z]+)\][ \t]*\r?(?:\n|$)", 1)
    body = F.split(F.regexp_replace("value", r"^\[?[A-Za-z]+\][ \t]*\r?(?:\n|$)", ""), r"\r?\n")
    pairs = F.transform(F.filter(body, lambda x: x.rlike("^[^!:]+:")), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("tag"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("value")))
    rows = blocks.select(F.when(kind == "", "header").otherwise(kind).alias("stanza"), pairs.alias("pairs"))
    tags = F.array_distinct(F.transform("pairs", lambda p: p.tag))
    values = F.transform(tags, lambda t: F.transform(F.filter("pairs", lambda p: p.tag == t), lambda p: p.value))
    return rows.select("stanza", F.map_from_arrays(tags, values).alias("tags"))


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, json): the objects of the one JSON member of each ZIP file; more or fewer members are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [n for n in archive.namelist() if n.endswith(".json")]
                    if len(members) != 1:
                        raise ValueError(f"{where} has {len(members)} JSON members")
                    found = json.loads(archive.read(members[0]))
                found = found if isinstance(found, list) else [found]
                yield pd.DataFrame({"path": where, "position": range(len(found)), "json": [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, position int, json string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# The columns that a phenotype annotation file must have.
HPOA_COLUMNS = ("database_id", "disease_name", "qualifier", "hpo_id", "reference", "evidence", "onset", "frequency")


def phenotype_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a phenotype annotation file with `negated`, `record_id` (a digest) and `line`, equal rows once.

    Missing columns, ids that are not HP:digits and qualifiers other than NOT are errors.
    """
    rows = lines(spark, path).where(~blank("value") & ~F.col("value").startswith("#"))
    header = rows.orderBy("line").first()
    names = header.value.split("\t") if header else []
    if missing := [c for c in HPOA_COLUMNS if c not in names]:
        raise ValueError(f"{path} lacks {missing}")
    body = rows.where(F.col("line") > header.line)
    wide = body.select("line", F.col("value").alias("__raw"), *_columns(F.col("value"), names))
    good = wide["hpo_id"].rlike(r"^HP:\d+$") & wide["qualifier"].isin("", "NOT") & (F.size(F.split("__raw", "\t", -1)) == len(names))
    checked = F.when(good | (F.col("line") <= header.line), F.col("hpo_id")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is malformed"))))
    wide = wide.withColumns({"hpo_id": checked.cast("string"), "negated": F.col("qualifier") == "NOT", "record_id": F.sha2("__raw", 256)})
    first = wide.groupBy("record_id").agg(F.min("line").alias("line"))
    return wide.join(first, ["record_id", "line"]).drop("__raw")
