"""A whole graph in one JSON file, read strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import blank, iso_date
from ..schema import EvidenceGraph

VERSION = "1.0"
CONTEXT = ("effect", "negated", "species", "tissue", "stage")


def _items(fields: str) -> str:
    return "array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ") if not f.startswith("ord ")) + ">>"


def strict_json(text: Column) -> Column:
    """The text itself if it is JSON without repeated keys, NaN or infinity, else an error."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.raise_error(F.lit("not strict JSON")).cast("string"))


def read_bundle(spark: SparkSession, path: str) -> tuple[EvidenceGraph, DataFrame]:
    """The graph of a bundle file and its one-row dataset (id, title, description, synthetic, created_at, version).

    Collections keep their order in `ord`. A claim's context gives its effect, negated, species, tissue and stage;
    properties and further context stay JSON. The file is one JSON text, so one task reads it; its rows are then dealt.
    """
    claims = "id string, subject string, predicate string, object string, assertion_type string, context string, extraction_confidence double"
    kinds = {"nodes": schema.NODES, "sources": schema.SOURCES, "claims": "ord long, " + claims, "evidence": schema.EVIDENCE, "coverage": schema.COVERAGE}
    whole = spark.read.text(path, wholetext=True).select(strict_json(F.col("value")).alias("value"))
    shape = "struct<schema_version:string, dataset:struct<id:string, title:string, description:string, synthetic:boolean, created_at:string>, " + ", ".join(f"{k}:{_items(v)}" for k, v in kinds.items()) + ">"
    parsed = whole.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("b"))

    def table(name: str) -> DataFrame:
        rows = parsed.select(F.posexplode(f"b.{name}").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), "r.*")
        if name == "claims":
            get = lambda key: F.get_json_object("context", f"$.{key}")
            rows = rows.select("ord", "id", "subject", "predicate", "object", "assertion_type", get("effect").alias("effect"), get("negated").try_cast("boolean").alias("negated"), *[get(d).alias(d) for d in CONTEXT[2:]], F.col("extraction_confidence").alias("confidence"))
        return rows

    graph = EvidenceGraph(*[table(k) for k in kinds])
    return graph, parsed.select("b.dataset.*", F.col("b.schema_version").alias("version"))


def dataset_violations(dataset: DataFrame) -> DataFrame:
    """(path, rule, key) of a bundle's one-row dataset."""
    rules = {"version": F.coalesce(F.col("version") == VERSION, F.lit(False)), "title": ~blank("title"), "description": ~blank("description"), "synthetic": F.col("synthetic").isNotNull(), "created_at": F.coalesce(iso_date("created_at"), F.lit(False))}
    found = F.filter(F.array(*[F.when(~rule, name) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return dataset.select(F.lit("dataset").alias("path"), F.explode(found).alias("rule"), F.col("id").alias("key"))
