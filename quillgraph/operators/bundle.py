"""Graphs made from curated tables and by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..schema import CLAIMS, COVERAGE, EVIDENCE, NODES, SOURCES, EvidenceGraph
from .audit import first_rows
from .passages import grounded


def _shaped(rows: DataFrame, schema: str, order: list[str]) -> DataFrame:
    """rows with the columns of a schema; missing ones are null, ord follows from the content's order."""
    out = []
    for field in schema.split(", "):
        name, kind = field.split(" ", 1)
        if name == "ord":
            out.append(F.xxhash64(*order).alias("ord"))
        else:
            out.append((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name))
    return rows.select(*out)


def from_annotations(rows: DataFrame, source: dict[str, object]) -> EvidenceGraph:
    """A graph of phenotype annotations (records.phenotype_annotations): diseases, phenotypes, a claim and a piece of
    evidence for each distinct record, and one coverage row for each disease.

    A negated annotation is a negated claim with supporting evidence. Ids are digests of what they stand for.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"claim_id": F.concat(F.lit("claim:"), F.left("record_id", F.lit(20)))})
    diseases = rows.groupBy(F.col("database_id").alias("id")).agg(F.min("disease_name").alias("label")).withColumn("type", F.lit("Disease"))
    phenotypes = rows.select(F.col("hpo_id").alias("id")).distinct().withColumns({"label": F.col("id"), "type": F.lit("Phenotype")})
    nodes = diseases.select("id", "type", "label").unionByName(phenotypes.select("id", "type", "label"))
    claims = rows.select(F.col("claim_id").alias("id"), F.col("database_id").alias("subject"), F.lit("HAS_PHENOTYPE").alias("predicate"), F.col("hpo_id").alias("object"), F.lit("reported").alias("assertion_type"), "negated")
    evidence = rows.select(F.concat(F.lit("evidence:"), F.left("record_id", F.lit(20))).alias("id"), "claim_id", F.lit(source["id"]).alias("source_id"), F.concat(F.lit("line "), F.col("line").cast("string")).alias("locator"), F.concat_ws(" | ", "reference", "evidence", "onset", "frequency").alias("excerpt"), F.lit("supports").alias("stance"), F.lit("machine_checked").alias("review_status"))
    coverage = diseases.select(F.concat(F.lit("coverage:"), content_id("id", 20)).alias("id"), F.lit(source["id"]).alias("source_id"), F.col("id").alias("entity_id"), F.lit("phenotypes").alias("scope"), F.lit("searched").alias("status"), F.lit(source["retrieved_at"]).alias("searched_at"))
    sources = spark.createDataFrame([(source["id"], source["title"], source["url"], "database", source["retrieved_at"], False, source["license"])], "id string, title string, url string, kind string, retrieved_at string, synthetic boolean, license string")
    return EvidenceGraph(_shaped(nodes, NODES, ["id"]), _shaped(sources, SOURCES, ["id"]), _shaped(claims, CLAIMS, ["id"]), _shaped(evidence, EVIDENCE, ["id"]), _shaped(coverage, COVERAGE, ["id"]))


def synthetic(spark: SparkSession, communities: int = 8, diseases: int = 20, mechanisms: int = 4) -> EvidenceGraph:
    """A graph by rule, of any size: communities of diseases with a variant each that share mechanisms in a ring."""
    n = communities * diseases
    ids = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % communities).alias("c"))
    mechanism = F.concat_ws("-", F.lit("mechanism"), "c", ((F.col("i") / communities).cast("long") % mechanisms).cast("string"))
    linked = F.concat_ws("-", F.lit("mechanism"), ((F.col("c") + 1) % communities).cast("string"), F.lit("0"))
    name = lambda kind: F.concat_ws("-", F.lit(kind), F.col("i").cast("string"))
    effect = F.when(F.col("i") % 5 == 0, "gain_of_function").when(F.col("i") % 7 == 0, "unknown").otherwise("loss_of_function")
    one = lambda kind, subject, predicate, object_, effect=None: ids.select(F.concat_ws(":", F.lit(kind), "i").alias("id"), subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), (effect if effect is not None else F.lit(None).cast("string")).alias("effect"))
    claims = one("v", name("disease"), "HAS_VARIANT", name("variant")).union(one("e", name("variant"), "HAS_EFFECT", mechanism, effect)).union(one("r", name("variant"), "HAS_EFFECT", linked, effect).where(F.expr("CAST(substring(id, 3) AS BIGINT) % 10 = 0")))
    claims = claims.withColumns({"assertion_type": F.lit("reported"), "negated": F.lit(False), "species": F.lit("model"), "tissue": F.lit("whole"), "stage": F.lit("adult")})
    evidence = claims.select(F.concat(F.lit("ev:"), "id").alias("id"), F.col("id").alias("claim_id"), F.lit("generator").alias("source_id"), F.lit("rule").alias("locator"), F.lit("by rule").alias("excerpt"), F.lit("supports").alias("stance"), F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, "unreviewed").otherwise("machine_checked").alias("review_status"))
    nodes = ids.select(name("disease").alias("id"), F.lit("Disease").alias("type")).union(ids.select(name("variant"), F.lit("Variant"))).union(claims.where("predicate = 'HAS_EFFECT'").select("object", F.lit("Mechanism")).distinct()).withColumn("label", F.col("id"))
    sources = spark.createDataFrame([("generator", "rule", "https://example.org/rule", "fixture", "2024-01-01", True, "none")], "id string, title string, url string, kind string, retrieved_at string, synthetic boolean, license string")
    return EvidenceGraph(_shaped(nodes, NODES, ["id"]), _shaped(sources, SOURCES, ["id"]), _shaped(claims, CLAIMS, ["id"]), _shaped(evidence, EVIDENCE, ["id"]))


def accept_proposals(graph: EvidenceGraph, proposals: DataFrame, units: DataFrame) -> tuple[EvidenceGraph, DataFrame]:
    """The graph with the grounded proposals, and the rejected ones.

    proposals: (claim_id, source_id, unit_id, start, end, quote). A proposal whose quote is not just what its unit has
    there is rejected; one that is there already (same content) changes nothing.
    """
    checked = grounded(proposals, units)
    good = first_rows(checked.where("exact").withColumn("id", F.concat(F.lit("evidence:"), content_id(F.concat_ws("|", "claim_id", "source_id", "unit_id", F.col("start").cast("string"), F.col("end").cast("string"), "quote"), 24))), ["id"], ["claim_id"])
    good = good.select("id", "claim_id", "source_id", F.concat_ws(":", "unit_id", F.col("start").cast("string"), F.col("end").cast("string")).alias("locator"), F.col("quote").alias("excerpt"), F.lit("supports").alias("stance"), F.lit("unreviewed").alias("review_status"))
    new = _shaped(good, EVIDENCE, ["id"]).join(graph.evidence.select("id"), "id", "left_anti")
    return EvidenceGraph(graph.nodes, graph.sources, graph.claims, graph.evidence.unionByName(new), graph.coverage), checked.where("NOT exact")
