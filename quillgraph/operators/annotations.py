"""Contracts of annotations and predictions, and their strict score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id, same_number, squeezed
from .passages import grounded
from .scoring import covers, match_documents, prf

#: Content fields of an observation that a prediction must repeat.
CONTENT = ("gene", "variant", "sequence_context", "assay", "property", "measurement_type", "value", "unit", "comparator", "conditions", "uncertainty", "sample_size")
NUMBERS = frozenset(("value",))


def without_quotes(spans: str) -> Column:
    """An array of spans without their quotes: unit, start and end stay."""
    return F.transform(spans, lambda s: F.struct(s.unit_id.alias("unit_id"), s.start.alias("start"), s.end.alias("end")))


def units_digest(units: DataFrame) -> DataFrame:
    """(document_id, sha256) of each document's units in order of their ids."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "kind", "locator", "text"))), lambda u: F.to_json(u))
    return units.groupBy("document_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def _found(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def reference_violations(documents: DataFrame, observations: DataFrame, decisions: DataFrame, units: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """(rule, key) of a reference: it covers just its split, its annotators differ, its spans are exact, no observation
    is there twice under another id, and decided cases name observations that exist."""
    wanted = manifest.where(F.col("split") == split).select("document_id")
    spans = observations.select("id", F.explode(F.flatten("evidence_sets")).alias("s")).select("id", "s.*")
    print_ = content_id(F.to_json(F.struct("document_id", *[c for c in CONTENT if c in observations.columns])))
    twice = observations.groupBy(print_.alias("print")).agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    named = decisions.select("case_id", F.explode("observation_ids").alias("id"))
    parts = [
        _found(wanted.join(documents, "document_id", "left_anti"), "not_covered", "document_id"),
        _found(documents.join(wanted, "document_id", "left_anti"), "outside_split", "document_id"),
        _found(documents.where(F.size("annotators") != F.size(F.array_distinct("annotators"))), "same_annotator", "document_id"),
        _found(grounded(spans, units).where("NOT exact"), "span", "id"),
        _found(twice, "repeated_content", "id"),
        _found(decisions.where("label IN ('supports', 'contradicts') AND size(observation_ids) = 0"), "undecided_evidence", "case_id"),
        _found(named.join(observations.select("id"), "id", "left_anti"), "unknown_observation", "case_id"),
    ]
    return reduce(DataFrame.union, parts)


def prediction_violations(predictions: DataFrame, documents: DataFrame, decisions: DataFrame, cases: DataFrame, run: DataFrame) -> DataFrame:
    """(rule, key) of predictions: known documents and cases, allowed labels, and a run with its commit and digests."""
    hexes = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    parts = [
        _found(predictions.join(documents.select("document_id"), "document_id", "left_anti"), "unknown_document", "id"),
        _found(decisions.join(cases.select("case_id"), "case_id", "left_anti"), "unknown_case", "case_id"),
        _found(decisions.where(~F.coalesce(F.col("label").isin("supports", "contradicts", "unresolved", "abstain"), F.lit(False))), "label", "case_id"),
        _found(run.where(~hexes("code_commit", 40)), "code_commit", "id"),
        _found(run.where(~hexes("prompt_sha256", 64) | ~hexes("configuration_sha256", 64)), "digest", "id"),
    ]
    return reduce(DataFrame.union, parts)


def cell_coverage(cells: DataFrame, observations: DataFrame) -> DataFrame:
    """(document_id, table_id, row, column, problem): cells in scope without an observation or with several, and
    observations of cells out of scope."""
    key = ["document_id", "table_id", "row", "column"]
    used = observations.where(F.col("table_id").isNotNull()).groupBy(*key).agg(F.count("*").alias("n"))
    rows = cells.select(*key, F.lit(True).alias("__cell")).join(used, key, "full")
    problem = F.when(F.col("__cell").isNull(), "out_of_scope").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several")
    return rows.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def agrees(field: str, a: Column, b: Column) -> Column:
    """Equality of one content field: numbers as numbers, strings without regard to white space, nulls as nulls."""
    return same_number(a, b) if field in NUMBERS else squeezed(a).eqNullSafe(squeezed(b))


def acceptable(predictions: DataFrame, references: DataFrame, evidence: bool = True) -> DataFrame:
    """(document_id, prediction, reference) of pairs in a document that agree in all content fields and, if asked for,
    whose predicted spans cover one of the reference's sets of spans. Content columns are strings."""
    a = predictions.select("document_id", F.col("id").alias("prediction"), F.col("evidence").alias("__spans"), *[F.col(c).alias(f"a_{c}") for c in CONTENT])
    b = references.select("document_id", F.col("id").alias("reference"), F.col("evidence_sets").alias("__sets"), *[F.col(c).alias(f"b_{c}") for c in CONTENT])
    rows = a.join(b, "document_id")
    for c in CONTENT:
        rows = rows.where(agrees(c, F.col(f"a_{c}"), F.col(f"b_{c}")))
    if evidence:
        rows = rows.where(covers(F.col("__spans"), F.col("__sets")))
    return rows.select("document_id", "prediction", "reference")


def strict_score(predictions: DataFrame, references: DataFrame, evidence: bool = True) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) under a greatest matching of acceptable pairs within each document."""
    matched = match_documents(acceptable(predictions, references, evidence), "document_id", "prediction", "reference").agg(F.count("*").alias("tp"))
    p, g = predictions.agg(F.count("*").alias("p")), references.agg(F.count("*").alias("g"))
    rows = matched.join(F.broadcast(p)).join(F.broadcast(g)).select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    return rows.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
