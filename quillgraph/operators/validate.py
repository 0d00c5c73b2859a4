"""Constraints as queries that produce violations: (path, rule, key). A graph is valid if they produce nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import blank, decimal_text, host_within, iso_date, public_url
from ..schema import EvidenceGraph, predicate_rules
from .spread import dealt


class InvalidGraph(ValueError):
    """Raised by require_valid; errors has the violations found, up to a limit, as (path, rule, key)."""

    def __init__(self, errors: list[tuple[str, str, str]]) -> None:
        self.errors = errors
        super().__init__("; ".join(f"{p}[{k}]: {r}" for p, r, k in errors))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the key values that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str = "id") -> DataFrame:
    """Rows whose key is null or names no target."""
    return rows.join(targets.select(F.col(target).alias(key)), key, "left_anti")


def unbacked(graph: EvidenceGraph) -> DataFrame:
    """Reported claims without supporting evidence."""
    support = graph.evidence.where("stance = 'supports'").select(F.col("claim_id").alias("id")).distinct()
    return graph.claims.where("assertion_type = 'reported'").join(support, "id", "left_anti")


def with_endpoint_types(graph: EvidenceGraph) -> DataFrame:
    """Claims with the types of their ends; null for an unknown end."""
    kind = graph.nodes.select("id", "type")
    subject = kind.withColumnsRenamed({"id": "subject", "type": "subject_type"})
    return graph.claims.join(subject, "subject", "left").join(kind.withColumnsRenamed({"id": "object", "type": "object_type"}), "object", "left")


def _broken(rows: DataFrame, path: str, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """A row for each rule that a row breaks; a rule holds where its condition is true or null."""
    found = F.filter(F.array(*[F.when(~rule, name) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return rows.select(F.lit(path).alias("path"), F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


def node_violations(graph: EvidenceGraph) -> DataFrame:
    rules = {"id": ~blank("id"), "type": F.coalesce(F.col("type").isin(*schema.NODE_TYPES), F.lit(False)), "label": ~blank("label")}
    if "aliases" in graph.nodes.columns:
        rules["aliases"] = F.forall("aliases", lambda a: a.isNotNull() & (F.trim(a) != ""))
    return _broken(graph.nodes, "nodes", rules)


def source_violations(graph: EvidenceGraph, synthetic: bool | None = None) -> DataFrame:
    """synthetic: that of the whole dataset; a dataset that is not synthetic has no synthetic sources."""
    fixture = F.col("kind") == "fixture"
    rules = {
        "title": ~blank("title"),
        "url": public_url("url"),
        "kind": F.coalesce(F.col("kind").isin(*schema.SOURCE_KINDS), F.lit(False)),
        "published_at": iso_date("published_at") | F.col("published_at").isNull(),
        "retrieved_at": F.coalesce(iso_date("retrieved_at"), F.lit(False)),
        "synthetic": F.coalesce(F.col("synthetic") == fixture, F.lit(False)),
        "license": ~blank("license"),
        "fixture_host": ~F.coalesce("synthetic", F.lit(False)) | host_within("url", schema.FIXTURE_HOST),
    }
    if synthetic is not None and not synthetic:
        rules["production"] = ~F.coalesce("synthetic", F.lit(False))
    return _broken(graph.sources, "sources", rules)


def claim_violations(graph: EvidenceGraph) -> DataFrame:
    """Unknown ends and predicates, ends of a wrong type, values outside their enumerations."""
    rows = with_endpoint_types(graph)
    allowed = predicate_rules(rows.sparkSession).withColumn("allowed", F.lit(True))  # a few hundred rows, fixed
    rows = rows.join(F.broadcast(allowed), ["predicate", "subject_type", "object_type"], "left")
    known = F.col("predicate").isin(*schema.PREDICATES)
    rules = {
        "subject_unknown": F.col("subject_type").isNotNull(),
        "object_unknown": F.col("object_type").isNotNull(),
        "predicate": F.coalesce(known, F.lit(False)),
        "endpoint_types": F.coalesce("allowed", F.lit(False)) | F.col("subject_type").isNull() | F.col("object_type").isNull() | ~known,
        "assertion_type": F.coalesce(F.col("assertion_type").isin(*schema.ASSERTION_TYPES), F.lit(False)),
        "effect": F.col("effect").isin(*schema.EFFECTS),
    }
    if "confidence" in rows.columns:
        rules["confidence"] = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    return _broken(rows, "claims", rules)


def evidence_violations(graph: EvidenceGraph) -> DataFrame:
    rows = graph.evidence.join(graph.claims.select(F.col("id").alias("claim_id"), F.lit(True).alias("__claim")), "claim_id", "left")
    rows = rows.join(graph.sources.select(F.col("id").alias("source_id"), F.lit(True).alias("__source")), "source_id", "left")
    rules = {"claim_unknown": F.col("__claim").isNotNull(), "source_unknown": F.col("__source").isNotNull(), "stance": F.coalesce(F.col("stance").isin(*schema.STANCES), F.lit(False)), "review_status": F.coalesce(F.col("review_status").isin(*schema.REVIEW_STATUSES), F.lit(False))}
    for name in ("locator", "excerpt"):
        if name in rows.columns:
            rules[name] = ~blank(name)
    return _broken(rows, "evidence", rules, "id" if "id" in rows.columns else "claim_id")


def coverage_violations(graph: EvidenceGraph) -> DataFrame:
    rows = graph.coverage.join(graph.sources.select(F.col("id").alias("source_id"), F.lit(True).alias("__source")), "source_id", "left")
    rows = rows.join(graph.nodes.select(F.col("id").alias("entity_id"), F.lit(True).alias("__entity")), "entity_id", "left")
    status = F.coalesce(F.col("status").isin(*schema.COVERAGE_STATUSES), F.lit(False))
    dated = F.coalesce(iso_date("searched_at"), F.lit(False)) | ~F.col("status").eqNullSafe("searched")
    return _broken(rows, "coverage", {"source_unknown": F.col("__source").isNotNull(), "entity_unknown": F.col("__entity").isNotNull(), "scope": ~blank("scope"), "status": status, "searched_at": dated})


def graph_violations(graph: EvidenceGraph, synthetic: bool | None = None) -> DataFrame:
    """All violations of all tables, ids that are used twice anywhere, and reported claims without support."""
    tables = [graph.nodes, graph.sources, graph.claims, graph.evidence, *([graph.coverage] if graph.coverage is not None else [])]
    ids = reduce(DataFrame.union, [t.select("id") for t in tables])
    parts = [
        node_violations(graph), source_violations(graph, synthetic), claim_violations(graph), evidence_violations(graph),
        *([coverage_violations(graph)] if graph.coverage is not None else []),
        duplicates(ids, "id").select(F.lit("ids").alias("path"), F.lit("duplicate").alias("rule"), F.col("id").alias("key")),
        unbacked(graph).select(F.lit("claims").alias("path"), F.lit("unbacked").alias("rule"), F.col("id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_valid(graph: EvidenceGraph, synthetic: bool | None = None, limit: int = 1000) -> EvidenceGraph:
    """The graph itself; InvalidGraph with its first violations (at most `limit`, sorted) if it has any."""
    found = graph_violations(graph, synthetic).orderBy("path", "rule", "key").limit(limit).collect()
    if found:
        raise InvalidGraph([tuple(r) for r in found])
    return graph


def measurement_violations(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rules of interval-aware measurements: relation, estimate, interval (both bounds or neither, in order)."""
    relation, numeric = F.col("relation"), F.col("relation").isin("eq", "lt", "le", "gt", "ge")
    lower, upper = (F.expr(f"try_cast({c} AS DECIMAL(38,18))") for c in ("ci_lower", "ci_upper"))
    rules = {
        "relation": F.coalesce(relation.isin("eq", "lt", "le", "gt", "ge", "range", "qualitative", "not_reported"), F.lit(False)),
        "estimate": ~numeric | F.expr("try_cast(estimate AS DECIMAL(38,18))").isNotNull(),
        "no_estimate": ~relation.isin("qualitative", "not_reported") | F.col("estimate").isNull(),
        "interval": F.col("ci_lower").isNull() == F.col("ci_upper").isNull(),
        "interval_order": lower <= upper,
        "range": (relation != "range") | (F.col("ci_lower").isNotNull() & F.col("ci_upper").isNotNull()),
        "uncertainty_type": F.col("uncertainty_type").isin("SEM", "SD", "95%CI", "unspecified"),
        "n": F.col("n") >= 1,
    }
    return _broken(rows, "measurements", rules, key)


def split_violations(documents: DataFrame, frozen: bool = False) -> DataFrame:
    """Manifest rules: a study and a snapshot hash stay within one split; documents known from development are there.

    frozen: every document's grouping is reviewed and its snapshot hash is given.
    """
    leaks = []
    for key in ("study_id", "source_sha256"):
        groups = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
        leaks.append(groups.select(F.lit("documents").alias("path"), F.lit(f"{key}_in_two_splits").alias("rule"), F.col(key).cast("string").alias("key")))
    rules = {"split": F.coalesce(F.col("split").isin("development", "held_out"), F.lit(False)), "known_development": ~F.col("known_development") | (F.col("split") == "development"), "source_sha256": F.col("source_sha256").rlike("^[0-9a-f]{64}$")}
    if frozen:
        rules["frozen"] = F.coalesce("grouping_reviewed", F.lit(False)) & F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    return reduce(DataFrame.union, [*leaks, _broken(documents, "documents", rules, "document_id")])


def observation_violations(rows: DataFrame, key: str = "id") -> DataFrame:
    """Shape of scalar observations: names, measurement types, decimal strings, sample sizes, evidence.

    rows: id, gene, variant, assay, property, measurement_type, value, unit, comparator_value, uncertainty_value (strings),
    sample_size (int), evidence_sets (arrays of spans), all of which may be null.
    """
    rules = {name: ~blank(name) for name in ("gene", "variant", "assay", "property")}
    rules |= {name: ~(F.col(name).isNotNull() & blank(name)) for name in ("sequence_context", "unit") if name in rows.columns}
    rules["measurement_type"] = F.coalesce(F.col("measurement_type").isin("measured", "author_calculated"), F.lit(False))
    rules |= {name: decimal_text(name) for name in ("value", "comparator_value", "uncertainty_value")}
    rules["sample_size"] = F.col("sample_size") > 0
    rules["evidence"] = F.coalesce((F.size("evidence_sets") > 0) & F.forall("evidence_sets", lambda s: F.size(s) > 0), F.lit(False))
    return _broken(rows, "observations", rules, key)


def cell_violations(observations: DataFrame, documents: DataFrame, coverage: DataFrame, scope: DataFrame, parts: int | None = None) -> DataFrame:
    """Rules of annotated cells: known documents, variants in scope, one observation for a cell and variant, table
    coordinates if and only if there is a table, each document covered once.

    observations: id, document_id, gene, protein, endpoint, table_id, row, column; scope: gene, protein.
    parts: how many parts observations are dealt into (see spread.dealt).
    """
    observations = dealt(observations, parts, "document_id")
    rows = dealt(observations.join(documents.select("document_id", F.lit(True).alias("__document")), "document_id", "left"), parts, "gene", "protein").join(scope.select("gene", "protein", F.lit(True).alias("__scope")), ["gene", "protein"], "left")
    placed = F.coalesce((F.col("row") > 0) & (F.col("column") > 0), F.lit(False))
    rules = {
        "document": F.col("__document").isNotNull(),
        "scope": F.col("__scope").isNotNull(),
        "endpoint": F.coalesce(F.col("endpoint").rlike("^[a-z0-9_]+$"), F.lit(False)),
        "coordinates": placed | F.col("table_id").isNull(),
        "prose": F.col("table_id").isNotNull() | (F.col("row").isNull() & F.col("column").isNull()),
    }
    anchor = ["document_id", "table_id", "row", "column", "gene", "protein"]
    twice = observations.where("table_id IS NOT NULL").groupBy(*anchor).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    covered = documents.select("document_id").join(coverage.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "full").where("NOT n <=> 1")
    named = lambda rows, rule, key: rows.select(F.lit("observations").alias("path"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    return reduce(DataFrame.union, [_broken(rows, "observations", rules), named(twice, "repeated_cell", "id"), named(covered, "coverage", "document_id")])
