"""States of claims, and what the claims of a path say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EvidenceGraph
from .spread import dealt


def evidence_with_sources(graph: EvidenceGraph) -> DataFrame:
    """Every evidence row with its source; an unknown source leaves nulls and resolved = false."""
    sources = graph.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.lit(True).alias("resolved"))
    return graph.evidence.join(sources, "source_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def claim_states(graph: EvidenceGraph, told: Column | None = None) -> DataFrame:
    """All claims with `state`, a fold of the evidence whose source is known, in the order of schema.CLAIM_STATES.

    Evidence is summed to five flags for each claim before it meets the claims, so a claim with very much evidence
    is no heavier in the join than another. told: a value of an evidence row; the claims then have `evidence`, too, the
    sorted distinct values of all their evidence, whether its source is known or not, and the claims of the graph, which
    are read twice, should be a written table.
    """
    support = F.col("stance") == "supports"
    reviewed = F.col("review_status").isin("human_reviewed", "machine_checked")
    rows, known, more = evidence_with_sources(graph), F.lit(True), []
    if told is None:
        rows = dealt(rows.where("resolved"), graph.parts, "claim_id")
    else:
        ids = dealt(graph.claims.select(F.col("id").alias("claim_id")), graph.parts, "claim_id")
        rows = dealt(rows, graph.parts, "claim_id").join(ids, "claim_id", "left_semi")
        known, more = F.col("resolved"), [F.sort_array(F.collect_set(told)).alias("evidence")]
    flags = rows.groupBy(F.col("claim_id").alias("id"))
    flags = flags.agg(F.bool_or(known & (F.col("stance") == "contradicts")).alias("against"), F.bool_or(known & support).alias("backed"), F.bool_or(known & support & reviewed).alias("reviewed"), *more)
    joined = dealt(graph.claims, graph.parts, "id").join(flags, "id", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    state = (
        F.when(yes("negated"), "negated")
        .when(yes("against"), "contradicted")
        .when(~F.col("assertion_type").eqNullSafe("reported"), F.when(yes("backed"), "inferred_only").otherwise("unsupported"))
        .when(yes("reviewed"), "supported")
        .when(yes("backed"), "review_required")
        .otherwise("unsupported")
    )
    if told is not None:
        joined = joined.withColumn("evidence", F.coalesce("evidence", F.array().cast(joined.schema["evidence"].dataType)))
    return joined.withColumn("state", state).drop("against", "backed", "reviewed")


def known_effect(effect: Column) -> Column:
    """An effect, unknown where it is missing or empty."""
    return F.coalesce(F.nullif(effect, F.lit("")), F.lit("unknown"))


def consolidated(effects: Column) -> Column:
    """The one effect of an array of effects, else unknown."""
    distinct = F.array_distinct(effects)
    return F.when(F.size(distinct) == 1, distinct[0]).otherwise("unknown")


def known_values(values: Column) -> Column:
    """Distinct values of an array without nulls, empty strings and 'unknown'."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~v.isin("", "unknown")))


def context_difference(left: Column, right: Column) -> Column:
    """How the known values of two paths in one dimension differ: 'unknown' if either has none, 'mismatch' if they
    share none, else null."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), "unknown").when(~F.arrays_overlap(left, right), "mismatch")
