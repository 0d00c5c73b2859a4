"""Mechanism paths, pairs of diseases that share a mechanism, and the verdicts on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .overlap import classes, ranked
from .spread import joined_in_blocks
from .state import consolidated, context_difference, known_effect, known_values

DIMENSIONS = ("species", "tissue", "stage")
# Codes of the reasons, in the order in which they are given.
REASONS = {
    "opposite": "opposite_effect_contexts_disqualify_shared_mechanism",
    "unknown": "effect_context_missing_or_unknown_requires_review",
    "context": "biological_context_differs_or_is_incomplete",
    "contradicted": "mechanistic_path_has_contradicting_evidence",
    "negated": "negative_assertion_is_not_positive_mechanism_evidence",
    "unreviewed": "supporting_evidence_is_unreviewed_and_requires_review",
    "unsupported": "mechanistic_path_lacks_reported_supported_evidence",
}
PHENOTYPE_ONLY = "phenotype_overlap_alone_is_insufficient_without_a_supported_shared_mechanism"
RANK = {"supported": 0, "needs_review": 1, "rejected": 2}


def mechanism_paths(states: DataFrame) -> DataFrame:
    """(disease, mechanism, claim_ids, effect, states, assertions, species, tissue, stage) of all paths.

    A disease reaches a mechanism directly (INVOLVES) or over a variant (HAS_VARIANT, HAS_EFFECT); every assertion
    counts, also those that are not supported. states are those of claim_states(). The effect and the context are those of
    the claim on the mechanism; a claim on a variant only links. If states have `evidence`, paths have that of both claims.
    """
    told = [c for c in ("evidence",) if c in states.columns]
    facts = F.struct("id", "state", "assertion_type", known_effect(F.col("effect")).alias("effect"), *DIMENSIONS, *told).alias("fact")
    direct = states.where("predicate = 'INVOLVES'").select(F.col("subject").alias("disease"), F.col("object").alias("mechanism"), F.array(facts).alias("claims"), F.array(known_effect(F.col("effect"))).alias("effects"))
    has_variant = states.where("predicate = 'HAS_VARIANT'").select(F.col("subject").alias("disease"), F.col("object").alias("variant"), facts.alias("first"))
    has_effect = states.where("predicate = 'HAS_EFFECT'").select(F.col("subject").alias("variant"), F.col("object").alias("mechanism"), facts.alias("second"))
    over = has_variant.join(has_effect, "variant").select("disease", "mechanism", F.array("first", "second").alias("claims"), F.array("second.effect").alias("effects"))
    every = direct.unionByName(over)
    pick = lambda field: F.transform("claims", lambda c: c[field])
    return every.select(
        "disease", "mechanism", pick("id").alias("claim_ids"), consolidated(F.col("effects")).alias("effect"),
        pick("state").alias("states"), pick("assertion_type").alias("assertions"), *[known_values(F.array(F.element_at("claims", -1)[d])).alias(d) for d in DIMENSIONS],
        *[F.flatten(pick(c)).alias(c) for c in told],
    )


def on_reached(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The claims without those on mechanisms that no path of a source disease reaches: no pair of paths has any of these.

    Of the claims on mechanisms only their ends are read to find what is reached.
    """
    asked = sources.select(F.col("disease").alias("subject")).distinct()
    of = lambda predicate: claims.where(F.col("predicate") == predicate).select("subject", "object")
    # written, so that the plan knows how few they are
    variants = written(of("HAS_VARIANT").join(asked, "subject", "left_semi").select(F.col("object").alias("subject")).distinct(), "variants")
    reached = of("INVOLVES").join(asked, "subject", "left_semi").unionByName(of("HAS_EFFECT").join(variants, "subject", "left_semi"))
    reached = written(reached.select("object").distinct(), "mechanisms")
    last = F.coalesce(F.col("predicate").isin("INVOLVES", "HAS_EFFECT"), F.lit(False))
    return claims.where(~last).unionByName(claims.where(last).join(reached, "object", "left_semi"))


def path_pairs(sources: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of paths of two diseases over one mechanism, left from `sources`, right from `others` (both written tables).

    A mechanism that many paths reach is cut into blocks of paths. What a path says for itself is worked out once for each
    path, not for each pair: whether its states or assertions reject (bad) or ask for a review (open).
    """
    has = lambda *states: F.arrays_overlap("states", F.array(*[F.lit(x) for x in states]))
    weak = F.size(F.array_except("assertions", F.array(F.lit("reported")))) > 0
    own = {"path": F.xxhash64("claim_ids"), "bad": F.coalesce(has("contradicted", "negated", "inferred_only", "unsupported"), F.lit(False)) | weak, "open": F.coalesce(has("review_required"), F.lit(False))}
    sides = [side.withColumns(own).select("mechanism", *[F.col(c).alias(f"{name}_{c}") for c in (*side.columns, *own) if c != "mechanism"]) for name, side in (("left", sources), ("right", others))]
    return joined_in_blocks(*sides, "mechanism", ("left_path", "right_path")).where("left_disease <> right_disease")


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with status, reasons (in order) and differences (dimension:kind)."""
    a, b = F.col("left_effect"), F.col("right_effect")
    unknown = (a == "unknown") | (b == "unknown")
    opposite = ~unknown & (a != b)
    differences = F.filter(F.array(*[F.concat(F.lit(d + ":"), context_difference(F.col(f"left_{d}"), F.col(f"right_{d}"))) for d in DIMENSIONS]), lambda x: x.isNotNull())
    states = F.concat("left_states", "right_states")
    has = lambda state: F.array_contains(states, state)
    weak = F.exists(F.concat("left_assertions", "right_assertions"), lambda x: ~x.eqNullSafe("reported")) | has("inferred_only") | has("unsupported")
    # what decides the status is said without functions on elements, which are slow for very many pairs
    differs = reduce(Column.__or__, [context_difference(F.col(f"left_{d}"), F.col(f"right_{d}")).isNotNull() for d in DIMENSIONS])
    downgraded = ~unknown & ~opposite & differs
    rejected = opposite | F.col("left_bad") | F.col("right_bad")
    review = unknown | downgraded | F.col("left_open") | F.col("right_open")
    given = ((opposite, "opposite"), (unknown, "unknown"), (downgraded, "context"), (has("contradicted"), "contradicted"), (has("negated"), "negated"), (has("review_required"), "unreviewed"), (weak, "unsupported"))
    reasons = F.filter(F.array(*[F.when(rule, REASONS[code]) for rule, code in given]), lambda x: x.isNotNull())
    status = F.when(rejected, "rejected").when(review, "needs_review").otherwise("supported")
    return pairs.withColumns({"status": status, "reasons": reasons, "differences": differences})


def _rank(status: Column) -> Column:
    return F.when(status == "supported", 0).when(status == "needs_review", 1).otherwise(2)


def shared_phenotypes(states: DataFrame, sources: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(disease, other, phenotype, both): phenotypes of a source disease that another disease has any claim on.

    The source's claim is supported; `both` says that the other's is, too. others: (other), if only these are wanted.
    """
    has = states.where("predicate = 'HAS_PHENOTYPE'")
    mine = has.where("state = 'supported'").join(sources.select(F.col("disease").alias("subject")).distinct(), "subject", "left_semi").select(F.col("subject").alias("disease"), F.col("object").alias("phenotype")).distinct()
    theirs = has.groupBy(F.col("subject").alias("other"), F.col("object").alias("phenotype")).agg(F.bool_or(F.col("state") == "supported").alias("both"))
    if others is not None:
        theirs = theirs.join(others, "other", "left_semi")
    return mine.join(theirs, "phenotype").where("disease <> other").select("disease", "other", "phenotype", "both")


def paired_statuses(judged: DataFrame) -> DataFrame:
    """(disease, other, status) of the diseases that share a mechanism; the best of their pairs decides."""
    best = judged.groupBy(F.col("left_disease").alias("disease"), F.col("right_disease").alias("other")).agg(F.min(_rank(F.col("status"))).alias("best"))
    return best.select("disease", "other", F.when(F.col("best") == 0, "supported_lead").when(F.col("best") == 1, "needs_review").otherwise("rejected").alias("status"))


def linked(judged: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """(disease, other, status) of candidates(), without counts and ranks."""
    pairs = paired_statuses(judged)
    only = phenotypes.where("both").select("disease", "other").distinct().join(pairs, ["disease", "other"], "left_anti")
    return pairs.unionByName(only.withColumn("status", F.lit("rejected")))


def candidates(judged: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Ranked candidates of each source disease: (disease, other, status, n_mechanisms, n_phenotypes, score, rank).

    The best pair decides: supported_lead, needs_review or rejected. Without any pair, shared supported phenotypes
    make a rejected candidate, and nothing makes none.
    """
    by_pair = judged.groupBy(F.col("left_disease").alias("disease"), F.col("right_disease").alias("other")).agg(F.min(_rank(F.col("status"))).alias("best"), F.count_distinct("mechanism").alias("n_mechanisms"))
    by_phenotype = phenotypes.where("both").groupBy("disease", "other").agg(F.count_distinct("phenotype").alias("n_phenotypes"))
    joined = by_pair.join(by_phenotype, ["disease", "other"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    status = F.when(F.col("best") == 0, "supported_lead").when(F.col("best") == 1, "needs_review").otherwise("rejected")
    rows = joined.select("disease", "other", status.alias("status"), zero("n_mechanisms"), zero("n_phenotypes"), F.coalesce("best", F.lit(2)).alias("best"), F.when(F.col("best").isNull(), PHENOTYPE_ONLY).alias("only"))
    base = F.when(F.col("best") == 0, 100).when(F.col("best") == 1, 50).otherwise(0)
    score = (base + F.least(F.lit(20), 5 * F.col("n_mechanisms")) + F.least(F.lit(5), F.col("n_phenotypes"))).cast("long")
    order = Window.partitionBy("disease").orderBy("best", F.desc("score"), "other")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("best")


def ranked_candidates(judged: DataFrame, states: DataFrame, sources: DataFrame) -> DataFrame:
    """candidates() of the source diseases, without a written or sorted row for each that only shares a phenotype.

    judged is read once, so it may be a plan.
    """
    has = states.where("predicate = 'HAS_PHENOTYPE' AND state = 'supported'")
    held = classes(has.groupBy(F.col("subject").alias("disease")).agg(F.array_sort(F.collect_set("object")).alias("class")))
    # each pair of paths moves once
    each = judged.select(F.col("left_disease").alias("disease"), F.col("right_disease").alias("other"), "mechanism", _rank(F.col("status")).alias("best")).repartition("disease", "other")
    by_pair = each.groupBy("disease", "other", "mechanism").agg(F.min("best").alias("best")).groupBy("disease", "other").agg(F.min("best").alias("best"), F.count("*").alias("n_mechanisms"))
    known = by_pair.join(held.select("disease", F.col("class").alias("own")), "disease", "left").join(held.select(F.col("disease").alias("other"), F.col("class").alias("theirs")), "other", "left")
    rows = known.withColumn("n_phenotypes", F.when(F.col("own").isNull() | F.col("theirs").isNull(), 0).otherwise(F.size(F.array_intersect("own", "theirs"))).cast("long"))
    base = F.when(F.col("best") == 0, 100).when(F.col("best") == 1, 50).otherwise(0)
    score = (base + F.least(F.lit(20), 5 * F.col("n_mechanisms")) + F.least(F.lit(5), F.col("n_phenotypes"))).cast("long")
    status = F.when(F.col("best") == 0, "supported_lead").when(F.col("best") == 1, "needs_review").otherwise("rejected")
    rows = rows.select("disease", "other", status.alias("status"), "n_mechanisms", "n_phenotypes", F.lit(None).cast("string").alias("only"), score.alias("score"), "best")
    tie = (F.col("best") == 2) & (F.col("score") == 5) & (F.col("n_phenotypes") == 0)
    order = Window.partitionBy("disease").orderBy("best", F.desc("score"), "other")
    rows = written(rows.withColumns({"at": F.row_number().over(order), "tie": tie}).drop("best"), "judged_candidates")
    ranks, more = ranked(held, sources.select("disease").distinct(), rows, 5, [], n_phenotypes=F.size("shared").cast("long"))
    more = more.select("disease", "other", F.lit("rejected").alias("status"), F.lit(0).cast("long").alias("n_mechanisms"), "n_phenotypes", F.lit(PHENOTYPE_ONLY).alias("only"), F.least(F.lit(5), F.col("n_phenotypes")).cast("long").alias("score"), "rank")
    return rows.drop("at", "tie").join(ranks, ["disease", "other"]).unionByName(more)
