"""Clusters of variants under source-reported classifications, with their measurements, channels and open issues."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimal, ratio, substitutions
from .spread import dealt

# Categories of classifications, endpoints that are compared with the wild type, and the potencies among
# them, whose ratio is turned round.
REDUCED = ("LoF", "Likely LoF", "Possible LoF")
INCREASED = ("GoF", "Likely GoF", "Possible GoF")
UNDECIDED = ("Indeterminant", "No effect")
STRONG = "Likely LoF"
ENDPOINTS = (
    "glutamate_ec50", "glycine_ec50", "magnesium_ic50", "open_probability", "peak_current_density", "proton_response_ratio",
    "steady_state_peak_ratio", "surface_total_ratio", "weighted_deactivation_tau", "zinc_ic50",
)
POTENCIES = ("glutamate_ec50", "glycine_ec50")


def measured_ratio() -> Column:
    """Variant against wild type of an observation (endpoint, measurement_type, measurement, comparator), else null.

    Both are measured, exact (relation eq), of one unit, the wild type above 0 and the variant not below; potencies
    are turned round and need a variant above 0.
    """
    m, wt = F.col("measurement"), F.col("comparator")
    a, b = decimal(m.estimate), decimal(wt.estimate)
    potency = F.col("endpoint").isin(*POTENCIES)
    good = F.col("endpoint").isin(*ENDPOINTS) & (F.col("measurement_type") == "measured") & (m.relation == "eq") & (wt.relation == "eq") & m.unit.eqNullSafe(wt.unit) & (b > 0) & (a >= 0) & ~(potency & (a == 0))
    return F.when(good, F.when(potency, ratio(b, a)).otherwise(ratio(a, b)))


def channel() -> Column:
    """What kind of evidence an observation (measurement_type, endpoint) is."""
    # Names of the channels.
    kind = F.col("measurement_type")
    return F.when(kind == "secondary_summary", "secondary_summary").when(kind == "author_calculated", "calculated_function").when(F.col("endpoint").isin(*ENDPOINTS), "intrinsic_function").otherwise("pharmacology_or_other")


def member_tiers(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """(gene, protein, tier, n_ratios) of every variant with an observation or a claim.

    claims: gene, protein, predicate, evidence_type, category; of them the authors' own classifications count.
    """
    own = claims.where("predicate = 'author_functional_classification' AND evidence_type = 'primary_report'")
    any_of = lambda names: F.bool_or(F.col("category").isin(*names))
    labels = own.groupBy("gene", "protein").agg(any_of(REDUCED).alias("r"), any_of(INCREASED).alias("i"), any_of(UNDECIDED).alias("u"), any_of((STRONG,)).alias("s"))
    measured = observations.withColumn("ratio", measured_ratio()).groupBy("gene", "protein").agg(F.count("ratio").alias("n_ratios"))
    members = claims.select("gene", "protein").union(observations.select("gene", "protein")).distinct()
    rows = members.join(labels, ["gene", "protein"], "left").join(measured, ["gene", "protein"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.coalesce("n_ratios", F.lit(0).cast("long"))
    # Names of the tiers.
    tier = (
        F.when(yes("r") & yes("i") | yes("u"), "unresolved_control")
        .when(yes("s") & (n > 0), "core_likely_reduced")
        .when(yes("r"), "provisional_possible_reduced")
        .when(yes("i"), "opposing_control")
        .otherwise("unresolved_control")
    )
    return rows.select("gene", "protein", tier.alias("tier"), n.alias("n_ratios"))


def scoped_issues(issues: DataFrame, observations: DataFrame) -> DataFrame:
    """(gene, protein, document_id, description): issues of a variant, and issues without a gene of its documents."""
    own = issues.where("gene IS NOT NULL").select("gene", "protein", "document_id", "description")
    seen = observations.select("gene", "protein", "document_id").distinct()
    general = issues.where("gene IS NULL").select("document_id", "description").join(seen, "document_id")
    return own.unionByName(general).distinct()


def asked_variants(questions: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, variant, known): substitutions that questions name, in one-letter form, and whether a member has them."""
    short = members.select(F.explode(substitutions("protein")).alias("variant")).distinct().withColumn("hit", F.lit(True))
    asked = questions.select(F.col(id_col).alias("id"), F.explode(substitutions(text_col)).alias("variant"))
    return asked.join(short, "variant", "left").select("id", "variant", F.coalesce("hit", F.lit(False)).alias("known"))


def members(claims: DataFrame, observations: DataFrame, issues: DataFrame, parts: int | None = None) -> DataFrame:
    """The members of a cluster: (gene, protein, tier, n_ratios, n_observations, n_estimates, n_papers, n_issues).

    claims as in member_tiers with document_id; observations as in measured_ratio with gene, protein, document_id;
    issues: gene, protein, document_id, description. parts: how many parts variants are dealt into (see spread.dealt).
    """
    key = ["gene", "protein"]
    claims, observations = dealt(claims, parts, *key), dealt(observations, parts, *key)
    papers = claims.select(*key, "document_id").union(observations.select(*key, "document_id")).groupBy(*key).agg(F.count_distinct("document_id").alias("n_papers"))
    seen = observations.groupBy(*key).agg(F.count("*").alias("n_observations"), F.count("measurement.estimate").alias("n_estimates"))
    open_ = scoped_issues(issues, claims.select(*key, "document_id").union(observations.select(*key, "document_id"))).groupBy(*key).agg(F.count("*").alias("n_issues"))
    rows = member_tiers(claims, observations).join(papers, key, "left").join(seen, key, "left").join(open_, key, "left")
    return rows.na.fill(0, ["n_observations", "n_estimates", "n_papers", "n_issues"])


def write_features(features: DataFrame, folder: str) -> str:
    """A table as CSV files with a header in a new folder under `folder`, which it gives; sorted within each file."""
    path = f"{folder}/{uuid.uuid4().hex}/features.csv"
    features.sortWithinPartitions(*features.columns).write.csv(path, header=True)
    return path
