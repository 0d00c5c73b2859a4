"""From candidates to resources: assets, who maintains them, who studies the matter, and what speaks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import dealt

CONTRAINDICATED = "asset_has_reported_supported_contraindication_for_source_or_candidate_disease"


def edges(states: DataFrame, predicate: str, subject: str, object_: str) -> DataFrame:
    """Supported claims of one predicate as two named columns and their claim id."""
    return states.where((F.col("predicate") == predicate) & (F.col("state") == "supported")).select(F.col("subject").alias(subject), F.col("object").alias(object_), F.col("id").alias(f"{predicate.lower()}_id"))


def with_assets(states: DataFrame) -> DataFrame:
    """(other): what a supported claim calls an asset relevant to; no other candidate has a route."""
    return edges(states, "RELEVANT_TO", "asset", "other").select("other").distinct()


def represented(states: DataFrame) -> DataFrame:
    """(other): what an organisation represents."""
    return edges(states, "REPRESENTS", "partner", "other").select("other").distinct()


def studied(states: DataFrame) -> DataFrame:
    """(other): what is studied itself."""
    return edges(states, "STUDIES", "person", "other").select("other").distinct()


def asset_routes(states: DataFrame, found: DataFrame) -> DataFrame:
    """(route_id, disease, other, asset, status, n_owners) of the candidates `found` (disease, other, status).

    An asset relevant to the candidate is a route if someone maintains it: a supported route for a supported lead, else
    one that needs review. A contraindication for either disease rejects it, maintained or not. All claims used are
    supported ones.
    """
    relevant = edges(states, "RELEVANT_TO", "asset", "other").select("asset", "other").distinct()
    owners = edges(states, "MAINTAINS", "owner", "asset").groupBy("asset").agg(F.count_distinct("owner").alias("n_owners"))
    against = edges(states, "CONTRAINDICATED_FOR", "asset", "against").select("asset", "against").distinct()
    rows = found.join(relevant, "other").join(owners, "asset", "left")
    # the alternative of two equalities is two joins, not one over all pairs
    hit = against.withColumn("hit", F.lit(True))
    rows = rows.join(hit.withColumnsRenamed({"against": "other", "hit": "hit_other"}), ["asset", "other"], "left").join(hit.withColumnsRenamed({"against": "disease", "hit": "hit_disease"}), ["asset", "disease"], "left")
    rejected = F.coalesce("hit_other", F.lit(False)) | F.coalesce("hit_disease", F.lit(False))
    status = F.when(rejected, "rejected").when(F.col("status") == "supported_lead", "supported_route").otherwise("needs_review")
    route = F.when(rejected, F.concat_ws(":", F.lit("opportunity"), "disease", "other", "asset")).otherwise(F.concat_ws(":", F.lit("opportunity"), "other", "asset"))
    rows = rows.withColumns({"rejected": rejected, "route_status": status, "route_id": route}).where("rejected OR n_owners IS NOT NULL")
    return rows.select("route_id", "disease", "other", "asset", F.col("route_status").alias("status"), F.coalesce("n_owners", F.lit(0).cast("long")).alias("n_owners"))


def collaborators(states: DataFrame, routes: DataFrame, shared: DataFrame) -> DataFrame:
    """(route_id, disease, person, partner): who studies the candidate or a shared mechanism, where an organisation
    represents the candidate. shared: (disease, other, mechanism)."""
    studies = edges(states, "STUDIES", "person", "studied").select("person", "studied").distinct()
    partners = edges(states, "REPRESENTS", "partner", "other").select("partner", "other").distinct()
    open_routes = routes.select("route_id", "disease", "other")
    direct = open_routes.join(studies.withColumnRenamed("studied", "other"), "other")
    through = open_routes.join(shared.distinct(), ["disease", "other"]).join(studies.withColumnRenamed("studied", "mechanism"), "mechanism")
    people = direct.select("route_id", "disease", "other", "person").union(through.select("route_id", "disease", "other", "person")).distinct()
    return people.join(partners, "other").select("route_id", "disease", "person", "partner").distinct()


def evidence_closure(paths: DataFrame, evidence: DataFrame, key: str, claim_ids: str = "claim_ids") -> DataFrame:
    """Distinct evidence rows of the claims of each path: (key, claim_id, and the columns of evidence)."""
    wanted = paths.select(key, F.explode(claim_ids).alias("claim_id")).distinct()
    return wanted.join(evidence, "claim_id")


def neighbours(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, neighbour) of all claims, both ways, once each. parts: how many parts they are told apart in (see dealt)."""
    pair = claims.select(F.explode(F.array(F.struct(F.col("subject").alias("node"), F.col("object").alias("neighbour")), F.struct(F.col("object").alias("node"), F.col("subject").alias("neighbour")))).alias("p"))
    return dealt(pair.select("p.*"), parts, "node", "neighbour").distinct()


def degrees(claims: DataFrame) -> DataFrame:
    """(node, degree): the number of claims that a node is an end of."""
    return claims.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_variants(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, node): each entity with itself and its variants. entities: (entity)."""
    variants = claims.where("predicate = 'HAS_VARIANT'").select(F.col("subject").alias("entity"), F.col("object").alias("node"))
    return entities.select("entity", F.col("entity").alias("node")).union(entities.join(variants, "entity").select("entity", "node")).distinct()
