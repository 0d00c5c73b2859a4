"""Answers to many questions, and to the turns of conversations, as rows: claims, nodes and whether something is missing.

Questions that ask the same of the same node share a scope; a scope is answered once, however many ask it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import ask
from .ranks import carried
from .routes import edges

FOLLOW_UP = "claim_evidence"


def with_scopes(routes: DataFrame) -> DataFrame:
    """routed questions with `scope`, what is asked of which nodes."""
    return routes.withColumn("scope", F.concat_ws("|", "intent", F.coalesce("about", F.lit("")), F.coalesce("other", F.lit(""))))


def route_turns(turns: DataFrame, nodes: DataFrame, id_col: str, conv: str, turn: str, text: str) -> DataFrame:
    """(id, conversation, turn, intent, about, other, scope, asks): routes of turns; a turn that names no node is about the
    one that an earlier turn of its conversation named last. asks: whether it asks for evidence and names nothing.

    id_col is unique. Null texts are missing.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.col(conv).alias("conversation"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    seen = ask.mentions(rows, nodes, "id", "text").groupBy("id").agg(F.min_by("node", F.struct((-F.col("length")).alias("n"), "node")).alias("mention"))
    named = rows.join(seen, "id", "left")
    before = written(carried(named.select("id", "conversation", "turn", "text", "mention"), "conversation", "turn", node=F.col("mention")), "before")
    found = ask.routed(rows, nodes, "id", "text", before.where("node IS NOT NULL").select("id", "node"))
    asks = (ask.intent("text") == "evidence") & F.col("mention").isNull()
    return with_scopes(before.select("id", "conversation", "turn", asks.alias("asks")).join(found, "id"))


def explored_diseases(scopes: DataFrame) -> DataFrame:
    """(disease): the nodes whose candidates scope_claims() looks at."""
    return scopes.where("about IS NOT NULL AND intent IN ('compare', 'connections', 'asset')").select(F.col("about").alias("disease")).distinct()


def scope_claims(scopes: DataFrame, nodes: DataFrame, claims: DataFrame, states: DataFrame, evidence: DataFrame, explored: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((scope, claim_id), (scope, node)) of distinct scopes (scope, intent, about, other).

    explored: candidates of all explored_diseases() (disease, other, status, claim_ids, supported_claim_ids); routes:
    asset_routes() of these. Comparisons have the claims of the candidate; connections of a disease those of its leads and
    of those that need review; assets of a disease those of its supported routes, and assets of nothing in particular all
    claims on assets; conflicts what some evidence contradicts; evidence, connections and descriptions the node's claims,
    evidence also those on the effects of its variants.
    """
    types = nodes.select(F.col("id").alias("about"), "type")
    asked = scopes.join(types, "about", "left")
    disease = F.col("type").eqNullSafe("Disease")
    own = (F.col("intent").isin("describe", "evidence")) | ((F.col("intent") == "connections") & ~disease) | ((F.col("intent") == "conflict") & F.col("about").isNotNull())
    plain = ask.answer_claims(asked.where(own).select(F.col("scope").alias("id"), "intent", "about"), claims, evidence).withColumnRenamed("id", "scope")
    compared = asked.where("intent = 'compare'").join(explored, [asked.about == explored.disease, asked.other == explored.other]).select("scope", F.explode("claim_ids").alias("claim_id"), explored.other.alias("node"))
    near = asked.where((F.col("intent") == "connections") & disease).join(explored.where("status <> 'rejected'").withColumnsRenamed({"disease": "about", "other": "node"}).select("about", "node", "status", "claim_ids"), "about")
    leads = near.select("scope", F.explode("claim_ids").alias("claim_id"))
    good = routes.where("status = 'supported_route'").select(F.col("disease").alias("about"), F.col("other").alias("to"), "asset").distinct()
    assets = asked.where((F.col("intent") == "asset") & disease).join(good, "about").select("scope", "about", "to", "asset")
    bridges = assets.join(explored.withColumnsRenamed({"disease": "about", "other": "to"}).select("about", "to", "supported_claim_ids"), ["about", "to"]).select("scope", F.explode("supported_claim_ids").alias("claim_id"))
    relevance = assets.join(edges(states, "RELEVANT_TO", "asset", "to"), ["asset", "to"]).select("scope", F.col("relevant_to_id").alias("claim_id"))
    owners = assets.join(edges(states, "MAINTAINS", "owner", "asset"), "asset").select("scope", F.col("maintains_id").alias("claim_id"))
    # what names no node is one scope, so these are two scans, not a join with every question
    every_asset = nodes.where("type = 'Asset'").select(F.col("id").alias("node"))
    one = lambda intent: asked.where((F.col("intent") == intent) & F.col("about").isNull()).select("scope").limit(1)
    ends = claims.select(F.col("id").alias("claim_id"), F.explode(F.array("subject", "object")).alias("node"))
    all_assets = ends.join(every_asset, "node", "left_semi").select("claim_id").distinct()
    disputed = evidence.where("stance = 'contradicts'").select("claim_id").distinct()
    general = [rows.join(F.broadcast(one(intent))).select("scope", "claim_id") for intent, rows in (("asset", all_assets), ("conflict", disputed))]
    found = [plain.select("scope", "claim_id"), compared.select("scope", "claim_id"), leads.select("scope", "claim_id"), bridges, relevance, owners, *general]
    around = asked.where((F.col("intent") == "connections") & ~disease & F.col("about").isNotNull()).join(claims.select(F.col("subject").alias("about"), F.col("object").alias("node")).union(claims.select("object", "subject")), "about").select("scope", "node")
    themselves = asked.where("about IS NOT NULL AND intent <> 'asset'").select("scope", F.explode(F.array_compact(F.array("about", "other"))).alias("node"))
    empty = asked.where((F.col("intent") == "asset") & disease).join(good, "about", "left_anti").select("scope", F.col("about").alias("node"))
    of_nodes = [themselves, empty, near.select("scope", "node"), assets.select("scope", F.col("asset").alias("node")), around, every_asset.join(F.broadcast(one("asset"))).select("scope", "node")]
    distinct = lambda some: reduce(DataFrame.unionByName, some).distinct()
    return distinct(found), distinct(of_nodes)


def answered(routes: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """routes with n_claims, n_nodes, first_claim and missing (a gap that a proposal could fill), from what their scopes have.

    Missing are comparisons without a candidate, assets of a disease without a supported route, evidence and connections
    without claims, and what no rule answers.
    """
    per_claim = claims.groupBy("scope").agg(F.count("*").alias("n_claims"), F.min("claim_id").alias("first_claim"))
    per_node = nodes.groupBy("scope").agg(F.count("*").alias("n_nodes"))
    counted = written(per_claim.join(per_node, "scope", "full"), "answered")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    rows = routes.join(counted, "scope", "left").select(*routes.columns, zero("n_claims"), zero("n_nodes"), "first_claim")
    empty = (F.col("intent").isin("compare", "evidence") | ((F.col("intent").isin("asset", "connections")) & F.col("about").isNotNull())) & (F.col("n_claims") == 0)
    return rows.withColumn("missing", (F.col("intent") == "missing") | empty)


def with_follow_ups(turns: DataFrame) -> DataFrame:
    """answered turns, those that ask for evidence and name nothing being about the claims of an earlier answer, if any.

    That is the last answer with claims that is no such turn itself, else the last one that is. `of` is its scope; the
    follow-up has its claims, no nodes, and nothing missing.
    """
    bears = F.when(F.col("n_claims") > 0, F.struct("scope", "n_claims", "first_claim"))
    rows = carried(turns, "conversation", "turn", plain=F.when(~F.col("asks"), bears), asking=F.when(F.col("asks"), bears))
    source = F.coalesce("plain", "asking")
    again = F.col("asks") & source.isNotNull()
    other = lambda c, value: F.when(again, value).otherwise(F.col(c)).alias(c)
    return rows.select(
        "id", "conversation", "turn", other("intent", F.lit(FOLLOW_UP)), other("about", F.lit(None)), other("other", F.lit(None)), F.when(again, source.scope).alias("of"),
        other("n_claims", source.n_claims), other("n_nodes", F.lit(0).cast("long")), other("first_claim", source.first_claim), other("missing", F.lit(False)),
    )
