"""Read-only answers about a graph: a status and a body for each request, as an HTTP front would send them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from .operators import ask, explore, paths, routes, search, state
from .schema import COVERAGE, EvidenceGraph
from .storage import written

#: Bounds of a body: what is over them is counted, not given.
MOST_NODES, MOST_CLAIMS, MOST_ANSWERS, MOST_CANDIDATES, LONGEST = 40, 100, 1000, 100, 1000


class GraphApi:
    """Answers over one graph. Bodies hold what one entity or claim needs; whole tables stay DataFrames (`graph`)."""

    def __init__(self, graph: EvidenceGraph) -> None:
        self.graph, self.spark = graph, graph.nodes.sparkSession
        self.states = state.claim_states(graph)

    def request(self, method: str, path: str, query: Mapping[str, list[str]] | None = None) -> tuple[int, object]:
        if method != "GET":
            return 405, {"error": "method_not_allowed"}
        handler = {"/api/search": self.search, "/api/explore": self.explore, "/api/claim": self.claim, "/api/stats": self.stats, "/api/ask": self.ask, "/api/health": self.health, "/api/graph": self.table}.get(path)
        return handler(query or {}) if handler else (404, {"error": "not_found"})

    @staticmethod
    def _one(query: Mapping[str, list[str]], key: str) -> str | None:
        """A parameter that is given once; repeated or blank it counts as missing."""
        values = query.get(key, [])
        return values[0].strip() or None if len(values) == 1 else None

    def _node(self, id_: str):
        return self.graph.nodes.where(F.col("id") == id_).first()

    def health(self, _: Mapping) -> tuple[int, object]:
        return 200, {"status": "ok"}

    def stats(self, _: Mapping) -> tuple[int, object]:
        return 200, {name: getattr(self.graph, name).count() for name in ("nodes", "sources", "claims", "evidence")}

    def search(self, query: Mapping) -> tuple[int, object]:
        if not (q := self._one(query, "q")):
            return 400, {"error": "missing_query"}
        found = search.top_nodes(self.graph.nodes, q, MOST_NODES).orderBy("position").collect()
        return 200, {"total": found[0].total if found else 0, "nodes": [{"id": r.id, "label": r.label} for r in found]}

    def claim(self, query: Mapping) -> tuple[int, object]:
        if not (id_ := self._one(query, "id")):
            return 400, {"error": "missing_id"}
        found = self.states.where(F.col("id") == id_).first()
        if found is None:
            return 404, {"error": "claim_not_found"}
        every = state.evidence_with_sources(self.graph).where(F.col("claim_id") == id_)
        total = {r.stance: r["count"] for r in every.groupBy("stance").count().collect()}
        rows = every.orderBy("id").limit(MOST_ANSWERS).collect()
        known = self.graph.sources.join(F.broadcast(every.select(F.col("source_id").alias("id")).limit(MOST_ANSWERS).distinct()), "id", "left_semi")
        records = [r.asDict() for r in known.orderBy("id").limit(MOST_ANSWERS).collect()]
        of = lambda stance: [r.asDict() for r in rows if r.stance == stance]
        return 200, {"claim": found.asDict(), "support": of("supports"), "contradictions": of("contradicts"), "totals": total, "sources": list(dict.fromkeys(r.source_id for r in rows)), "source_records": records}

    def table(self, query: Mapping) -> tuple[int, object]:
        """A page of one table of the graph in order of ids, and the id to go on after: `next` is null on the last page."""
        name, after = self._one(query, "table") or "nodes", self._one(query, "after")
        rows = getattr(self.graph, name, None) if name in ("nodes", "sources", "claims", "evidence", "coverage") else None
        if rows is None:
            return 404, {"error": "table_not_found"}
        page = (rows.where(F.col("id") > after) if after else rows).orderBy("id").limit(MOST_ANSWERS + 1).collect()
        return 200, {"table": name, "total": rows.count(), "rows": [r.asDict(True) for r in page[:MOST_ANSWERS]], "next": page[MOST_ANSWERS - 1].id if len(page) > MOST_ANSWERS else None}

    def explore(self, query: Mapping) -> tuple[int, object]:
        if not (id_ := self._one(query, "disease")):
            return 400, {"error": "missing_disease"}
        node = self._node(id_)
        if node is None:
            return 404, {"error": "node_not_found"}
        if node.type != "Disease":
            return 400, {"error": "not_a_disease"}
        every = written(paths.mechanism_paths(self.states), "paths")
        asked = self.spark.createDataFrame([(id_,)], "disease string")
        judged = written(paths.judge_pairs(paths.path_pairs(every.where(F.col("disease") == id_), every)), "judged")
        found = written(explore.explored(judged, explore.shared_phenotype_claims(self.states, asked), self.graph.nodes), "explored")
        opportunities = written(routes.asset_routes(self.states, found.where("status <> 'rejected'").select("disease", "other", "status")), "opportunities")
        coverage = self.graph.coverage if self.graph.coverage is not None else self.spark.createDataFrame([], COVERAGE)
        known = explore.gaps(asked, found, opportunities, coverage).first()
        best = explore.with_evidence(found.where(F.col("rank") <= MOST_CANDIDATES), self.graph.evidence).orderBy("rank").collect()
        first = opportunities.orderBy("route_id").limit(MOST_ANSWERS).collect()
        return 200, {"disease": node.asDict(True), "status": known.status, "n_candidates": known.n_candidates, "n_opportunities": known.n_opportunities, "candidates": [r.asDict(True) for r in best], "opportunities": [r.asDict() for r in first], "gaps": known.gaps}

    def ask(self, query: Mapping) -> tuple[int, object]:
        q, node, claims = self._one(query, "q"), self._one(query, "node"), query.get("claim", [])
        if not q or len(q) > LONGEST:
            return 400, {"error": "invalid_question"}
        if len(claims) > MOST_CLAIMS:
            return 400, {"error": "invalid_claim_context"}
        if node and self._node(node) is None:
            return 404, {"error": "node_not_found"}
        if claims and self.graph.claims.where(F.col("id").isin(claims)).select("id").distinct().count() < len(set(claims)):
            return 400, {"error": "invalid_claim_context"}
        found = ask.route(q, self.graph.nodes, node, tuple(claims))
        if found["intent"] == "claim_evidence":
            rows = self.graph.evidence.where(F.col("claim_id").isin(claims))
        else:
            routes_ = self.spark.createDataFrame([(0, found["intent"], found["about"])], "id int, intent string, about string")
            answer = ask.answer_claims(routes_, self.graph.claims, self.graph.evidence).select("claim_id")
            if found["intent"] == "conflict" and found["about"] is None:
                answer = self.graph.evidence.where("stance = 'contradicts'").select("claim_id").distinct()
            rows = self.graph.evidence.join(answer, "claim_id", "left_semi")
            claims = [r.claim_id for r in answer.orderBy("claim_id").limit(MOST_ANSWERS).collect()]
        count = rows.agg(F.count_if(F.col("stance") == "supports").alias("supporting"), F.count_if(F.col("stance") == "contradicts").alias("conflicting"), F.count_distinct("source_id").alias("sources")).first()
        total = len(claims) if found["intent"] == "claim_evidence" else answer.count()
        return 200, found | {"claim_ids": list(claims), "n_claims": total, "evidence": count.asDict()}
