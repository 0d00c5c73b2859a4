"""Whole explorations on small graphs, and joins whose keys hold a large share of all rows."""

import collections

from test_reasoning import BASE, LOSS, claim, graph, replaced

from quillgraph.operators import explore, paths, routes, spread, state
from quillgraph.operators.paths import PHENOTYPE_ONLY, REASONS

SHARED = [claim("8", "a", "HAS_PHENOTYPE", "ph"), claim("9", "b", "HAS_PHENOTYPE", "ph"), claim("10", "c", "HAS_PHENOTYPE", "ph")]


def explored(spark, claims, sources=("a",), coverage=()):
    g = graph(spark, claims)
    states = state.claim_states(g)
    every = paths.mechanism_paths(states)
    wanted = spark.createDataFrame([(s,) for s in sources], "disease string")
    judged = paths.judge_pairs(paths.path_pairs(every.join(wanted, "disease", "left_semi"), every))
    found = explore.explored(judged, explore.shared_phenotype_claims(states, wanted), g.nodes)
    open_routes = routes.asset_routes(states, found.where("status <> 'rejected'").select("disease", "other", "status"))
    known = spark.createDataFrame(coverage, "entity_id string, source_id string, status string, scope string")
    gaps = {r.disease: r for r in explore.gaps(wanted, found, open_routes, known).collect()}
    return {(r.disease, r.other): r for r in explore.with_evidence(found, g.evidence).collect()}, gaps


def test_a_lead_has_its_assessments_evidence_and_context(spark):
    found, gaps = explored(spark, BASE + SHARED, coverage=[("a", "s", "searched", "x")])
    lead, only = found["a", "b"], found["a", "c"]
    assert (lead.status, lead.score, lead.rank, lead.label) == ("supported_lead", 106, 1, "label b") and lead.reasons == [explore.LEAD, explore.CONTEXT_ONLY]
    assert [(x.mechanism, x.claim_ids, x.status) for x in lead.assessments] == [("m", ["1", "2", "3", "4"], "supported")] and lead.mechanisms == ["m"] and lead.phenotypes == ["ph"]
    assert lead.claim_ids == ["1", "2", "3", "4", "8", "9"] and lead.supported_claim_ids == ["1", "2", "3", "4"] and lead.review_claim_ids == []
    assert [(e.claim_id, e.source_id, e.stance) for e in lead.evidence] == [(c, "s", "supports") for c in lead.claim_ids]
    assert (only.status, only.score, only.rank) == ("rejected", 1, 2) and only.reasons == [PHENOTYPE_ONLY, explore.CONTEXT_ONLY] and only.assessments == []
    assert gaps["a"].status == "leads_found" and gaps["a"].gaps == [explore.EXCLUDED]


def test_a_lead_names_why_other_paths_were_rejected(spark):
    more = [claim("20", "b", "HAS_VARIANT", "vc"), claim("21", "vc", "HAS_EFFECT", "m", LOSS, stances=("contradicts",), tissue=None)]
    found, _ = explored(spark, BASE + more)
    lead = found["a", "b"]
    assert lead.status == "supported_lead" and lead.reasons == [explore.LEAD, REASONS["context"], REASONS["contradicted"]] and lead.differences == ["tissue:unknown"]
    assert [(x.claim_ids, x.status) for x in lead.assessments] == [(["1", "2", "20", "21"], "rejected"), (["1", "2", "3", "4"], "supported")]
    assert ("21", "contradicts") in [(e.claim_id, e.stance) for e in lead.evidence]


def test_review_and_rejection(spark):
    found, gaps = explored(spark, replaced("4", review="unreviewed"))
    assert found["a", "b"].status == "needs_review" and found["a", "b"].reasons == [REASONS["unreviewed"]] and found["a", "b"].review_claim_ids == ["1", "2", "3", "4"]
    assert gaps["a"].status == "no_supported_route" and gaps["a"].n_opportunities == 1 and gaps["a"].gaps == [explore.NO_COVERAGE]
    found, gaps = explored(spark, replaced("4", negated=True), coverage=[("a", "s", "failed", "trials"), ("a", None, None, None)])
    assert found["a", "b"].status == "rejected" and found["a", "b"].supported_claim_ids == []
    assert gaps["a"].gaps == ["Source s coverage is failed for trials.", "Source unknown coverage is unknown for unspecified scope.", explore.EXCLUDED, explore.NO_ROUTE]


def test_nothing_shared_and_unknown_sources(spark):
    found, gaps = explored(spark, [c for c in BASE if c["id"] != "4"], sources=("a", "nobody"))
    assert found == {} and {d: (r.status, r.n_candidates, r.gaps) for d, r in gaps.items()} == {d: ("no_supported_route", 0, [explore.NO_COVERAGE, explore.NO_ROUTE]) for d in ("a", "nobody")}


def test_a_contraindicated_asset_is_a_gap(spark):
    _, gaps = explored(spark, [*BASE, claim("30", "asset", "CONTRAINDICATED_FOR", "a")], coverage=[("a", "s", "searched", "x")])
    assert gaps["a"].status == "no_supported_route" and gaps["a"].gaps == [explore.REJECTED_ASSET]


def test_the_context_of_a_link_to_a_variant_plays_no_part(spark):
    """Only the claim on the mechanism says in which species it holds."""
    found, _ = explored(spark, [c | {"species": "fly"} if c["id"] == "3" else c for c in BASE])
    assert found["a", "b"].status == "supported_lead" and found["a", "b"].differences == []


def test_blocks_give_the_same_rows_as_a_plain_join(spark):
    left = [(i, "hot" if i % 3 else f"k{i % 11}") for i in range(300)] + [(-1, None), (-2, "left only"), (5, "hot"), (5, "hot")]
    right = [(1000 + i, "hot" if i % 2 else f"k{i % 13}") for i in range(200)] + [(-3, None), (-4, "right only")]
    a, b = spark.createDataFrame(left, "l int, key string"), spark.createDataFrame(right, "r int, key string")
    want = collections.Counter((k, x, y) for x, k in left for y, j in right if k == j and k is not None)
    for part in (10_000, 7, 1):
        assert collections.Counter((r.key, r.l, r.r) for r in spread.joined_in_blocks(a, b, "key", ("l", "r"), part).collect()) == want


def test_a_hot_key_is_cut_into_blocks(spark):
    """A third of all rows on one key: no cell of the join has more rows than a part of each side."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(9000)]
    a, b = spark.createDataFrame(rows, "l int, key string"), spark.createDataFrame([(i, k) for i, k in rows], "r int, key string")
    joined = spread.joined_in_blocks(a.where("l < 900"), b, "key", ("l", "r"), 200)
    plan = joined._jdf.queryExecution().toString()
    assert "__a" in plan and joined.where("key = 'hot'").count() == 300 * 3000


def test_small_values_are_attached_to_hot_and_cold_rows(spark):
    rows = [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}") for i in range(2000)]
    groups = [("hot", 1000, "H"), *[(f"k{i}", 1, f"v{i}") for i in range(0, 2000, 4)]]
    found = spread.attached(spark.createDataFrame(rows, "i int, key string"), spark.createDataFrame(groups, "key string, n int, v string"), "key", "n", 2000, spread.F.col("i")).collect()
    known = {k: v for k, _, v in groups}
    assert sorted((r.i, r.v) for r in found if r.v) == sorted((i, known[k]) for i, k in rows if k in known) and len(found) == 2000


def test_assessments_need_no_candidates(spark):
    """the pairs of paths give the assessments; a candidate that only shares a phenotype has none."""
    claims = BASE + SHARED
    states = state.claim_states(graph(spark, claims))
    every = paths.mechanism_paths(states)
    judged = paths.judge_pairs(paths.path_pairs(every.where("disease = 'a'"), every))
    flat = {(r.disease, r.other, r.mechanism, tuple(r.claim_ids), r.status) for r in explore.assessments(judged).collect()}
    nested, _ = explored(spark, claims)
    assert flat == {(d, o, x.mechanism, tuple(x.claim_ids), x.status) for (d, o), r in nested.items() for x in r.assessments} and len(flat) == 1


def test_candidates_are_counted_without_being_listed(spark):
    """counts are those of the candidates, of which some share a path, some phenotypes, some both, and some neither."""
    several = [claim(f"{i}", d, "HAS_PHENOTYPE", p) for i, (d, p) in enumerate([("a", "p1"), ("a", "p2"), ("b", "p1"), ("c", "p2"), ("d", "p1"), ("d", "p2"), ("e", "p3"), ("f", "p1")], 100)]
    against = [claim("200", "g", "HAS_PHENOTYPE", "p1", negated=True), claim("201", "g", "HAS_VARIANT", "vg"), claim("202", "vg", "HAS_EFFECT", "m", LOSS, stances=("contradicts",))]
    for claims in (BASE, BASE + SHARED, BASE + several, BASE + several + against, SHARED, [c for c in BASE if c["id"] != "4"]):
        states, wanted = state.claim_states(graph(spark, claims)), spark.createDataFrame([(d,) for d in ("a", "b", "c", "e", "nobody")], "disease string")
        every = paths.mechanism_paths(states)
        judged = paths.judge_pairs(paths.path_pairs(every.join(wanted, "disease", "left_semi"), every))
        found = explore.explored(judged, explore.shared_phenotype_claims(states, wanted), graph(spark, claims).nodes)
        want = {r.disease: (r.n, r.x) for r in found.groupBy("disease").agg(spread.F.count("*").alias("n"), spread.F.bool_or(spread.F.col("status") == "rejected").alias("x")).collect()}
        assert {r.disease: (r.n_candidates, r.excluded) for r in explore.candidate_counts(judged, states, wanted).collect()} == want
