"""States, paths, candidates and routes on small graphs, one change at a time."""

import pytest

from quillgraph.operators import ask, export, paths, routes, search, state, validate
from quillgraph.schema import EvidenceGraph
from quillgraph.storage import load_graph, save_graph

TYPES = {"a": "Disease", "b": "Disease", "c": "Disease", "va": "Variant", "vb": "Variant", "vc": "Variant", "m": "Mechanism", "asset": "Asset", "org": "Organization", "ph": "Phenotype", "who": "Person"}
CONTEXT = {"species": "mouse", "tissue": "leaf", "stage": "late"}


def claim(id_, subject, predicate, object_, effect=None, assertion="reported", stances=("supports",), review="human_reviewed", **more):
    where = dict(CONTEXT) if predicate == "HAS_EFFECT" else {}
    return {"id": id_, "subject": subject, "predicate": predicate, "object": object_, "assertion_type": assertion, "effect": effect, "stances": stances, "review": review, **where, **more}


LOSS, GAIN = "loss_of_function", "gain_of_function"
BASE = [claim("1", "a", "HAS_VARIANT", "va"), claim("2", "va", "HAS_EFFECT", "m", LOSS), claim("3", "b", "HAS_VARIANT", "vb"), claim("4", "vb", "HAS_EFFECT", "m", LOSS), claim("5", "asset", "RELEVANT_TO", "b"), claim("6", "org", "MAINTAINS", "asset"), claim("7", "org", "REPRESENTS", "b")]


def graph(spark, claims):
    evidence = [{"id": f"e{c['id']}{i}", "claim_id": c["id"], "source_id": c.get("source", "s"), "locator": "p1", "excerpt": "text", "stance": s, "review_status": c["review"]} for c in claims for i, s in enumerate(c["stances"])]
    return EvidenceGraph.of(spark, [{"id": i, "type": t, "label": f"label {i}", "aliases": []} for i, t in TYPES.items()], [{"id": "s", "title": "t", "url": "https://example.org/x", "kind": "paper", "retrieved_at": "2024-01-02", "synthetic": False, "license": "free"}], claims, evidence)


def replaced(id_, **change):
    return [c | change if c["id"] == id_ else c for c in BASE]


def explore(spark, claims, disease="a"):
    states = state.claim_states(graph(spark, claims))
    every = paths.mechanism_paths(states)
    judged = paths.judge_pairs(paths.path_pairs(every.where(every.disease == disease), every))
    found = paths.candidates(judged, paths.shared_phenotypes(states, spark.createDataFrame([(disease,)], "disease string")))
    open_routes = routes.asset_routes(states, found.select("disease", "other", "status"))
    return {r.other: r for r in found.collect()}, {r.asset: r for r in open_routes.collect()}, {r.right_disease: r for r in judged.collect()}


def test_a_shared_mechanism_is_a_lead(spark):
    found, open_routes, judged = explore(spark, BASE)
    assert found["b"].status == "supported_lead" and found["b"].score == 105 and found["b"].rank == 1 and list(found) == ["b"]
    assert open_routes["asset"].status == "supported_route" and open_routes["asset"].n_owners == 1 and open_routes["asset"].route_id == "opportunity:b:asset"
    assert judged["b"].reasons == [] and judged["b"].differences == []


@pytest.mark.parametrize(
    ("claims", "status", "reasons"),
    [
        (replaced("4", effect=GAIN), "rejected", ["opposite"]),
        (replaced("4", effect=None), "needs_review", ["unknown"]),
        (replaced("4", effect=""), "needs_review", ["unknown"]),
        (replaced("4", tissue="root"), "needs_review", ["context"]),
        (replaced("4", stage=None), "needs_review", ["context"]),
        (replaced("4", stances=("supports", "contradicts")), "rejected", ["contradicted"]),
        (replaced("4", negated=True), "rejected", ["negated"]),
        (replaced("4", review="unreviewed"), "needs_review", ["unreviewed"]),
        (replaced("4", assertion_type="inferred"), "rejected", ["unsupported"]),
        (replaced("4", stances=()), "rejected", ["unsupported"]),
        (replaced("4", source="unknown source"), "rejected", ["unsupported"]),
        (replaced("4", effect=None, review="unreviewed", negated=True), "rejected", ["unknown", "negated"]),
    ],
)
def test_verdicts_and_reasons(spark, claims, status, reasons):
    found, _, judged = explore(spark, claims)
    assert judged["b"].status == status and judged["b"].reasons == [paths.REASONS[r] for r in reasons]
    assert found["b"].status == status


def test_a_second_path_that_is_contradicted_does_not_spoil_the_first(spark):
    more = [claim("8", "b", "HAS_VARIANT", "vc"), claim("9", "vc", "HAS_EFFECT", "m", LOSS, stances=("contradicts",))]
    found, _, _ = explore(spark, BASE + more)
    assert found["b"].status == "supported_lead"


def test_phenotypes_alone_are_not_enough(spark):
    claims = [claim("1", "a", "HAS_PHENOTYPE", "ph"), claim("2", "b", "HAS_PHENOTYPE", "ph"), *BASE[4:]]
    found, open_routes, _ = explore(spark, claims)
    assert found["b"].status == "rejected" and found["b"].only == paths.PHENOTYPE_ONLY and found["b"].score == 1
    negated, _, _ = explore(spark, [claims[0] | {"negated": True}, *claims[1:]])
    assert negated == {}


@pytest.mark.parametrize("change", [{"negated": True}, {"review": "unreviewed"}, {"stances": ("contradicts",)}])
def test_routes_need_supported_claims(spark, change):
    for id_ in ("5", "6"):
        assert explore(spark, replaced(id_, **change))[1] == {}


def test_contraindications_reject_routes(spark):
    for where in ("a", "b"):
        claims = [*BASE, claim("8", "asset", "CONTRAINDICATED_FOR", where)]
        assert explore(spark, claims)[1]["asset"].status == "rejected"
        unowned = [c for c in claims if c["predicate"] != "MAINTAINS"]
        assert explore(spark, unowned)[1]["asset"].route_id == "opportunity:a:b:asset"
    assert explore(spark, [*BASE, claim("8", "asset", "CONTRAINDICATED_FOR", "c")])[1]["asset"].status == "supported_route"
    assert explore(spark, [c for c in BASE if c["predicate"] != "MAINTAINS"])[1] == {}


def test_collaborators(spark):
    claims = [*BASE, claim("8", "who", "STUDIES", "m")]
    states = state.claim_states(graph(spark, claims))
    open_routes = spark.createDataFrame([("r", "a", "b")], "route_id string, disease string, other string")
    shared = spark.createDataFrame([("a", "b", "m")], "disease string, other string, mechanism string")
    assert [tuple(r) for r in routes.collaborators(states, open_routes, shared).collect()] == [("r", "a", "who", "org")]


def test_states_in_order_of_precedence(spark):
    rows = [
        ("negated", claim("n", "a", "HAS_VARIANT", "va", stances=("supports", "contradicts"), negated=True)),
        ("contradicted", claim("c", "a", "HAS_VARIANT", "va", assertion="inferred", stances=("supports", "contradicts"))),
        ("inferred_only", claim("i", "a", "HAS_VARIANT", "va", assertion="inferred")),
        ("unsupported", claim("u", "a", "HAS_VARIANT", "va", assertion="inferred", stances=())),
        ("supported", claim("s", "a", "HAS_VARIANT", "va", review="machine_checked")),
        ("review_required", claim("r", "a", "HAS_VARIANT", "va", review="unreviewed")),
        ("unsupported", claim("x", "a", "HAS_VARIANT", "va", source="nowhere")),
    ]
    got = {r.id: r.state for r in state.claim_states(graph(spark, [c for _, c in rows])).collect()}
    assert got == {c["id"]: s for s, c in rows}


def test_valid_and_invalid_graphs(spark, tmp_path):
    good = graph(spark, BASE)
    assert validate.graph_violations(good).collect() == []
    bad = graph(spark, [*BASE, claim("8", "a", "HAS_VARIANT", "m"), claim("9", "a", "KNOWS", "zz", effect="odd", stances=(), confidence=2.0), claim("1", "a", "HAS_VARIANT", "va")])
    rules = {(r.rule, r.key) for r in validate.graph_violations(bad).collect()}
    assert rules >= {("endpoint_types", "8"), ("predicate", "9"), ("object_unknown", "9"), ("effect", "9"), ("confidence", "9"), ("unbacked", "9"), ("duplicate", "1")}
    with pytest.raises(validate.InvalidGraph, match="endpoint_types"):
        validate.require_valid(bad)
    root = f"file://{tmp_path}/graph"
    first = save_graph(good, root)
    with pytest.raises(FileExistsError):
        save_graph(good, root)
    with pytest.raises(validate.InvalidGraph):
        save_graph(bad, root, replace=True)
    loaded = load_graph(spark, root)
    assert loaded.claims.orderBy("ord").collect() == good.claims.orderBy("ord").collect()
    assert save_graph(good, root, replace=True) != first and load_graph(spark, root).nodes.count() == len(TYPES)


def test_exports(spark):
    g = graph(spark, BASE)
    assert {r.kind for r in export.linked_data(g).collect()} == {"node", "source", "claim", "evidence", "coverage"} - {"coverage"}
    elements = export.elements(g).collect()
    n_claims, n_evidence = len(BASE), len(BASE)
    assert sum(e.role == "edge" for e in elements) == 2 * (n_claims + n_evidence)
    assert len({e.id for e in elements}) == len(elements)


def test_search_and_questions(spark):
    g = graph(spark, BASE)
    nodes = g.nodes
    assert [r.id for r in search.top_nodes(nodes, "LABEL A", 5).orderBy("position").collect()] == ["a", "asset"]
    assert search.find_nodes(nodes, "  ").collect() == []
    assert [r.id for r in search.triples(g.claims, predicate="has_effect", object_="m").orderBy("id").collect()] == ["2", "4"]
    assert ask.route("Which treatment helps label a?", nodes)["intent"] == "clinical"
    assert ask.route("how do label a and label b relate?", nodes)["compare"] == ["a", "b"]
    assert ask.route("what evidence?", nodes, claim_context=("1",))["intent"] == "claim_evidence"
    assert ask.route("what about label m", nodes) == {"intent": "describe", "about": "m", "compare": []}
    assert ask.route("what about label asset", nodes)["intent"] == "asset"
    assert ask.route("label assets", nodes)["about"] is None
    assert ask.route("start here", nodes)["intent"] == "overview"
