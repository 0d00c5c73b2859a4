"""Whole jobs whose work grows no faster than what they give."""

from test_reasoning import BASE, claim, graph

from quillgraph.operators import audit, paths, routes, select, state
from quillgraph.storage import written


def test_every_pair_of_rows_that_share_a_reference(spark):
    """classes are expanded into all pairs of their rows."""
    refs = {1: "x|y", 2: "y|x", 3: "y", 4: "z", 5: "z|w", 6: "w", 7: "", 8: "z"}
    classes = written(select.reference_classes(spark.createDataFrame(list(refs.items()), "id int, names string"), "id", "names", r"\|"), "classes")
    found = [(r.left, r.right) for r in select.expanded_references(select.cross_references(classes, classes), classes).collect()]
    sets = {i: set(t.split("|")) - {""} for i, t in refs.items()}
    assert sorted(found) == sorted((a, b) for a in refs for b in refs if sets[a] & sets[b])


def test_a_trailing_count_is_a_running_sum(spark):
    """no frame of a moving width, which is summed anew for each row."""
    rows = spark.sql("SELECT id, timestamp_seconds(pmod(hash(id), 500)) AS ts FROM range(300)")
    found = audit.trailing_counts(rows, "ts", "id", 60)
    assert "-59999999" not in found._jdf.queryExecution().toString()
    at = {r.id: r.ts.timestamp() for r in rows.collect()}
    assert {r.id: r.recent for r in found.collect()} == {i: sum(t - 60 < x <= t for x in at.values()) for i, t in at.items()}


def test_each_ancestor_is_written_once(spark, monkeypatch):
    """F16: a pair of a tree is made in one step only; of several ways to an ancestor the shortest counts."""
    sizes = []
    monkeypatch.setattr(select, "written", lambda df, name: (out := written(df, name), sizes.append(out.count()))[0])
    parents = [(i, i // 2) for i in range(2, 70)]
    found = {(r.child, r.ancestor): r.distance for r in select.ancestors(spark.createDataFrame(parents, "child int, parent int")).collect()}
    assert found == {(i, i >> k): k for i in range(2, 70) for k in range(1, i.bit_length())} and sum(sizes) == len(found)
    ways = [(9, 8), (8, 7), (7, 6), (6, 5), (9, 6), (5, 4), (8, 4)]
    assert {(r.child, r.ancestor): r.distance for r in select.ancestors(spark.createDataFrame(ways, "child int, parent int")).where("child = 9").collect()} == {(9, 8): 1, (9, 6): 1, (9, 7): 2, (9, 5): 2, (9, 4): 2}


def test_routes_need_no_ranks_and_only_candidates_with_assets(spark):
    """The candidates that can have a route are told before pairs are made."""
    claims = BASE + [claim("8", "a", "HAS_PHENOTYPE", "ph"), claim("9", "b", "HAS_PHENOTYPE", "ph"), claim("10", "c", "HAS_PHENOTYPE", "ph"), claim("40", "asset", "RELEVANT_TO", "c")]
    states, wanted = state.claim_states(graph(spark, claims)), spark.createDataFrame([("a",)], "disease string")
    every = paths.mechanism_paths(states)
    judged = paths.judge_pairs(paths.path_pairs(every.where("disease = 'a'"), every))
    whole = paths.candidates(judged, paths.shared_phenotypes(states, wanted)).select("disease", "other", "status")
    assert sorted(paths.linked(judged, paths.shared_phenotypes(states, wanted)).collect()) == sorted(whole.collect())
    with_assets = paths.linked(judged, paths.shared_phenotypes(states, wanted, routes.with_assets(states)))
    assert sorted(routes.asset_routes(states, with_assets).collect()) == sorted(routes.asset_routes(states, whole).collect()) != []
