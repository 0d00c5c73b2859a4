"""Candidates that only share phenotypes: ranks from places in lists, against a sort of all pairs."""

import dataclasses
import random

from pyspark.sql import functions as F
from test_reasoning import LOSS, claim, graph

from quillgraph.operators import explore, overlap, paths, state


def made(seed):
    """Sources and others with none to seven phenotypes, paths over three mechanisms, claims that differ in what backs them."""
    pick, claims = random.Random(seed), []
    for i in range(26):
        claims += [claim(f"p{i}-{p}-{k}", f"d{i}", "HAS_PHENOTYPE", f"ph{p}", negated=pick.random() < 0.1) for p in pick.sample(range(8), pick.choice([0, 1, 1, 2, 7])) for k in range(pick.choice([1, 2]))]
        for m in range(3):
            if pick.random() < 0.3:
                claims += [claim(f"v{i}-{m}", f"d{i}", "HAS_VARIANT", f"v{i}-{m}"), claim(f"e{i}-{m}", f"v{i}-{m}", "HAS_EFFECT", f"m{m}", LOSS, stances=(pick.choice(["supports", "contradicts"]),))]
    return claims


def judged_of(spark, g, sources):
    states = state.claim_states(g)
    every, wanted = paths.mechanism_paths(states), spark.createDataFrame([(s,) for s in sources], "disease string")
    return states, wanted, paths.judge_pairs(paths.path_pairs(every.join(wanted, "disease", "left_semi"), every))


def test_ranks_without_a_sort_of_pairs(spark, monkeypatch):
    """The same rows as those of a sort, with ties; of candidates that only share a phenotype none is written."""
    monkeypatch.setattr(overlap, "BLOCK", 3)
    for seed in (1, 2):
        g = graph(spark, made(seed))
        states, wanted, judged = judged_of(spark, g, [f"d{i}" for i in range(0, 26, 3)] + ["nobody"])
        whole = paths.candidates(judged, paths.shared_phenotypes(states, wanted))
        found = paths.ranked_candidates(judged, states, wanted)
        want = sorted(whole.select(*sorted(whole.columns)).collect(), key=repr)
        assert sorted(found.select(*sorted(whole.columns)).collect(), key=repr) == want and any(r.score == 5 and r.only for r in want) and any(r.score == 5 and not r.only for r in want)
        assert "Window" not in found.where("only IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()


def test_whole_explorations_write_no_row_for_a_shared_phenotype(spark, monkeypatch):
    """with the evidence, order by label, and nothing written but the candidates that share a path."""
    g = graph(spark, made(3))
    states, wanted, judged = judged_of(spark, g, [f"d{i}" for i in range(0, 26, 3)])
    plain = explore.with_evidence(explore.explored(judged, explore.shared_phenotype_claims(states, wanted), g.nodes), g.evidence)
    want = sorted(plain.collect(), key=lambda r: (r.disease, r.rank))
    written, sizes = explore.written, {}
    monkeypatch.setattr(explore, "written", lambda df, name: (out := written(df, name), sizes.update({name: out.count()}))[0])
    found = explore.explored_whole(judged, states, wanted, g.nodes, g.evidence).select(*plain.columns)
    for a, b in zip(sorted(found.collect(), key=lambda r: (r.disease, r.rank)), want, strict=True):
        a, b = a.asDict(recursive=True), b.asDict(recursive=True)
        assert a | {"claim_ids": sorted(a["claim_ids"])} == b | {"claim_ids": sorted(b["claim_ids"])}
    n_judged = judged.select("left_disease", "right_disease").distinct().count()
    assert sizes["candidates"] == sizes["judged_candidates"] == n_judged < len(want)


def test_evidence_told_with_the_states(spark, monkeypatch):
    """evidence goes along with claims and paths; the same rows as those of a join for each candidate's claims, whether a
    side holds more than is shared, its ids stand between the other's, or its evidence has no known source."""
    monkeypatch.setattr(overlap, "BLOCK", 3)
    for seed in (4, 5):
        g = graph(spark, made(seed))
        lost = g.evidence.limit(1).withColumns({"source_id": F.lit("lost"), "stance": F.lit("supports"), "review_status": F.lit("unreviewed")})
        g = dataclasses.replace(g, evidence=g.evidence.unionByName(lost))
        sources = [f"d{i}" for i in range(0, 26, 3)]
        states, wanted, judged = judged_of(spark, g, sources)
        spell = lambda e: F.concat_ws(" ", *[e[c] for c in ("claim_id", "source_id", "stance", "review_status")])
        plain = explore.with_evidence(explore.explored(judged, explore.shared_phenotype_claims(states, wanted), g.nodes), g.evidence)
        plain = plain.withColumns({"claim_ids": F.sort_array("claim_ids"), "evidence": F.array_sort(F.transform("evidence", spell))})
        told = state.claim_states(g, F.concat_ws(" ", "claim_id", "source_id", "stance", "review_status"))
        assert {r.id: r.state for r in told.collect()} == {r.id: r.state for r in states.collect()}
        every = paths.mechanism_paths(told)
        judged = paths.judge_pairs(paths.path_pairs(every.join(wanted, "disease", "left_semi"), every))
        found = explore.explored_whole(judged, told, wanted, g.nodes).select(*plain.columns)
        want = sorted(plain.collect(), key=lambda r: (r.disease, r.rank))
        assert sorted(found.collect(), key=lambda r: (r.disease, r.rank)) == want and any(len(r.phenotypes) > 1 for r in want)


def test_only_claims_on_mechanisms_that_a_source_reaches_get_a_state(spark):
    """F1 F2: the same pairs from fewer claims; claims with another predicate, or none, all stay."""
    more = [claim("i1", "d0", "INVOLVES", "m8", LOSS), claim("i2", "d5", "INVOLVES", "m8", LOSS), claim("i3", "d6", "INVOLVES", "m9", LOSS), claim("i4", "d7", "INVOLVES", "m9", LOSS), claim("x", "d0", None, "m9")]
    g = graph(spark, made(6) + more)
    wanted = spark.createDataFrame([("d0",), ("d3",)], "disease string")
    few = paths.on_reached(g.claims, wanted)
    pairs = []
    for claims in (g.claims, few):
        every = paths.mechanism_paths(state.claim_states(dataclasses.replace(g, claims=claims)))
        judged = paths.judge_pairs(paths.path_pairs(every.join(wanted, "disease", "left_semi"), every))
        pairs.append(sorted(map(repr, judged.select("left_claim_ids", "right_claim_ids", "mechanism", "status", "reasons", "differences").collect())))
    assert pairs[0] == pairs[1] != []
    on = {m for p in pairs[0] for m in ("m0", "m1", "m2", "m8") if f"'{m}'" in p}
    every = {r.id: r for r in g.claims.collect()}
    kept = {r.id for r in few.collect()}
    assert {"i1", "i2", "x"} <= kept and not {"i3", "i4"} & kept and "m8" in on
    assert all(i in kept for i, r in every.items() if r.predicate in ("HAS_VARIANT", "HAS_PHENOTYPE"))


def test_no_pair_of_paths_is_written_or_moved_with_its_claims(spark, monkeypatch):
    """statuses of pairs come from what each path says for itself; claim ids, states and assertions stay behind."""
    g = graph(spark, made(7))
    states, wanted, judged = judged_of(spark, g, [f"d{i}" for i in range(0, 26, 3)])
    plan = judged.select("left_disease", "right_disease", "mechanism", "status")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(plan) if "Join Inner" in line and "mechanism" in line)
    pairs = "\n".join(plan[: last + 1])
    assert "lambda" not in pairs and not any(c in pairs for c in ("claim_ids", "states", "assertions"))
    plans, before = {}, paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: (plans.update({name: 1}), before(df, name))[1])
    paths.ranked_candidates(judged, states, wanted)
    assert list(plans) == ["judged_candidates"]
