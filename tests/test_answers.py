"""Values carried through ordered rows, and follow-ups of conversations."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import answers, ranks


def plain(rows):
    out, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out[k, i] = last.get(k)
        if v is not None:
            last[k] = v
    return out


def test_values_are_carried_within_keys_however_many_parts_they_span(spark):
    r = random.Random(3)
    for share in (0.0, 0.9, 1.0):
        rows = [("hot" if r.random() < share else r.choice(["a", "m", "z", None]), i, r.choice([None, None, None, f"v{i}"])) for i in range(500)]
        found = ranks.carried(spark.createDataFrame(rows, "k string, i int, v string").repartition(5), "k", "i", last=F.col("v")).collect()
        assert {(x.k, x.i): x["last"] for x in found} == plain(rows) and len(found) == 500
    only = [("hot", i, "first" if i == 0 else None) for i in range(400)]
    found = ranks.carried(spark.createDataFrame(only, "k string, i int, v string").repartition(5), "k", "i", last=F.col("v"), twice=F.concat("v", "v")).collect()
    assert all((x["last"], x.twice) == ((None, None) if x.i == 0 else ("first", "firstfirst")) for x in found)
    assert ranks.carried(spark.createDataFrame([], "k string, i int, v string"), "k", "i", last=F.col("v")).collect() == []


def test_follow_ups_are_about_the_last_answer_that_is_none(spark):
    rows = [(0, "missing", "s0", 0, True), (1, "describe", "s1", 3, False), (2, "evidence", "s2", 7, True), (3, "clinical", "s3", 0, False), (4, "evidence", "s4", 7, True), (5, "conflict", "s5", 2, False), (6, "evidence", "s6", 7, True)]
    turns = spark.createDataFrame([(f"c:{t}", "c", t, i, "D", None, s, n, 1, f"first{s}" if n else None, i == "missing", a) for t, i, s, n, a in rows] + [("d:0", "d", 0, "evidence", "D", None, "x", 4, 1, "e", False, True), ("d:1", "d", 1, "evidence", "D", None, "y", 5, 1, "f", False, True)], "id string, conversation string, turn int, intent string, about string, other string, scope string, n_claims long, n_nodes long, first_claim string, missing boolean, asks boolean")
    found = {r.id: (r.intent, r.of, r.n_claims, r.first_claim) for r in answers.with_follow_ups(turns).collect()}
    assert found["c:0"] == ("missing", None, 0, None) and found["c:2"] == found["c:4"] == (answers.FOLLOW_UP, "s1", 3, "firsts1") and found["c:6"] == (answers.FOLLOW_UP, "s5", 2, "firsts5")
    assert found["d:0"] == ("evidence", None, 4, "e") and found["d:1"] == (answers.FOLLOW_UP, "x", 4, "e")


def test_only_what_turns_ask_about_is_explored(spark):
    """comparisons, connections and assets look at candidates; a description or a question about nothing does not."""
    rows = [("1", "compare", "a", "b"), ("2", "connections", "c", None), ("3", "asset", None, None), ("4", "describe", "d", None), ("5", "asset", "a", None)]
    found = answers.explored_diseases(spark.createDataFrame(rows, "scope string, intent string, about string, other string"))
    assert sorted(r.disease for r in found.collect()) == ["a", "c"]
