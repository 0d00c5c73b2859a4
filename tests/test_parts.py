"""Tables dealt into parts in proportion to their rows."""

from pyspark.sql import functions as F

from quillgraph.operators import routes, spread, state
from quillgraph.plans import star_graph as star
from quillgraph.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_parts_grow_with_the_rows(spark, monkeypatch):
    """What a task sorts or hashes is a part of about PART_ROWS rows, not a share of the table."""
    usual = star.star_graph(spark, SF)
    monkeypatch.setattr(spread, "PART_ROWS", 100)
    cut = star.star_graph(spark, SF)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert usual.parts == 1 and cut.parts > most
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    asked = f", {cut.parts})"
    assert asked in plan(cut.claims) and asked not in plan(usual.claims)
    assert asked in plan(state.claim_states(cut)) and asked in plan(routes.neighbours(cut.claims, cut.parts))
    rows = lambda df: sorted(df.select("id", "state").collect())
    assert rows(state.claim_states(cut)) == rows(state.claim_states(usual))


def test_acknowledged_runs_without_a_join(spark):
    """gaps, repeats, nulls, negative numbers and a null key, in few or many parts."""
    acks = [("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 1), ("c", None), ("d", -1), ("d", 0), ("e", -1), (None, 0), (None, None)]
    rows = spark.createDataFrame(acks, "k string, b int")
    for parts in (None, 40):
        found = ingest.contiguous(rows, ["k"], "b", parts)
        assert {r.k: r.acknowledged for r in found.collect()} == {"a": 2, "b": 0, "c": 0, "d": 1, "e": 0, None: 1}
        assert found.select(F.count("*")).first()[0] == 6 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
