"""Graphs made from tables and by rule, clusters, and small curating operators."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import bundle, cluster, select, validate
from quillgraph.sources import records

SOURCE = {"id": "hp", "title": "annotations", "url": "https://example.org/hp", "retrieved_at": "2024-05-06", "license": "free"}


def test_annotations_become_a_valid_graph(spark, tmp_path):
    rows = ["D:1\tone\t\tHP:1\tr\te\tearly\t", "D:1\tone\tNOT\tHP:2\tr\te\t\t", "D:2\ttwo\t\tHP:1\tr\te\t\toften", "D:1\tone\t\tHP:1\tr\te\tearly\t"]
    path = tmp_path / "a.tsv"
    path.write_text("\t".join(records.HPOA_COLUMNS) + "\n" + "\n".join(rows) + "\n")
    g = bundle.from_annotations(records.phenotype_annotations(spark, str(path)), SOURCE)
    assert validate.graph_violations(g, synthetic=False).collect() == []
    assert (g.nodes.count(), g.claims.count(), g.evidence.count(), g.coverage.count()) == (4, 3, 3, 2)
    assert g.claims.where("negated").count() == 1


def test_graphs_by_rule_are_valid(spark):
    g = bundle.synthetic(spark, 4, 10)
    assert validate.graph_violations(g, synthetic=True).collect() == []
    assert g.nodes.where("type = 'Disease'").count() == 40


def test_only_exact_quotes_are_accepted(spark):
    g = bundle.synthetic(spark, 2, 2)
    units = spark.createDataFrame([("u", "😀 some text")], "unit_id string, text string")
    rows = [("v:0", "generator", "u", 2, 6, "some"), ("v:0", "generator", "u", 2, 6, "some"), ("v:0", "generator", "u", 2, 6, "same"), ("v:0", "generator", "u", 5, 99, "text"), ("v:0", "generator", "zz", 0, 1, "x")]
    proposals = spark.createDataFrame(rows, "claim_id string, source_id string, unit_id string, start int, end int, quote string")
    after, rejected = bundle.accept_proposals(g, proposals, units)
    assert after.evidence.count() == g.evidence.count() + 1 and rejected.count() == 3
    again, _ = bundle.accept_proposals(after, proposals, units)
    assert again.evidence.count() == after.evidence.count() and validate.graph_violations(again).collect() == []


def test_tiers_and_ratios(spark):
    m = lambda e, unit="uM", relation="eq": (e, unit, relation)
    schema = "gene string, protein string, document_id string, endpoint string, measurement_type string, measurement struct<estimate:string,unit:string,relation:string>, comparator struct<estimate:string,unit:string,relation:string>"
    obs = [("G", "p.Gly1Arg", "d", "glutamate_ec50", "measured", m("4"), m("2")), ("G", "p.Ala2Thr", "d", "open_probability", "measured", m("1"), m("4")), ("G", "p.Ala3Thr", "d", "open_probability", "measured", m("1", relation="lt"), m("4")), ("G", "p.Ala4Thr", "e", "zinc_ic50", "author_calculated", m("1"), None)]
    df = spark.createDataFrame(obs, schema)
    assert [r.x for r in df.select(cluster.measured_ratio().alias("x")).collect()] == [0.5, 0.25, None, None]
    claim = lambda p, c, t="primary_report": ("G", p, "author_functional_classification", t, c)
    claims = spark.createDataFrame([claim("p.Gly1Arg", "Likely LoF"), claim("p.Ala2Thr", "Possible LoF"), claim("p.Ala3Thr", "Likely LoF"), claim("p.Ala4Thr", "GoF"), claim("p.Ala5Thr", "GoF"), claim("p.Ala5Thr", "LoF"), claim("p.Ala6Thr", "LoF", "secondary")], "gene string, protein string, predicate string, evidence_type string, category string")
    got = {r.protein[2:]: (r.tier, r.n_ratios) for r in cluster.member_tiers(claims, df).collect()}
    assert got == {"Gly1Arg": ("core_likely_reduced", 1), "Ala2Thr": ("provisional_possible_reduced", 1), "Ala3Thr": ("provisional_possible_reduced", 0), "Ala4Thr": ("opposing_control", 0), "Ala5Thr": ("unresolved_control", 0), "Ala6Thr": ("unresolved_control", 0)}
    issues = spark.createDataFrame([("G", "p.Gly1Arg", "d", "own"), (None, None, "e", "general")], "gene string, protein string, document_id string, description string")
    assert {(r.protein, r.description) for r in cluster.scoped_issues(issues, df).collect()} == {("p.Gly1Arg", "own"), ("p.Ala4Thr", "general")}
    asked = spark.createDataFrame([(1, "What of G1R and p.Ala9Thr?")], "id int, q string")
    assert {(r.variant, r.known) for r in cluster.asked_variants(asked, df, "id", "q").collect()} == {("G1R", True), ("A9T", False)}


def test_small_operators(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert select.exactly_one(one, F.col("k") == 1, "k").first().v == "a"
    with pytest.raises(Exception, match="2 rows"):
        select.exactly_one(one, F.col("k") == 2, "k").collect()
    with pytest.raises(ValueError, match="cycle"):
        select.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child int, parent int"))
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "child int, parent int")
    assert select.ancestors(chain).count() == 20 * 21 // 2
    assert select.native(spark.createDataFrame([(1, "x")], "_record int, v string")).first().native.v == "x"
