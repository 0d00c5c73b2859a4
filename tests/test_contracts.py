"""Bundles in files, literature records, annotation contracts, strict scores and the read-only answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.api import GraphApi
from quillgraph.functions import text as fn
from quillgraph.operators import annotations, bundle, validate
from quillgraph.sources import bundles, records, research

BUNDLE = {
    "schema_version": "1.0", "dataset": {"id": "d", "title": "t", "description": "x", "synthetic": False, "created_at": "2024-01-01"},
    "nodes": [{"id": "a", "type": "Disease", "label": "A", "aliases": ["one"], "properties": {"k": [1]}}, {"id": "v", "type": "Variant", "label": "V", "aliases": []}],
    "sources": [{"id": "s", "title": "t", "url": "https://example.org", "kind": "paper", "published_at": None, "retrieved_at": "2024-02-03", "synthetic": False, "license": "free"}],
    "claims": [{"id": "c", "subject": "a", "predicate": "HAS_VARIANT", "object": "v", "assertion_type": "reported", "context": {"effect": "unknown", "negated": False, "species": "mouse"}, "extraction_confidence": 0.5}],
    "evidence": [{"id": "e", "claim_id": "c", "source_id": "s", "locator": "p1", "excerpt": "x", "stance": "supports", "review_status": "human_reviewed"}],
    "coverage": [{"id": "k", "source_id": "s", "entity_id": "a", "scope": "all", "status": "searched", "searched_at": "2024-02-03", "notes": ""}],
}


def test_bundle_files(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps(BUNDLE))
    g, dataset = bundles.read_bundle(spark, str(path))
    assert validate.graph_violations(g, synthetic=False).collect() == [] and bundles.dataset_violations(dataset).collect() == []
    assert [r.ord for r in g.nodes.orderBy("ord").collect()] == [0, 1] and g.claims.first().species == "mouse" and g.claims.first().negated is False
    wrong = BUNDLE["dataset"] | {"created_at": "2024-13-01", "title": " "}
    path.write_text(json.dumps(BUNDLE | {"dataset": wrong, "schema_version": "2.0"}))
    assert {r.rule for r in bundles.dataset_violations(bundles.read_bundle(spark, str(path))[1]).collect()} == {"version", "title", "created_at"}
    path.write_text(json.dumps(BUNDLE)[:-1] + ', "nodes": []}')
    with pytest.raises(Exception, match="strict"):
        bundles.read_bundle(spark, str(path))[0].nodes.collect()


def test_literature(spark, tmp_path):
    xml = "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><ArticleTitle>A <i>b</i> c</ArticleTitle><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/z</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType='doi'>other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></Set>"
    found = research.citations(spark.createDataFrame([(1, xml), (2, xml)], "b int, xml string"), "b", "xml")
    r = research.latest_citations(found, "b").collect()
    assert len(r) == 1 and (r[0].pmid, r[0].title, r[0].abstract, r[0].doi, r[0].authors, r[0].year) == ("7", "A b c", "x\ny", "10.1/z", ["F L"], "2020")
    owl = research.root_records(spark.createDataFrame([(1, "<R xmlns:o='u'><o:Class id='1'/><o:Class id='2'><l>x</l></o:Class></R>")], "f int, xml string"), "f", "xml")
    assert [json.loads(x.json)["tag"] for x in owl.collect()] == ["Class", "Class"]
    html = "<meta name='citation_pmcid' content='PMC5'><main>" + "<p>" + "word " * 60 + "</p><p>a<p>b</main>"
    pages = research.article_pages(spark.createDataFrame([(1, html), (2, "<main><p>captcha</main>")], "id int, html string"), "id", "html")
    rows = {r.id: r.v for r in pages.withColumn("expected", F.lit("5")).withColumn("v", research.page_verdict("expected", 200)).collect()}
    assert rows == {1: "ok", 2: "challenge"}
    jats = spark.createDataFrame([("<a><article-id pub-id-type='pmc'>5</article-id><body><p>x</p></body></a>", "PMC5"), ("<a><article-id pub-id-type='pmc'>5</article-id><body/></a>", "5"), ("<a/>", "5")], "xml string, id string")
    assert [r.v for r in jats.select(research.body_verdict("xml", "id").alias("v")).collect()] == ["ok", "no_body", "other_article"]
    cache = spark.createDataFrame([("u", "GET", None, "c", "2e7d2c03a9507ae265ecf5b5356885a53393a2029d241394997265a1a25aefc6"), ("w", "GET", None, "c", "0")], "url string, method string, body string, content string, sha256 string")
    wanted = spark.createDataFrame([("u", "GET", None), ("u", "POST", None), ("w", "GET", None)], "url string, method string, body string")
    assert [r.cached for r in research.reusable(cache, wanted).orderBy("url", "method").collect()] == [True, False, False]
    (tmp_path / "x").write_text("abc")
    made = research.manifest_row("n", wanted, records.file_digests(spark, str(tmp_path / "x"))).first()
    assert (made.records, made.bytes) == (3, 3)
    with pytest.raises(Exception, match="no records"):
        research.manifest_row("n", wanted.limit(0), records.file_digests(spark, str(tmp_path / "x"))).collect()
    status = research.catalogue(spark.createDataFrame([("a",), ("b",)], "source string"), spark.createDataFrame([("a", 3), ("a", 4)], "source string, records long")).orderBy("source").collect()
    assert [(r.n_datasets, r.records, r.harvested) for r in status] == [(2, 7, True), (0, 0, False)]


def observation(id_, sets=None, evidence=None, **change):
    base = dict.fromkeys(annotations.CONTENT, None) | {"gene": "G", "variant": "V", "value": "30", "unit": "uM"} | change
    return {"id": id_, "document_id": "d", **base, "evidence_sets": sets, "evidence": evidence}


SCHEMA = "id string, document_id string, " + ", ".join(f"{c} string" for c in annotations.CONTENT) + ", evidence_sets array<array<struct<unit_id:string,start:int,end:int,quote:string>>>, evidence array<struct<unit_id:string,start:int,end:int,quote:string>>"


def table(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_strict_scores(spark):
    span = lambda a, b: ("u", a, b, "x")
    references = table(spark, [observation("x", sets=[[span(0, 4)], [span(8, 9)]]), observation("y", sets=[[span(5, 6)]], value="1e1"), observation("z", sets=[[span(0, 1)]], gene="H")])
    predictions = table(spark, [observation("a", evidence=[span(0, 5)], value="30.0", unit=" uM"), observation("b", evidence=[span(0, 9)], value="10"), observation("c", evidence=[span(1, 2)], gene="H")])
    got = annotations.strict_score(predictions, references).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1) and round(got.f1, 4) == 0.6667
    assert annotations.strict_score(predictions, references, evidence=False).first().tp == 3
    assert annotations.strict_score(table(spark, []), references).first().precision is None


def test_annotation_contracts(spark):
    units = spark.createDataFrame([("u", "d", "paragraph", "1", "exact text")], "unit_id string, document_id string, kind string, locator string, text string")
    assert annotations.units_digest(units).count() == 1
    manifest = spark.createDataFrame([("d", "held_out"), ("m", "held_out")], "document_id string, split string")
    documents = spark.createDataFrame([("d", ["p", "p"]), ("o", ["p", "q"])], "document_id string, annotators array<string>")
    observations = table(spark, [observation("x", sets=[[("u", 0, 5, "exact")]]), observation("y", sets=[[("u", 0, 5, "wrong")]])])
    decisions = spark.createDataFrame([("c", "supports", []), ("k", "unresolved", ["zz"])], "case_id string, label string, observation_ids array<string>")
    got = {(r.rule, r.key) for r in annotations.reference_violations(documents, observations, decisions, units, manifest, "held_out").collect()}
    assert got == {("not_covered", "m"), ("outside_split", "o"), ("same_annotator", "d"), ("span", "y"), ("repeated_content", "y"), ("undecided_evidence", "c"), ("unknown_observation", "k")}
    run = spark.createDataFrame([("r", "0" * 40, "0" * 64, "x")], "id string, code_commit string, prompt_sha256 string, configuration_sha256 string")
    wrong = spark.createDataFrame([("c", "maybe"), ("q", "abstain")], "case_id string, label string")
    got = {(r.rule, r.key) for r in annotations.prediction_violations(table(spark, [observation("x")]), documents.where("document_id = 'o'"), wrong, decisions.where("case_id = 'c'"), run).collect()}
    assert got == {("unknown_document", "x"), ("unknown_case", "q"), ("label", "c"), ("digest", "r")}
    cells = spark.createDataFrame([("d", "t", 1, 1), ("d", "t", 1, 2), ("d", "t", 1, 3)], "document_id string, table_id string, row int, column int")
    used = spark.createDataFrame([("d", "t", 1, 1), ("d", "t", 1, 2), ("d", "t", 1, 2), ("d", "t", 9, 9), ("d", None, None, None)], "document_id string, table_id string, row int, column int")
    assert {(r.row, r.column, r.problem) for r in annotations.cell_coverage(cells, used).collect()} == {(1, 2, "several"), (1, 3, "missing"), (9, 9, "out_of_scope")}


def test_answers(spark):
    api = GraphApi(bundle.synthetic(spark, 3, 6))
    assert api.request("POST", "/api/search")[0] == 405 and api.request("GET", "/nowhere")[0] == 404
    assert api.request("GET", "/api/search", {"q": ["a", "b"]}) == (400, {"error": "missing_query"})
    assert api.request("GET", "/api/search", {"q": ["disease-1"]})[1]["nodes"][0]["id"] == "disease-1"
    assert api.request("GET", "/api/explore", {"disease": ["zz"]})[0] == 404 and api.request("GET", "/api/explore", {"disease": ["variant-1"]})[0] == 400
    code, body = api.request("GET", "/api/explore", {"disease": ["disease-0"]})
    assert code == 200 and body["status"] == "no_supported_route" and body["candidates"]
    lead = body["candidates"][0]
    assert lead["rank"] == 1 and lead["assessments"][0]["claim_ids"] and lead["evidence"][0]["source_id"] == "generator" and body["gaps"] and body["n_candidates"] >= len(body["candidates"])
    code, body = api.request("GET", "/api/claim", {"id": ["v:0"]})
    assert code == 200 and len(body["support"]) == 1 and body["sources"] == ["generator"]
    assert api.request("GET", "/api/ask", {"q": ["x" * 1001]})[0] == 400 and api.request("GET", "/api/ask", {"q": ["what is disease-1?"]})[1]["about"] == "disease-1"
    assert api.request("GET", "/api/stats")[1]["sources"] == 1
    assert api.request("GET", "/api/ask", {"q": ["which evidence?"], "claim": ["no such claim"]}) == (400, {"error": "invalid_claim_context"})
    assert api.request("GET", "/api/ask", {"q": ["any conflict?"]})[1]["n_claims"] == 0


def test_tables_come_in_pages(spark, monkeypatch):
    api = GraphApi(bundle.synthetic(spark, 3, 6))
    monkeypatch.setattr("quillgraph.api.MOST_ANSWERS", 7)
    seen, after = [], None
    while True:
        code, body = api.request("GET", "/api/graph", {"table": ["claims"], **({"after": [after]} if after else {})})
        seen += [r["id"] for r in body["rows"]]
        assert code == 200 and len(body["rows"]) <= 7 and body["total"] == api.graph.claims.count()
        if (after := body["next"]) is None:
            break
    assert seen == sorted(r.id for r in api.graph.claims.collect())
    assert api.request("GET", "/api/graph", {"table": ["secrets"]})[0] == 404


def test_more_text_functions(spark):
    row = spark.createDataFrame([("Straße", '{"b": 1, "a": 2}')], "s string, j string").select(fn.casefold("s").alias("s"), fn.has_keys("j", ["a", "b"]).alias("k"), fn.has_keys("j", ["a"]).alias("n")).first()
    assert (row.s, row.k, row.n) == ("strasse", True, False)
