"""Scores, matching, bootstrap, audits and passages on small tables."""

import hashlib
import itertools
import random
import statistics

import pytest

from quillgraph.functions import text as fn
from quillgraph.operators import audit, passages, ranks, scoring
from quillgraph.sources import markup
from pyspark.sql import functions as F


def test_undefined_scores_are_null(spark):
    df = spark.createDataFrame([("x", True, True), ("x", True, None), ("y", False, False), ("z", False, True), ("z", None, True)], "g string, t boolean, p boolean")
    got = {r.g: r for r in scoring.micro(df, "t", "p", ["g"]).collect()}
    assert (got["x"].precision, got["x"].recall, round(got["x"].f1, 3)) == (1.0, 0.5, 0.667)
    assert (got["y"].precision, got["y"].recall, got["y"].f1) == (None, None, None) and got["z"].precision == 0.0
    m = scoring.macro(scoring.micro(df, "t", "p", ["g"])).first()
    assert (m.precision, m.n_precision, m.n_groups) == (0.5, 2, 3)


def test_matching_is_greatest():
    assert len(scoring.greatest_matching([("a", "x"), ("a", "y"), ("b", "x")])) == 2
    rng = random.Random(1)
    for _ in range(200):
        edges = {(p, g) for p in "abcd" for g in "wxyz" if rng.random() < 0.35}
        best = max(sum((p, g) in edges for p, g in zip("abcd", order, strict=True)) for order in itertools.permutations("wxyz"))
        got = scoring.greatest_matching(edges)
        assert len(got) == best and set(got) <= edges and len({p for p, _ in got}) == len({g for _, g in got}) == best


def test_matching_by_document(spark):
    df = spark.createDataFrame([("d", "a", "x"), ("d", "a", "y"), ("d", "b", "x"), ("e", "a", "x"), ("e", "b", "x")], "doc string, p string, g string")
    got = scoring.match_documents(df, "doc", "p", "g").groupBy("doc").count().collect()
    assert {r.doc: r["count"] for r in got} == {"d": 2, "e": 1}


def test_bootstrap(spark):
    rows = [("s1", 7, 0, 0), ("s2", 0, 0, 7)]
    got = {r.metric: r for r in scoring.bootstrap(spark.createDataFrame(rows, "cluster string, tp long, fp long, fn long"), draws=400, seed=3).collect()}
    undefined = 0
    for d in range(400):
        draw = [sorted(rows)[int(hashlib.md5(f"3:{d}:{i}".encode()).hexdigest()[:15], 16) % 2] for i in range(2)]
        undefined += not any(r[1] for r in draw)
    assert got["precision"].n_undefined == undefined > 0 and got["precision"].low == 1.0 and got["recall"].low == 0.0
    one = scoring.bootstrap(spark.createDataFrame(rows[:1], "cluster string, tp long, fp long, fn long")).collect()
    assert all(r.low is None or r.low != r.low for r in one)


def test_elements_at_ranks(spark):
    """One key has most rows, and most of its values are alike."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([1.5, 1.5, 1.5, rng.random() * 9, None])) for _ in range(3000)] + [("none", None)]
    found = {r.k: r for r in ranks.elements(spark.createDataFrame(rows, "k string, v double").repartition(6), "k", "v", first=lambda n: F.lit(1), mid=ranks.index_rank(0.5), p90=ranks.index_rank(0.9), over=lambda n: n + 1).collect()}
    assert set(found) == {"hot", "a", "b", None}
    for k, r in found.items():
        v = sorted(x for j, x in rows if j == k and x is not None)
        assert (r.n, r.first, r.mid, r.p90, r.over) == (len(v), v[0], v[int(0.5 * (len(v) - 1))], v[int(0.9 * (len(v) - 1))], None)
    middle = {r.k: r.median for r in ranks.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert middle == {k: statistics.median(x for j, x in rows if j == k and x is not None) for k in found}


def test_covering_spans(spark):
    df = spark.sql("""SELECT array(named_struct('unit_id', 'u', 'start', 0, 'end', 10)) AS p,
      array(array(named_struct('unit_id', 'v', 'start', 1, 'end', 2)), array(named_struct('unit_id', 'u', 'start', 0, 'end', 4), named_struct('unit_id', 'u', 'start', 5, 'end', 10))) AS g""")
    assert df.select(scoring.covers(F.col("p"), F.col("g"))).first()[0]
    assert not df.select(scoring.covers(F.col("p"), F.slice("g", 1, 1))).first()[0]


def test_agreement(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "z", 1), (3, "z", 2)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", 6), (2, "y", None), (3, "z", 1), (4, "q", 1)], "k int, f string, g int")
    got = {r.field: (r.n_pairs, r.n_equal) for r in scoring.anchored_agreement(a, b, ["k"], ["f", "g"]).collect()}
    assert got == {"f": (2, 2), "g": (2, 1)}
    sides = {r.k: (r.side, r.differing) for r in scoring.compare_annotators(a.where("k < 3"), b, ["k"], ["f", "g"]).collect()}
    assert sides == {1: ("both", ["g"]), 2: ("both", []), 3: ("b_only", None), 4: ("b_only", None)}


def test_trailing_counts_are_strict(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp '2024-01-01 00:00:00'), (2, timestamp '2024-01-01 00:30:00'), (3, timestamp '2024-01-01 01:00:00'), (4, timestamp '2024-01-01 01:29:59.999999'), (5, CAST(NULL AS TIMESTAMP)) AS t(id, ts)")
    assert {r.id: r.recent for r in audit.trailing_counts(df, "ts", "id", 3600).collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: None}


def test_submissions_and_pages(spark):
    df = spark.createDataFrame([("r", "x", 1), ("r", "x", 2), ("r", "y", 3), ("q", "x", 4)], "req string, body string, ord int")
    assert {r.ord: r.code for r in audit.submissions(df, "req", "body", "ord").collect()} == {1: 201, 2: 200, 3: 409, 4: 201}
    pages = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 4, "b"), ("w", 1, "a"), ("w", 2, "b")], "query string, page int, item string")
    got = {r.query: r for r in audit.pagination(pages, "query", "page", "item", F.lit(2)).collect()}
    assert (got["q"].n_missing_pages, got["q"].complete, got["w"].complete) == (1, False, True)


def test_word_chunks_cover_the_text(spark):
    text = " ".join(f"word{i}" for i in range(400)) + " " + "x" * 500
    got = passages.word_chunks(spark.createDataFrame([(1, text), (2, "  "), (3, None)], "id long, t string"), "id", "t", 200, 30).orderBy("chunk").collect()
    covered = set()
    for r in got:
        assert len(r.content) <= 200 and text[r.start : r.end] == r.content
        covered.update(range(r.start, r.end))
    assert all(i in covered or c.isspace() for i, c in enumerate(text)) and {r.id for r in got} == {1}


def chunk_ends(text, most, overlap):
    """Chunks by looking at every place on its own."""
    start, out = 0, []
    while text:
        word_ends = [e for e in range(1, len(text)) if text[e] == " " and max(start + most // 2, start + 1) <= e < start + most]
        end = len(text) if len(text) <= start + most else max(word_ends, default=start + most)
        out.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - overlap)
        start = next((i for i in range(start, end + 1) if text[i] != " " and text[i - 1] == " "), start)
    return out


def test_word_chunks_against_a_plain_version():
    rng = random.Random(8)
    for _ in range(400):
        text = " ".join("w" * rng.choice([1, 2, 3, 5, 9, 40]) for _ in range(rng.randrange(0, 40)))
        most = rng.randrange(2, 30)
        overlap = rng.randrange(0, most)
        assert list(passages.split_words(text, most, overlap)) == chunk_ends(text, most, overlap), (text, most, overlap)


def test_sections_between_markers(spark):
    df = spark.createDataFrame([(1, "x A: a1 a2 B: a3"), (2, "A: a4 C: a5 B: a6"), (3, "A: a7"), (4, None)], "id int, t string")
    assert {r.id: r.v for r in df.select("id", fn.section_tokens("t", "a[0-9]", "A:", "B:", "C:").alias("v")).collect()} == {1: ["a1", "a2"], 2: ["a4"], 3: ["a7"], 4: None}
    with pytest.raises(Exception, match="missing marker: Z:"):
        df.select(fn.required_section("t", "Z:")).collect()
    texts = spark.createDataFrame([("p.Glyly12Ala and Xyz Ser",), (None,)], "t string")
    assert [r[0] for r in texts.select(fn.short_residues("t")).collect()] == ["Gly12A and Xyz S", None]


def test_batches_start_where_a_row_does_not_fit(spark):
    rows = [("g", i, s) for i, s in enumerate([50, 60, 30, 10, 100, 1, 1, 1])] + [("h", 0, 5)]
    got = passages.greedy_batches(spark.createDataFrame(rows, "grp string, ord int, size int"), "grp", "ord", "size", 100, 3).orderBy("grp", "ord").collect()
    assert [r.batch for r in got] == [0, 1, 1, 1, 2, 3, 3, 3, 0]


def test_short_and_long_passages_are_located(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "xa b\nc d e f g h iy"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b c"), (2, "a b c d e f g h i"), (3, "absent words here"), (4, "")], "item_id long, text string")
    got = {(r.passage, r.id): (r.start, r.end) for r in passages.locate(asked, docs, "item_id", "text", "doc_id", "text").collect()}
    assert got == {(1, 1): (2, 5), (2, 1): (0, 17)}


def test_text_functions(spark):
    row = spark.createDataFrame([("p.Gly483Arg and G483R, not XG483RY", "1,234.5 ± 3", "30", "30.0", "https://u:p@x.example.org:99999/a?token=s&b=1#f", "2024-02-30")], "m string, n string, a string, b string, u string, d string")
    got = row.select(fn.substitutions("m").alias("m"), fn.leading_number("n").alias("n"), fn.same_number("a", "b").alias("same"), fn.redacted_url("u").alias("u"), fn.without_credentials("u").alias("safe"), fn.host_within("u", "example.org").alias("within"), fn.iso_date("d").alias("d"), fn.pmcid(F.lit("123")).alias("pmc"), fn.doi(F.lit("https://doi.org/10.1/AB")).alias("doi"), fn.canonical_json(F.lit('{"b": 1, "a": [2, null]}')).alias("json"), fn.canonical_uuid(F.lit("0" * 8 + "-0000-0000-0000-" + "0" * 12)).alias("uuid"), fn.between_markers(F.lit("xx<a>mid</a>"), "<a>", "</a>").alias("mid"), fn.index_percentile(F.array(*[F.lit(x) for x in (5, 1, 3, 2, 4)]), 0.9).alias("p")).first()
    assert got.m == ["G483R"] and got.n == 1234.5 and got.same and got.u.endswith("?token=REDACTED&b=1") and not got.safe and got.within and not got.d
    assert (got.pmc, got.doi, got.json, got.uuid, got.mid, got.p) == ("PMC123", "10.1/ab", '{"a":[2,null],"b":1}', True, "mid", 4)


def test_tables_in_their_grid(spark):
    html = '<table><tr><th rowspan="2">g</th><th colspan="2">h</th></tr><tr><td>1</td><td><img src="x"></td></tr><tr><td></td><td>5</td><td>6</td></tr></table>'
    got = markup.html_cells(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").orderBy("position").collect()
    assert [(r.row, r.column, r.text) for r in got] == [(1, 1, "g"), (1, 2, "h"), (2, 2, "1"), (2, 3, ""), (3, 1, ""), (3, 2, "5"), (3, 3, "6")]
    assert got[3].images == 1 and got[0].rowspan == 2


def test_units_links_and_trees(spark):
    page = "<nav><a href='/n'>n</a></nav><article><h1>T</h1><p>one <b>two</b></p><h2>S</h2><p>three<p>four<figcaption>cap</figcaption><a href='../x?y'>go</a></article><p>out</p>"
    pages = spark.createDataFrame([(1, page, "https://h/a/b/c")], "id long, html string, url string")
    assert [(r.kind, r.section, r.text) for r in markup.html_units(pages, "id", "html").orderBy("position").collect()] == [("paragraph", "T", "one two"), ("paragraph", "T > S", "three"), ("paragraph", "T > S", "four"), ("caption", "T > S", "cap")]
    assert [(r.url, r.text) for r in markup.html_links(pages, "id", "html", "url").collect()] == [("https://h/a/x?y", "go")]
    xml = "<article><front><abstract><p>sum</p></abstract></front><body><sec><title>M</title><p>x<i>y</i></p><ref-list><p>no</p></ref-list></sec></body></article>"
    jats = spark.createDataFrame([(1, xml)], "id long, xml string")
    assert [(r.section, r.text) for r in markup.jats_units(jats, "id", "xml").orderBy("position").collect()] == [("Abstract", "sum"), ("M", "xy")]
    assert '"attributes": {}' in markup.xml_trees(jats, "id", "xml").first().json
