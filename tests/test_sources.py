"""Readers on small files, paging, streaming."""

import gzip
import io
import json
import zipfile
from datetime import date

import pytest

from quillgraph.sources import markup, paging, records
from quillgraph.streaming import inbox


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        data = text if isinstance(text, bytes) else text.encode()
        path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(path)

    return write


def test_lines_are_numbered_over_blocks(spark, put):
    path = put("l.txt", "\n".join(f"line {i}" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = records.lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2000 and all(r.value == f"line {r.line}" for r in got)


def test_json_lines(spark, put):
    path = put("a.jsonl.gz", '﻿{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [(r.a, r.b) for r in records.json_lines(spark, path, "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(Exception, match="not strict JSON|JSON"):
            records.json_lines(spark, put("bad.jsonl", bad), "a int").collect()
    assert [r.a for r in records.json_array(spark, put("b.json", '{"items": [{"a": 1}, {"a": 2}]}'), "a int", "items").collect()] == [1, 2]


def test_delimited_files(spark, put):
    path = put("c.tsv", "# made by us\n#id\tname\n1\tx\n\n# note\n2\t\n")
    assert [tuple(r) for r in records.commented_tsv(spark, path).orderBy("id").collect()] == [("1", "x"), ("2", "")]
    assert records.commented_tsv(spark, put("d.tsv", "# c\nid\tname\n1\tx\n")).columns == ["id", "name"]
    with pytest.raises(ValueError, match="no header"):
        records.commented_tsv(spark, put("e.tsv", "# only\n"))
    assert [tuple(r) for r in records.named(spark, put("f.tsv", "1\t2\t3\n4\n"), ["a", "b"]).orderBy("a").collect()] == [("1", "2"), ("4", None)]
    assert records.delimited(spark, put("g.txt", "a|b\n1|2\n"), "|").first().b == "2"
    export = put("h.csv", 'title\n\nmore\nx\na,b\n---,---\n1,"2,5"\n3,4\nTotal: 2\nend\n')
    assert [tuple(r) for r in records.after_preamble(spark, export, 4, footer="Total").orderBy("a").collect()] == [("1", "2,5"), ("3", "4")]
    with pytest.raises(Exception, match="does not have 2 fields"):
        records.after_preamble(spark, put("i.csv", "a,b\n-\n1,2,3\n"), 0).collect()


def test_fixed_formats(spark, put):
    row = "\t".join(f"v{i}" for i in range(17))
    got = records.associations(spark, put("a.gaf", f"!gaf\n{row.replace('v3', 'NOT')}\nshort\trow\n")).collect()
    assert len(got) == 1 and got[0].qualifier == "NOT" and got[0].gene_product_form_id == "v16"
    found = records.positional(spark, put("p.rpt", "a\tb\t\nc\td\n"), ["x", "y"]).orderBy("source_line").collect()
    assert [(r.x, r.y, r.source_line) for r in found] == [("a", "b", 1), ("c", "d", 2)]
    with pytest.raises(Exception, match="declared columns"):
        records.positional(spark, put("q.rpt", "a\tb\tmore\n"), ["x", "y"]).collect()
    obo = records.stanzas(spark, put("o.obo", "format-version: 1.2\n\n[Term]\nid: X:1\nsynonym: a\nsynonym: b\n\n[Term]\nid: X:2\nis_obsolete: true\n")).collect()
    assert [r.stanza for r in obo] == ["header", "Term", "Term"] and obo[1].tags["synonym"] == ["a", "b"] and obo[2].tags["is_obsolete"] == ["true"]


def test_phenotype_annotations(spark, put):
    head = "\t".join(records.HPOA_COLUMNS)
    rows = ["D:1\tn\t\tHP:1\tr\te\t\t", "D:1\tn\tNOT\tHP:2\tr\te\t\t", "D:1\tn\t\tHP:1\tr\te\t\t"]
    got = records.phenotype_annotations(spark, put("h.tsv", "#c\n" + head + "\n" + "\n".join(rows) + "\n")).orderBy("line").collect()
    assert [(r.hpo_id, r.negated, r.line) for r in got] == [("HP:1", False, 3), ("HP:2", True, 4)]
    for bad in (rows[0].replace("HP:1", "HP:x"), rows[1].replace("NOT", "MAYBE"), "D:1\tn"):
        with pytest.raises(Exception, match="malformed"):
            records.phenotype_annotations(spark, put("b.tsv", head + "\n" + bad + "\n")).collect()
    with pytest.raises(ValueError, match="lacks"):
        records.phenotype_annotations(spark, put("n.tsv", "a\tb\n1\t2\n"))


def test_archives_and_xml(spark, put):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.json", json.dumps([{"b": 1, "a": "é"}, {"c": 2}]))
        z.writestr("readme.txt", "no")
    path = put("r.zip", buffer.getvalue())
    assert [r.json for r in records.zipped_json(spark, path).orderBy("position").collect()] == ['{"a": "é", "b": 1}', '{"c": 2}']
    assert records.file_digests(spark, path).first().bytes == len(buffer.getvalue())
    xml = put("x.xml", '<r><item id="1"><name>a</name></item><item id="2"><name>b</name></item></r>')
    assert [(r._id, r.name) for r in markup.xml_rows(spark, xml, "item", "_id string, name string").orderBy("_id").collect()] == [("1", "a"), ("2", "b")]


def test_pages_are_followed(spark):
    def fetch(query, token):
        page = int(token or 0)
        return [f"{query}{page}{i}" for i in range(2 if page < 2 else 0)], str(page + 1) if page < 2 else None

    got = paging.follow_pages(spark.createDataFrame([("q",), ("w",)], "query string"), fetch).collect()
    assert len(got) == 10 and {r.payload for r in got if r["query"] == "q"} == {"q00", "q01", "q10", "q11", None}


def test_terms_and_ranges():
    assert paging.term_batches(["aa", "bbb", "c", "dddd"], 16, 2) == [["aa", "bbb"], ["c", "dddd"]]
    days = {date(2020, 2, d): 3 for d in range(1, 29)} | {date(2021, 7, 1): 50}
    count = lambda a, b: sum(n for d, n in days.items() if a <= d <= b)
    got = paging.split_ranges(date(2019, 1, 1), date(2022, 12, 31), count, 20)
    assert sum(n for *_, n in got) == count(date.min, date.max) and all(n <= 20 or a == b for a, b, n in got)
    assert got[0][0] == date(2019, 1, 1) and got[-1][1] == date(2022, 12, 31) and all((b[0] - a[1]).days == 1 for a, b in zip(got, got[1:], strict=False))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("r", "x", 1, "2024-01-01 00:00:00"), ("r", "x", 2, "2024-01-01 00:01:00"), ("q", "y", 3, "2024-01-01 00:02:00")]
    schema = "req string, body string, ord long, ts timestamp_ntz"
    spark.sql(f"SELECT * FROM VALUES {', '.join(f'({r[0]!r}, {r[1]!r}, {r[2]}L, timestamp_ntz {r[3]!r})' for r in rows)} AS t(req, body, ord, ts)").write.parquet(f"{folder}/1")
    spark.sql("SELECT 'r' AS req, 'z' AS body, 4L AS ord, timestamp_ntz '2024-01-01 02:00:00' AS ts").write.parquet(f"{folder}/2")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{folder}/*")

    def results(df, mode):
        query = df.writeStream.format("memory").queryName("out").outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        return spark.table("out").collect()

    codes = {r.order: r.code for r in results(inbox.submission_codes(stream(), "req", "body", "ord"), "append")}
    assert codes == {1: 201, 2: 200, 3: 201, 4: 409}
    counted = results(inbox.windowed_counts(stream(), "ts", "req", "10 minutes", "10 minutes"), "complete")
    assert {(r.req, r.n) for r in counted} == {("r", 2), ("q", 1), ("r", 1)}
    query = stream().writeStream.foreachBatch(inbox.upsert(str(tmp_path / "up"), "req", "ord")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.req: r.body for r in spark.read.parquet(str(tmp_path / "up/v=0")).collect()} == {"r": "z", "q": "y"}


def test_prefixes_are_split():
    ids = [f"{i:04d}" for i in range(0, 3000, 3)]
    parts = paging.split_prefixes(lambda p: sum(i.startswith(p) for i in ids), 100)
    assert sum(n for _, n in parts) == 1000 and max(n for _, n in parts) <= 100 and len({p for p, _ in parts}) == len(parts)
    assert paging.split_prefixes(lambda p: 0, 10) == []
    with pytest.raises(ValueError):
        paging.split_prefixes(lambda p: 500 if not p else 1, 100)


def test_refused_batches_are_halved(spark):
    def fetch(terms):
        if len(terms) > 2 or "bad" in terms:
            raise paging.Refused("too complicated")
        if "down" in terms:
            raise OSError("no answer")
        return [t for t in terms if t != "none"]

    batches = spark.createDataFrame([(["a", "b", "c", "bad", "d"],), (["none"],), (["down", "e"],)], "terms array<string>")
    got = paging.fetch_batches(batches, fetch).collect()
    assert sorted(r.payload for r in got if r.payload) == ["a", "b", "c", "d"]
    assert {(tuple(r.terms), r.error) for r in got if r.error} == {(("bad",), "too complicated"), (("down", "e"), "no answer")}
    assert [r.terms for r in got if not r.payload and not r.error] == [["none"]]
