"""Values of any depth, spans in them, and tables built again."""

import json
from collections import Counter

from quillgraph.operators import nested, rebuilt


def plain(value, path="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "bigint"}.get(type(value))
    yield path, kind
    for k, v in value.items() if kind == "object" else enumerate(value) if kind == "array" else ():
        yield from plain(v, f"{path}.{k}" if kind == "object" else f"{path}[{k}]")


def test_every_value_at_any_depth(spark):
    deep = 1
    for _ in range(30):
        deep = {"a": [deep, None]}
    values = [{"a": 1, "b": [True, {"c": None, "d e": "x"}], "f": {}, "g": []}, [], "text", 7, None, deep, [[[]]]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, "{no json"), (102, "")], "id int, text string")
    found = nested.walk(rows, "id", "text").collect()
    for i, v in enumerate(values):
        assert sorted((r.path, r.kind) for r in found if r.id == i) == sorted(plain(v))
    assert {(r.id, r.kind) for r in found if r.id >= 100} == {(100, "problem"), (101, "problem"), (102, "problem")}
    assert {(r.shape, r.kind, r.text) for r in nested.leaves(nested.walk(rows.where("id = 0"), "id", "text")).collect()} == {("$.a", "bigint", "1"), ("$.b[*]", "boolean", "true"), ("$.b[*].c", "null", None), ("$.b[*].d e", "string", "x")}
    assert nested.walk(rows.limit(0), "id", "text").collect() == []


def test_spans_wherever_they_are(spark):
    good = {"unit_id": "u", "start": 0, "end": 4, "quote": "text"}
    value = {"a": [good, {"b": {"c": [good | {"more": [good]}]}}], "d": good | {"start": 5}, "e": good | {"start": None}, "f": {k: v for k, v in good.items() if k != "quote"}, "g": good | {"end": "4"}}
    found = {r.path: (r.unit_id, r.start, r.end, r.quote, r.shaped) for r in nested.spans(spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps(good)), (3, None)], "id int, text string"), "id", "text").where("id = 1").collect()}
    assert found == {"$.a[0]": ("u", 0, 4, "text", True), "$.a[1].b.c[0]": ("u", 0, 4, "text", True), "$.d": ("u", 5, 4, "text", False), "$.e": ("u", None, 4, "text", False), "$.g": ("u", 0, 4, "text", False)}


def test_a_round_goes_several_depths_and_writes_no_value_on_the_way(spark, monkeypatch):
    """Six depths were six tables of all values; now one of the counts, or of the spans alone."""
    tables, write = [], nested.written
    monkeypatch.setattr(nested, "written", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    span = {"unit_id": "u", "start": 0, "end": 4, "quote": "text"}
    values = [{"key": i, "lines": [{"part": None, "at": {"span": span | {"end": i}}}, {}, [], 1.25, "x"] * i} for i in range(4)] + [None, "no", {}]
    rows = spark.createDataFrame([(i, v if v in (None, "no") else json.dumps(v)) for i, v in enumerate(values)], "id int, text string")
    for steps in (8, 2):
        monkeypatch.setattr(nested, "STEPS", steps)
        tables.clear()
        found = {(r.shape, r.kind): (r.n, r.least) for r in nested.leaf_shapes(rows, "text").collect()}
        assert found == {
            ("$.key", "bigint"): (4, "0"), ("$.lines[*]", "decimal"): (6, "1.25"), ("$.lines[*]", "string"): (6, "x"), ("$.lines[*].part", "null"): (6, None), ("$.lines[*].at.span.unit_id", "string"): (6, "u"),
            ("$.lines[*].at.span.start", "bigint"): (6, "0"), ("$.lines[*].at.span.end", "bigint"): (6, "1"), ("$.lines[*].at.span.quote", "string"): (6, "text"),
        }
        if steps == 8:
            assert [n for n, _ in tables] == ["shapes"]
        tables.clear()
        assert Counter((r.id, r.shaped) for r in nested.spans(rows, "id", "text").collect()) == {(1, True): 1, (2, True): 2, (3, True): 3}
        if steps == 8:
            assert [(n, t.count()) for n, t in tables] == [("values", 6)]


def test_tables_are_compared_as_bags(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 1.5), (3, "c", 0.0)]
    schema = "x int, y string, z double"
    table = lambda r: spark.createDataFrame(r, schema)
    assert rebuilt.row_differences(table(rows), table(rows[::-1]).select("z", "x", "y")).collect() == []
    changed = [(1, "a", None), (2, 1.5 and None, 1.5), (3, "c", 0.25), (3, "c", 0.25), (None, None, None)]
    found = {json.loads(r.row)["x"] if "x" in r.row else None: r.times for r in rebuilt.row_differences(table(rows), table(changed)).where("times < 0").collect()}
    assert found == {1: -1, 3: -1}
    more = {(json.loads(r.row)["x"], r.times) for r in rebuilt.row_differences(table(rows), table(changed)).where("times > 0").collect()}
    assert more == {(3, 2), (None, 1)}
    assert not rebuilt.row_differences(table([(1, None, None)]), table([(None, "1", None)])).isEmpty()
    out = {r.name: r for r in rebuilt.compared({"same": table(rows), "gone": table(rows), "other": table(rows)}, {"same": table(rows), "new": table(rows[:1]), "other": table(changed)}).collect()}
    assert (out["same"].equal, out["same"].n_committed, out["same"].n_removed) == (True, 4, 0) and (out["gone"].equal, out["gone"].n_removed, out["gone"].n_rebuilt) == (False, 4, 0)
    assert (out["new"].equal, out["new"].n_added) == (False, 1) and (out["other"].equal, out["other"].n_removed, out["other"].n_added) == (False, 2, 3)
