"""Ordered ingest: batches by their bounds, interruptions, resumption, read-back."""

import json
from pathlib import Path

import pytest

from quillgraph.streaming import ingest as I


def receiver(folder, fail=(), log=True):
    """Writes each row to a file named by its id; fails for batches that hold one of the ids `fail`, as long as a file says so."""

    def send(rows):
        path = Path(folder)
        if any(r["id"] in fail for r in rows) and (path / "broken").exists():
            raise OSError("no route")
        for r in rows:
            (path / f"{r['id']}.json").write_text(json.dumps(r))
        with open(path / "log", "a") as out:
            out.write(f"{rows[0]['id']}-{rows[-1]['id']}\n")
        return f"t{rows[0]['id']}"

    return send


def export(spark, n=250, size=10):
    return I.in_batches(spark.createDataFrame([(i, "x" * size, None if i % 3 else "v") for i in range(n)], "id long, text string, more string"), "id", most_rows=10)


def test_batches_keep_all_bounds(spark):
    rows = [(i, "é" * (i % 50)) for i in range(400)]
    found = I.in_batches(spark.createDataFrame(rows, "id long, text string").repartition(7), "id", most_bytes=900, most_rows=12).orderBy("id").collect()
    size = lambda r: len(json.dumps({"id": r.id, "text": r.text}, ensure_ascii=False, separators=(",", ":")).encode())
    assert [r.batch for r in found] == sorted(r.batch for r in found) and {r.batch for r in found} == set(range(found[-1].batch + 1))
    groups = [[r for r in found if r.batch == b] for b in range(found[-1].batch + 1)]
    assert all(len(g) <= 12 and sum(map(size, g)) <= 900 for g in groups)
    assert all(len(g) == 12 or sum(map(size, g)) + size(h[0]) > 900 for g, h in zip(groups, groups[1:], strict=False))
    with pytest.raises(Exception, match="over 100 bytes: 7"):
        I.in_batches(spark.createDataFrame([(7, "x" * 200)], "id long, text string"), "id", most_row=100).collect()


def test_an_interrupted_ingest_goes_on_without_loss_or_repeat(spark, tmp_path):
    target, root = tmp_path / "target", f"file://{tmp_path}/state"
    target.mkdir()
    (target / "broken").touch()
    rows = export(spark)
    send = receiver(target, fail={75})
    with pytest.raises(I.Interrupted, match="batch 7: OSError: no route"):
        I.ingest(rows, send, "id", root, at_once=5)
    kept = I.acknowledgements(spark, root)
    assert sorted(r.batch for r in kept.where("error IS NULL").collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert I.contiguous(kept.where("error IS NULL"), [], "batch").first().acknowledged == 7
    (target / "broken").unlink()
    (target / "log").unlink()
    assert I.ingest(rows, send, "id", root, at_once=5) == 18  # batches 7 to 24: 8 and 9 once more, 0 to 6 not again
    assert sorted(int(x.split("-")[0]) // 10 for x in (target / "log").read_text().split()) == list(range(7, 25))
    received = [json.loads(p.read_text()) for p in target.glob("*.json")]
    assert sorted(r["id"] for r in received) == list(range(250))
    back = spark.createDataFrame([(r["id"], r["text"], r["more"]) for r in received], "id long, text string, more string")
    assert I.read_back(rows, back, "id").collect() == []
    assert I.ingest(rows, send, "id", root) == 0


def test_a_driver_that_dies_between_rounds(spark, tmp_path, monkeypatch):
    target, root = tmp_path / "target", f"file://{tmp_path}/state"
    target.mkdir()
    rows, rounds, sent = export(spark), [], I._sent

    def dying(*args):
        if len(rounds) == 2:
            raise KeyboardInterrupt
        rounds.append(args)
        return sent(*args)

    monkeypatch.setattr(I, "_sent", dying)
    with pytest.raises(KeyboardInterrupt):
        I.ingest(rows, receiver(target), "id", root, at_once=4)
    monkeypatch.setattr(I, "_sent", sent)
    assert I.ingest(rows, receiver(target), "id", root, at_once=4) == 17
    log = [int(x.split("-")[0]) // 10 for x in (target / "log").read_text().split()]
    assert sorted(log) == list(range(25)) and sorted(log[:8]) == list(range(8))


def test_a_folder_belongs_to_one_export(spark, tmp_path):
    target, root = tmp_path / "target", f"file://{tmp_path}/state"
    target.mkdir()
    I.ingest(export(spark, 20), receiver(target), "id", root)
    with pytest.raises(ValueError, match="another export"):
        I.ingest(export(spark, 21), receiver(target), "id", root)
    assert I.ingest(export(spark, 0), receiver(target), "id", f"file://{tmp_path}/none") == 0


def test_read_back_finds_what_differs(spark):
    rows = export(spark, 4)
    back = spark.createDataFrame([(0, "x" * 10, "v"), (1, "other", None), (2, "x" * 10, None), (9, "more", None)], "id long, text string, more string")
    assert {(r.id, r.change) for r in I.read_back(rows, back, "id").collect()} == {(1, "changed"), (3, "removed")}


def test_unbroken_runs(spark):
    acks = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 1), ("c", None), (None, 0), ("d", 0)], "k string, batch int")
    assert {r.k: r.acknowledged for r in I.contiguous(acks, ["k"], "batch").collect()} == {"a": 2, "b": 0, "c": 0, None: 1, "d": 1}


def test_a_stream_is_ingested_in_order_and_resumes(spark, tmp_path):
    target, source = tmp_path / "target", tmp_path / "source"
    target.mkdir()
    (target / "broken").touch()
    spark.createDataFrame([(i, "x" * 5) for i in range(60)], "id long, text string").coalesce(1).write.json(str(source))
    run = lambda: spark.readStream.schema("id long, text string").json(str(source)).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(I.ordered(receiver(target, fail={31}), "id", f"file://{tmp_path}/state", at_once=2, most_rows=10)).start()
    with pytest.raises(Exception, match="Interrupted"):
        run().awaitTermination()
    assert sorted(int(p.stem) for p in target.glob("*.json")) == list(range(30))
    (target / "broken").unlink()
    run().awaitTermination()
    assert sorted(int(p.stem) for p in target.glob("*.json")) == list(range(60))
    log = [int(x.split("-")[0]) // 10 for x in (target / "log").read_text().split()]
    assert sorted(log) == list(range(6))
