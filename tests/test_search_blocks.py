"""Search in small blocks: the best of each query whatever the blocks, and what a task holds."""

import numpy as np
import pyarrow as pa

from quillgraph.operators import search


def test_documents_are_cut_by_words(monkeypatch):
    """a batch of documents is looked up in parts of a bounded number of words, none lost."""
    monkeypatch.setattr(search, "WORDS", 5)
    lists = [["a"] * n for n in (2, 3, 1, 9, 0, 0, 4, 2)]
    parts = list(search._by_words(pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], ["id", "words"])))
    assert [p["id"].to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5, 6], [7]]


def test_the_best_so_far_rules_out_later_blocks():
    """rows that a task hands on are the k best of each query so far, ties too."""
    scores, least, found = np.random.default_rng(7).integers(0, 40, (400, 3)) / 40, np.full(3, -np.inf), []
    for at in range(0, 400, 20):
        part = scores[at : at + 20]
        for b in search._best_cells(part, part > 0, pa.array(range(at, at + 20)), pa.array(["x", "y", "z"]), "q", 5, least):
            found += list(zip(b["q"].to_pylist(), b["id"].to_pylist(), b["score"].to_pylist(), strict=True))
    for c, q in enumerate("xyz"):
        want = sorted((-s, i) for i, s in enumerate(scores[:, c]))[:5]
        assert sorted((-s, i) for n, i, s in found if n == q)[:5] == want
    assert len(found) < 3 * 20 * 5
