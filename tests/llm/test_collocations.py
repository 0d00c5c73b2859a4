"""Collocations against a plain version: edge cases, words beyond the head, runs over batches, longer phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import collocations as C
from quillgraph.llm.collocations import collocations

from . import brute

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, longest=3, least=10, top=2000, inside=50):
    out = set()
    langs = collections.defaultdict(list)
    for _, lang, text in rows:
        langs["und" if lang is None else lang].append(brute.lower(text))
    for lang, texts in langs.items():
        f = collections.Counter()
        for text in texts:
            for piece in re.split("[.,;:!?\n-\r]", text):
                words = re.findall("[^ \t]+", piece)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = collections.Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], a)
        found = []
        for g, a in candidates.items():
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if 100 * held[g] < inside * a or not held[g]:
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def compare(spark, rows, frame=None, **options):
    found = [tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA) if frame is None else frame, **options).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, options.get("longest", 3), options.get("least", 10), options.get("top", 2000))
    return found


def made(n=300, seed=1):
    r = random.Random(seed)
    words = ["The", "the", "of", "über", "Über", "x\x01", "a-b", "don't", "é", "\U0001d400", "zz\xa0top", "İ", "1"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0c", "\x85", " "]
    rows = [(i, r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(40)))) for i in range(n)]
    return [*rows, (0, "en", None), (1, None, ""), (1, None, " \t. ,"), (1, "xx", "la la la la la la la la la la la la"), (None, "en", "the of the of")]


@pytest.mark.parametrize("head_bytes", [C.HEAD_BYTES, 250, 0])
def test_equal_to_the_plain_version_whatever_the_head_holds(spark, monkeypatch, head_bytes):
    monkeypatch.setattr(C, "GRAMS", 500)
    monkeypatch.setattr(C, "RANKED", 7)
    found = compare(spark, made(), head_bytes=head_bytes)
    assert any(len(x[2].split(" ")) == 3 for x in found) and ("xx", 1, "la la la", 10, 12, 11, 12, 757575) in found


def test_longer_phrases_and_few_ranks(spark):
    compare(spark, made(200, 2), longest=4, least=3, top=5)
    compare(spark, made(200, 3), longest=2, least=4)


def test_columns_of_the_input_do_not_clash(spark):
    rows = made(120, 4)
    frame = spark.createDataFrame([(*r, 1, "z", 2.0, 3, 4) for r in rows], SCHEMA + ", word int, key string, n double, `a.b` int, rank int")
    compare(spark, rows, frame)


def test_empty_table_and_a_very_long_text(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, "en", None), (2, None, "alone")], SCHEMA)).collect() == []
    compare(spark, [(0, "en", "ab cd é ef, " * 200_000), (1, "en", "w" * 2_000_000), (2, "en", "ab cd")])


def test_radix_order_sorts_as_keys_do():
    r = np.random.default_rng(5)
    keys = np.concatenate([r.integers(0, 5, (2000, 3)), r.integers(0, 1 << 32, (2000, 3))]).astype(np.uint32)
    ordered = keys[C.radix_order(keys)]
    assert [tuple(k) for k in ordered.tolist()] == sorted(map(tuple, keys.tolist()))
    assert C._unpacked(C._packed(ordered, 3), 3).tolist() == ordered.tolist() and C._packed(ordered, 3).to_pylist() == sorted(C._packed(keys, 3).to_pylist())
    assert C._unpacked(C._packed(ordered, 4).slice(7, 9), 4)[:, :3].tolist() == ordered[7:16].tolist()


def test_runs_go_over_batches():
    keys = np.repeat(np.arange(1, 40, dtype=np.uint32), np.arange(1, 40))[:, None].repeat(2, axis=1)
    for size in (1, 7, 10_000):
        batches = [pa.RecordBatch.from_arrays([C._packed(keys[at : at + size], 3), pa.array(np.full(len(keys[at : at + size]), 2))], ["key", "n"]) for at in range(0, len(keys), size)]
        found = [(C._unpacked(b["key"], 3).tolist(), b["f"].to_pylist()) for b in C._run_lengths(2, 3, 20)(iter(batches))]
        assert [x for k, n in found for x in zip(k, n, strict=True)] == [([i, i, 0], 2 * i) for i in range(10, 40)]
