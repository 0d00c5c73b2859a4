"""Source divergence against a plain version: edge cases, several chunks, several blocks of sources."""

import collections
import random
import re

import pytest

from quillgraph.llm import divergence as D
from quillgraph.llm.divergence import divergence

from . import brute

SCHEMA = "doc_id long, lang string, source string, text string"


def plain(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", brute.lower(text))) for _, lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter() for s in {d[1] for d in mine}}
        for _, source, terms in mine:
            counts[source].update(t for t in terms if seen[t] >= least)
        whole = sum(counts.values(), collections.Counter())

        def shares(count):
            of = sum(count.values()) + 2 * len(kept)
            return [1 + 10**9 * (count[t] + 2) // of for t in kept]

        def apart(a, b):
            return [(x - y) ** 2 // (x + y) for x, y in zip(a, b, strict=True)]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s, c in counts.items():
            pairs = [(other, sum(apart(p[s], p[other]))) for other in counts if other != s]
            terms = [(t, f) for t, f, x, y in zip(kept, apart(p[s], q), p[s], q, strict=True) if c[t] and x > y]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out.update((lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1))
    return out


def compare(spark, rows, frame=None, **options):
    found = [tuple(r) for r in divergence(spark.createDataFrame(rows, SCHEMA) if frame is None else frame, **options).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, options.get("least_docs", 10), options.get("top", 10))
    return found


def test_ties_nulls_and_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARED", 2)
    r = random.Random(1)
    words = ["Der", "über", "x1y", "Ça", "a-b", "naïve", "\U0001d400x", "ﬀ", "zz", "É", "é", "don't", "İ"]
    rows = [(i, r.choice(["en", "de", None, ""]), f"s{r.randrange(9)}", " ".join(r.choices(words, k=r.randrange(30)))) for i in range(300)]
    rows += [(1, None, None, None), (1, "en", None, ""), (2, "xx", "only", "few words"), (2, "xx", "only", "few words"), (None, "yy", "a", "1 2 3"), (None, "yy", "b", None)]
    found = compare(spark, rows, least_docs=10, chunk=3, block=2)
    assert ("yy", "a", "pair", "b", 0, 1) in found and not any(x[0] == "xx" for x in found)
    compare(spark, rows, least_docs=2, top=3)


def test_columns_of_the_input_do_not_clash(spark):
    rows = [(i, "en", f"s{i % 3}", "apple pear " * (i % 4)) for i in range(60)]
    frame = spark.createDataFrame([(*r, 1, "z", 2.0, 3, 4) for r in rows], SCHEMA + ", term int, counts string, n double, `a.b` int, chunk int")
    compare(spark, rows, frame)


def test_empty_table_and_a_very_long_text(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(0, "en", "long", "ab cd é" * 300_000), *((i, "en", "short", "ab" + "q" * i) for i in range(12)), (99, "en", "word", "w" * 2_000_000)]
    compare(spark, rows, least_docs=2)


def test_partial_counts_are_summed_and_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, "en", f"s{i % 4}", f"every one {i % 50:b} " + "".join(chr(97 + int(c)) for c in str(i % 97))) for i in range(400)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": r[1], "source": r[2], "text": r[3]} for r in rows[at : at + 40]]) for at in range(0, 400, 40)]
    monkeypatch.setattr(D, "HELD", 60)
    sums = collections.Counter()
    for b in D._count(iter(batches)):
        for x in b.to_pylist():
            sums[x["source"], x["term"], "n"] += x["n"]
            sums[x["source"], x["term"], "docs"] += x["docs"]
    want = collections.Counter()
    for _, _, source, text in rows:
        terms = re.findall("[a-z]+", text)
        for t in terms:
            want[source, t.encode(), "n"] += 1
        for t in set(terms):
            want[source, t.encode(), "docs"] += 1
    assert sums == want


@pytest.mark.parametrize("of", [3, 10**9 + 7, 8 * 10**15])
def test_shares_are_exact(of):
    import numpy as np

    counts = np.array([0, 1, of // 3, of - 2])
    assert D._shares(counts, of).tolist() == [1 + 10**9 * (c + 2) // of for c in counts.tolist()]
