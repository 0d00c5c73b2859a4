"""Exact, substring and SimHash deduplication against brute force."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import near, simhash, substring_dedup
from quillgraph.llm.common import key_filter, may_hold
from quillgraph.llm.components import components
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.simhash import simhash_dedup

from . import brute

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "Straße É"), (5, "straße É"), (6, "STRAßE É"), (6, "STRAßE É"), (None, "straße É"), (7, "x" * 50_000), (8, "X" * 50_000), (9, "x" * 50_001), (None, "only null id"), (10, "a" * 200 + "b"), (11, "a" * 200 + "c")]


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    docs = EDGES + [(100 + i, rng.choice(["One", "two", "TWO", "three words here", "oNe"]) * rng.randint(1, 2)) for i in range(300)]
    got = exact_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute.exact(docs)


def test_exact_with_full_key_filters(spark, monkeypatch):
    """A filter too small for its keys lets more rows pass and loses none."""
    monkeypatch.setattr("quillgraph.llm.common.BITMAP", 1)
    monkeypatch.setattr("quillgraph.llm.common.MOST_BITS", 4)
    got = exact_dedup(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute.exact(EDGES)


def test_key_filter_holds_its_keys(spark):
    keys = spark.range(0, 5000).select(F.xxhash64("id").alias("h"))
    rows = may_hold(spark.range(0, 20_000), key_filter(keys), F.xxhash64("id"), "held")
    held = {r.id for r in rows.where("held").collect()}
    assert held >= set(range(5000)) and len(held) < 6500
    nothing = may_hold(spark.range(0, 5), key_filter(keys.limit(0)), F.xxhash64("id"), "held")
    assert nothing.where("held").count() == 0 and nothing.columns == ["id", "held"]


def test_exact_hot_group(spark, monkeypatch):
    monkeypatch.setattr("quillgraph.llm.common.HOT_SHARE", 3)
    docs = [(i, "hot") for i in range(400)] + [(1000 + i, f"cold {i % 150}") for i in range(300)]
    got = exact_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute.exact(docs)


def test_exact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "old", 5), (2, "A", None, None)], "doc_id long, text string, keep_id string, other int")
    got = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert got[1].keep_id == 2 and got[1].other == 5 and got[1].text == "a" and got[2].kept and not got[1].kept
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["an", "er", "the", "in", "ou", "é", "st"]) + str(rng.randint(0, 40))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at, part = rng.randint(0, len(words)), rng.choice(shared)
            words[at:at] = part
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(60, None), (61, ""), (62, "a " * 100), (63, docs[5][1]), (63, docs[5][1]), (None, docs[6][1]), (64, "u v   w")]
    want = brute.repeated_windows([t for _, t in docs], 35)
    got = substring_dedup.substring_dedup(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(docs, want, strict=True)), key=key)
    assert any(w[1] for w in want)


def test_substrings_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, n_words int")
    assert substring_dedup.substring_dedup(df).collect() == []


def test_cover_has_every_difference():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@given(st.lists(st.text(alphabet="ab \n\té", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_split_and_joined(texts):
    words = substring_dedup.Words([t.encode() for t in texts])
    split = [[w for w in t.encode().split() if w] for t in texts]
    assert words.n_words.tolist() == [len(w) for w in split]
    assert words.kept(np.zeros(len(words.doc), bool)) == [b" ".join(w) for w in split]


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["an", "er", "the", "in", "ou", "st"]) for _ in range(200)) for _ in range(8)]
    docs = []
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y"])
        docs.append((1000 - i, " ".join(words)))
    docs += [(1, None), (2, ""), (3, "one"), (4, "One two"), (5, "one two"), (5, "one two")]
    prints = [brute.fingerprint(t) for _, t in docs]
    roots = brute.components(prints, 2)
    least = collections.defaultdict(lambda: 1 << 60)
    for (i, _), r in zip(docs, roots, strict=True):
        least[r] = min(least[r], i)
    got = simhash_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id, r.f0 & (2**64 - 1), r.component_id) for r in got) == sorted((i, f, least[r]) for (i, _), f, r in zip(docs, prints, roots, strict=True))
    assert len(set(roots)) < len(set(prints)) + 3


@pytest.mark.parametrize("crowd", [30, 200])
def test_links_in_crowded_segments(spark, crowd):
    """Many fingerprints that share a half: found over the points around them, none lost."""
    rng = random.Random(5)
    half = rng.getrandbits(32)
    values = {half << 32 | rng.getrandbits(32) for _ in range(crowd)}
    for v in list(values)[:60]:
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "f0 long"))
    groups = {r.node: r.root for r in components(found, "a0", "b0").collect()}
    roots = brute.components(values, 2)
    want = collections.defaultdict(set)
    for v, r in zip(signed, roots, strict=True):
        want[r].add(v)
    have = collections.defaultdict(set)
    for v in signed:
        have[groups.get(v, v)].add(v)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_links_between_two_crowded_halves(spark):
    """One fingerprint is a bit off both crowded halves, the other two bits further on: linked."""
    rng = random.Random(8)
    high, low = rng.getrandbits(31), rng.getrandbits(31)
    crowd = {high << 32 | rng.getrandbits(32) for _ in range(100)} | {rng.getrandbits(31) << 32 | low for _ in range(100)}
    a, b = (high ^ 1) << 32 | (low ^ 1), (high ^ 3) << 32 | (low ^ 3)
    found = simhash.links(spark.createDataFrame([(v,) for v in sorted(crowd | {a, b})], "f0 long"))
    assert {frozenset((r.a0, r.b0)) for r in found.collect()} >= {frozenset((a, b))}


def test_links_of_random_fingerprints_around_crowds(spark):
    """Ten thousand fingerprints around crowded values of both halves: components as by brute force."""
    rng = random.Random(21)
    high, low = [rng.getrandbits(32) for _ in range(3)], [rng.getrandbits(32) for _ in range(3)]
    flipped = lambda x, most: x ^ sum(1 << i for i in rng.sample(range(32), rng.randint(0, most)))
    values = {rng.choice(high) << 32 | rng.getrandbits(32) for _ in range(2000)} | {rng.getrandbits(32) << 32 | rng.choice(low) for _ in range(2000)}
    while len(values) < 10_000:
        values.add(flipped(rng.choice(high), 4) << 32 | flipped(rng.choice(low), 4))
    f = np.array(sorted(values), np.uint64)
    found = simhash.links(spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "f0 long"))
    groups = {r.node: r.root for r in components(found, "a0", "b0").collect()}
    root = np.arange(len(f))
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 2) for x in f]
    for _ in range(len(f)):
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    want, have = collections.defaultdict(set), collections.defaultdict(set)
    for v, r in zip(f.view(np.int64).tolist(), root.tolist(), strict=True):
        want[r].add(v)
        have[groups.get(v, v)].add(v)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def near_groups(docs, similar=0.8, n=5):
    """Of each index the least index that links of this similarity reach, by comparing all pairs."""
    words = [brute.lower(t).split() for _, t in docs]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similar * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(docs))]


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Families of clear near copies, short, empty and null texts, repeated ids and rows; groups cut into many parts."""
    monkeypatch.setattr("quillgraph.llm.near.LEAST_PART", 10)
    monkeypatch.setattr("quillgraph.llm.near.HOT_SHARE", 20)
    monkeypatch.setattr("quillgraph.llm.near.TOGETHER", 50)
    monkeypatch.setattr("quillgraph.llm.near.BLOCK_TEXTS", 6)
    monkeypatch.setattr("quillgraph.llm.common.HOT_SHARE", 20)
    monkeypatch.setattr("quillgraph.llm.common.COPY_ROWS", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for size in (150, 150, 40, 5, 5, 2, 2, 2):
        base = [word() for _ in range(300)]
        for _ in range(size):
            words = base.copy()
            words[rng.randrange(300)] = word()
            docs.append((len(docs), " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    docs += [(400 + i, " ".join(word() for _ in range(100))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (3, "unique words of a row with a used id"), (None, docs[0][1] + " x"), (3, docs[3][1])]
    roots = near_groups(docs)
    best = {}
    for (i, _), r in zip(docs, roots, strict=True):
        best[r] = min(best.get(r, 1 << 60), 1 << 60 if i is None else i)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = near.near_copies(df).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter((i, best[r]) for (i, _), r in zip(docs, roots, strict=True))
    stay = near.drop_near_copies(df.withColumn("kept", df.doc_id)).collect()
    assert collections.Counter(r.doc_id for r in stay) == collections.Counter(best[r] for r in set(roots))
    assert all(r.kept == r.doc_id for r in stay) and {r.text for r in stay if r.doc_id == 3} == {"unique words of a row with a used id"}


@pytest.mark.parametrize("rounds", [0, 2])
def test_candidates_are_verified_in_bundles(spark, monkeypatch, rounds):
    """Without rounds of leaders all links come from bundles: chains of copies that each differ from the next."""
    monkeypatch.setattr("quillgraph.llm.near.ROUNDS", rounds)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(6):
        words = [word() for _ in range(300)]
        for _ in range(12):
            docs.append((len(docs), " ".join(words)))
            words = [word() if rng.random() < 0.008 else w for w in words]
    got = near.near_copies(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(near_groups(docs)))


def test_near_copies_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, f0 string, kept int")
    assert near.near_copies(df).collect() == [] and near.drop_near_copies(df).collect() == []


def test_runs_that_share_a_variant():
    rng = np.random.default_rng(2)
    code = np.sort(rng.integers(0, 1 << 7, 90))
    found = collections.Counter()
    for some in near.runs_joined(code, 7):
        for i, j in near.products(*some):
            found.update((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b)
    assert set(found) == {(i, j) for j in range(90) for i in range(j) if bin(int(code[i] ^ code[j])).count("1") <= 1}


@pytest.mark.parametrize(("low", "high", "found"), [(0.6, 0.79, 0), (0.8, 0.82, 0.9), (0.82, 0.85, 0.95), (0.85, 0.95, 0.98)])
def test_near_copies_against_their_true_similarity(spark, low, high, found):
    """Single pairs of the pipeline's near copies: all linked have the similarity, and few that have it are missed."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    docs = []
    while len(docs) < 600:
        base = [word() for _ in range(300)]
        copy = base.copy()
        for _ in range(rng.randint(1, 20)):
            copy[rng.randrange(300)] = word()
        a, b = shingles(base), shingles(copy)
        if low <= len(a & b) / len(a | b) <= high:
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(docs, SCHEMA), **corpus_pipeline.NEAR).collect()}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    linked = sum(got[i] == got[i + 1] for i in range(0, 600, 2)) / 300
    print(f"linked {linked:.3f} of pairs at {low} to {high}")
    assert linked >= found if found else linked == 0


def test_simhash_of_an_empty_table(spark):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string, f0 string, component_id int")).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63
