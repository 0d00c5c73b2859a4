"""The lexicon against plain versions: least automaton, exact ids over all code points, round trip."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from quillgraph.llm import lexicon as L
from quillgraph.llm.queries import QUERIES
from quillgraph.llm.words import Merges, token_names

from . import brute

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello  worldly", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "don't I'LL 'S x'Ve 12 3.5", "a\x1cb \x85c d　e​f", "é ́e ẛ̣", "ΟΔΥΣΣΕΥΣ Σ İstanbul", "\U0001f1e9\U0001f1ea👩‍👩‍👧 漢字 한글 각", "abab" * 4000, " \n\t "]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(FILE)


def in_file(tmp_path, entries):
    path = tmp_path / "lexicon"
    path.write_bytes(L.compiled(entries))
    return L.Lexicon(str(path))


def least_states(words):
    """States of the least automaton: the distinct sets of what may follow a beginning."""
    every = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
    return len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in every})


def test_the_automaton_is_the_least_one_and_knows_its_words_alone(tmp_path):
    r = random.Random(2)
    for alphabet, longest in ((b"ab", 5), (b"ab\x00\xff", 4), (bytes(range(97, 123)), 3)):
        words = {bytes(r.choice(alphabet) for _ in range(r.randrange(1, longest + 1))) for _ in range(60)}
        arcs, final, root = L.minimal(sorted(words))
        assert len(arcs) == len(final) == least_states(words) and root == len(arcs) - 1
        lexicon = in_file(tmp_path, [(w, list(w)) for w in words])
        asked = [*words, *(w + b"a" for w in words), *(w[:-1] for w in words), b""]
        places = lexicon.places(pa.array(asked, pa.binary()))
        order = sorted(words)
        assert places.tolist() == [order.index(w) if w in words else -1 for w in asked]
        ids, lengths = lexicon.lists(places[: len(words)])
        assert ids.tolist() == [x for w in asked[: len(words)] for x in w] and lengths.tolist() == [len(w) for w in asked[: len(words)]]


def test_an_empty_lexicon(tmp_path):
    assert in_file(tmp_path, []).places(pa.array([b"a", b""])).tolist() == [-1, -1]


def test_ids_are_the_librarys_over_all_code_points(theirs, tmp_path):
    texts = [f"a{chr(c)}b {chr(c)} x'{chr(c)}s" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    coder = L.Encoder(FILE, in_file(tmp_path, []))
    differ = 0
    for at in range(0, len(texts), 100_000):
        ours = coder.encode(pa.array(texts[at : at + 100_000])).to_pylist()
        differ += sum(a != b.ids for a, b in zip(ours, theirs.encode_batch(texts[at : at + 100_000], add_special_tokens=False), strict=True))
    assert differ == 0


def test_ids_are_the_librarys_on_random_texts_with_any_lexicon(theirs, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh'stmrevldABZ019 \t\n.,!<|>é́üßİΣσñ한漢\x1c\x85🙂‍#$_-") for _ in range(r.randrange(60))) for _ in range(20_000)]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    merges = Merges(FILE)
    some = {w.encode() for t in texts[::7] for w in t.split()}
    for entries in ([], [(w, merges.ids(w)) for w in some]):
        assert L.Encoder(FILE, in_file(tmp_path, entries)).encode(pa.array(texts)).to_pylist() == want


@pytest.mark.parametrize("mark", ["", "x\u0331"])
def test_case_and_combining_marks(theirs, tmp_path, mark):
    """With marks in a batch nothing is lower-cased before it is composed."""
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("ABCHabch<|ENDOFTXendoftx>ÉİΣK" + mark) for _ in range(r.randrange(1, 9))) for _ in range(30)) for _ in range(300)]
    texts += ["<|ENDOFTEXT|> <|EndOfText|><|endoftext|>\xff<|STARTOFTEXT|>", "H\u0331 h\u0331 ẖ" if mark else "H h"]
    coder = L.Encoder(FILE, in_file(tmp_path, [(b"a", Merges(FILE).ids(b"a"))]))
    assert coder.encode(pa.array(texts)).to_pylist() == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_words_are_split_as_the_library_splits_them(theirs):
    """Plain Latin words take a path of their own."""
    merges, r = Merges(FILE), random.Random(6)
    for _ in range(20_000):
        word = "".join(r.choice("aeinorSTLH'sdtremvl.,!09ßÀéŸŉİıǅſÿ") for _ in range(r.randrange(1, 16)))
        assert merges.pieces(word) == [p for p, _ in theirs.pre_tokenizer.pre_tokenize_str(theirs.normalizer.normalize_str(word))]


def test_documents_round_trip_with_nulls_repeated_rows_and_clashing_columns(spark, theirs):
    rows = [(i, t, 7, "x", i) for i, t in enumerate(TEXTS)] + [(1, "twice", 7, "x", 0)] * 2 + [(None, "no id", 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string, `a.b` int")
    found = L.decode_words(L.encode_words(docs, FILE), FILE).collect()
    want = sorted((repr(i), list(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in found) == want
    assert all(r.decoded == theirs.decode(r.ids, skip_special_tokens=False) for r in found)
    assert found[0].__fields__ == ["doc_id", "a.b", "ids", "decoded"]
    empty = docs.limit(0)
    assert L.decode_words(L.encode_words(empty, FILE), FILE).collect() == []


def test_null_and_unknown_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [320, -1, 99_999_999, 321]), (3, []), (4, [49407])], "k int, ids array<int>")
    names = token_names(FILE)
    assert {r.k: r.decoded for r in L.decode_words(rows, FILE).collect()} == {1: "", 2: f"{names[320]} {names[321]}", 3: "", 4: "<|endoftext|>"}


def test_a_small_lexicon_takes_whole_levels_of_frequency(spark):
    docs = spark.createDataFrame([("a " * 100 + "b " * 50 + "c d e f " + "long" * 30,)], "text string")
    name = L.build_lexicon(docs, FILE, most=3)
    assert {r.text for r in spark.createDataFrame([("a",), ("b",), ("c",)], "text string").collect()} == {"a", "b", "c"}
    found = L.Lexicon(L.SparkFiles.get(name)).places(pa.array([b"a", b"b", b"c", b"long" * 30]))
    assert (found >= 0).tolist() == [True, True, False, False]
    assert L.encode_words(docs, FILE, lexicon=name).first().ids == Tokenizer.from_file(FILE).encode(docs.first().text, add_special_tokens=False).ids


def test_op13(spark, theirs):
    docs = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}
    found = QUERIES["op13_lexicon"](spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(decoded.encode()))
    assert np.mean([r.n_tokens for r in rows]) > 10
