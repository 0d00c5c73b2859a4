"""The pipeline against a plain version on a small corpus, and its stages one by one."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from . import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, toxic ones, exact copies, near copies, and personal data; what should stay of them."""
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "the", "in", "ou", "ble", "tion"]) for _ in range(rng.randint(1, 4)))
    docs, labels, stay = [], [], {}
    text = lambda n=300: " ".join(word() for _ in range(n))
    for i in range(0, 40):
        docs.append((i, text()))
        stay[i] = docs[-1][1]
    for i in range(100, 130):  # toxic, some disguised
        words = text().split()
        for insult in ["idiot", "moron", "scum"] if i % 3 else ["1diot", "m o r o n", "scuuum"]:
            words.insert(rng.randrange(300), insult)
        docs.append((i, " ".join(words)))
    for i in range(200, 210):  # copies of 0..9 but for case: the largest id stays
        docs.append((i, docs[i - 200][1].upper() if i % 2 else docs[i - 200][1]))
        del stay[i - 200]
        stay[i] = docs[-1][1]
    for i in range(300, 310):  # near copies of 20..29: the least id stays
        words = docs[i - 280][1].split()
        words[150] = "changed"
        docs.append((i, " ".join(words)))
    docs.append((400, "write to an.er@mail5.example.com or 1.2.3.4 " + text(60)))
    stay[400] = docs[-1][1]
    docs += [(401, None), (402, ""), (403, "tiny")]
    stay |= {402: "", 403: "tiny"}  # null and empty are equal texts; the larger id stays
    labels = [(i, 1, int(100 <= i < 130)) for i, _ in docs if i < 300]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), stay


def redacted(text):
    out, done = [], 0
    for s, e, k in brute.base_spans(text):
        out += [text[done:s], ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][k]]
        done = e
    return "".join([*out, text[done:]])


def test_pipeline_against_a_plain_version(spark, corpus):
    folder, stay = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in got} == set(stay)
    for i, text in stay.items():
        ids = np.array([*theirs.encode(redacted(text), add_special_tokens=False).ids, 2], "<u4")
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, stay = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_and_read(function(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= before
        before = docs.count()
    row = docs.where("doc_id = 400").first()
    assert row.text.startswith("write to [EMAIL] or [IP] ") and row.n_chars == len(row.text)


def test_an_empty_corpus_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_give_columns_of_any_name_back_untouched(spark, corpus):
    """Columns named as operators name their own, with dots, and null in every row of some."""
    folder, stay = corpus
    names = ["kept", "group_size", "keep_id", "__toxicity", "score", "a.b", "c0", "`", "component_id", "ids", "spans"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *[(docs.doc_id * 100 + i if i % 4 else docs.source).alias(n) for i, n in enumerate(names)])
    want = {r.doc_id: r[5:] for r in docs.collect()}
    columns, types = docs.columns, docs.dtypes
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, folder)
        assert docs.columns == columns and docs.dtypes == types
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id: r[5:] for r in docs.collect()} == {i: want[i] for i in stay}
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, folder).collect()} == set(stay)
