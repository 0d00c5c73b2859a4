"""Toxicity, personal data, BPE, packing, media, WARC and chat against brute force, round trips and held-out labels."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import bpe, chat, crf, media, packing, pii, toxicity, warc
from quillgraph.llm.words import WordEncoder

from . import brute

SCHEMA = "doc_id long, text string"
RANKS, WORDS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN
ODD = ["", "  \n\n x", "Don't we'll 'S", "ÅB ΑΣ ΣΑΣ, İx ẞ K 12½ ² ⅷ x\x1cy a\xa0b é́ ﬁ", "日本語 テキスト123", "😀👍🏽 a_b--c", "<|endoftext|> hi", "a" * 3000, " " * 2500 + "x", "word " * 900, "\r\n\t mixed   spaces   z"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    words = ["anan", "there", "ouing", "ertion", "reat", "hand"]
    counts = np.zeros((28, 28, 28))
    text = " ".join(rng.choice([*words, "idiot", "moron", "scum", "stupid"]) for _ in range(4000))
    table = toxicity._symbol_table()
    s = table[np.frombuffer(text.encode(), np.uint8)].astype(int)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.Model(counts, {"idiot": 6.0, "moron": 6.0, "scum": 6.0}, -4.0, 0.9)


@pytest.mark.parametrize(("token", "words"), [("1d10t", ["idiot"]), ("i d i o t", ["idiot"]), ("i.d.i.o.t", ["idiot"]), ("idiooooot", ["idiot"]), ("M0R0N!!", ["moron"]), ("$cum", ["scum"]), ("there,", ["there"]), ("hand%%%", ["hand"]), ("12345", []), ("", []), ("|", []), ("$455", []), ("12/05/2024", []), ("4 5 5", []), ("#-#", [])])
def test_disguised_words_are_restored(model, token, words):
    assert toxicity.Restorer(model.counts).words(token or "|") == words


def test_letterless_tokens_are_decoded():
    counts = np.zeros((28, 28, 28))
    s = toxicity._symbol_table()[np.frombuffer(b"ass lot still also a lot is in it " * 50, np.uint8)].astype(int)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    assert [toxicity.Restorer(counts).words(t) for t in ("@$5", "455", "$5.50")] == [["ass"], [], []]


def test_symbols_are_counted_by_characters(spark):
    """As the decoder sees them: an accented letter is one letter, a dash is none."""
    counts = toxicity.trigram_counts(spark.createDataFrame([(1, "Çé–a"), (2, None)], SCHEMA).coalesce(1), "text")
    assert counts.sum() == 3 and counts[27, 27, 0] == 1 and counts[27, 0, 1] == 1


def test_long_tokens_are_settled_in_steps(model):
    token = "1d10t.m0r0n." * 3000
    assert toxicity.Restorer(model.counts).restore(token).count("idiot") > 2900


def test_long_tokens_are_decoded_exactly(model, monkeypatch):
    """Putting the shared beginning aside changes nothing, however often it is done."""
    rng, restorer = random.Random(11), toxicity.Restorer(model.counts)
    for _ in range(30):
        token = "".join(rng.choice("abcdeiou0134579@$!|.x-") for _ in range(1400))
        found = []
        for steps in (1 << 30, 1024, 7):
            monkeypatch.setattr(toxicity, "SHARED", steps)
            found.append(restorer.restore(token))
        assert found[0] == found[1] == found[2]


def test_viterbi_finds_the_best_reading(model):
    """Against all readings of short tokens."""
    restorer = toxicity.Restorer(model.counts)
    for token in ("1d10t", "m0r.0n", "5cuum", "a1b"):
        readings = [("", 0.0)]
        for m in toxicity.RUN.finditer(token):
            readings = [(r + t, c + cost) for r, c in readings for t, cost in restorer.options(m[0])]

        def total(reading):
            text, cost = reading
            x = y = 0
            for c in text + " ":
                s = toxicity._symbol(c)
                cost += restorer.logp[x][y][s]
                x, y = y, s
            return cost

        found = restorer.restore(token)
        assert max(total(r) for r in readings if r[0].split() == found) == pytest.approx(max(map(total, readings)))


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["an", "er", "the", "in", "ou"]) + rng.choice(["ble", "tion", "ing", "st"])
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["idiot", "moron", "scum", "loser"] if i % 8 else ["1d10t", "m o r o n", "scuuum", "l0ser"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "idiot moron"), (1002, "a " * 20_000)]
    df = spark.createDataFrame(docs, SCHEMA)
    made = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("score", F.lit("old")), made).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held} == {*held, None, *(i for i in (1000, 1001, 1002) if zlib.crc32(str(i).encode()) % 4 == 2)}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in held)
    assert got[1000].score == got[1001].score < 0.3
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(spark.createDataFrame([], SCHEMA), made).collect() == []


def test_fixed_patterns_against_regular_expressions():
    rng = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "7", " ", ".", "-", "é", "x", "+", "(", "00.1.02.3.4.5.6", "a@b.c@d.e.f"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute.base_spans(text), text
    long = "1" * 200_000 + "@" + "a." * 50_000
    assert isinstance(pii.base_spans(long), list)


def test_field_learns_and_decodes_best_path():
    field = crf.train(pii.labelled_rows(200, 1))
    rows = pii.labelled_rows(150, 77)
    got = field.decode([w for w, _ in rows])
    assert sum([field.tags[y] for y in a] == b for a, (_, b) in zip(got, rows, strict=True)) >= 0.95 * len(rows)
    words = rows[1][0][:5]
    scores = field.emissions(words)
    best, path = max(((field.start[p[0]] + sum(scores[i, y] for i, y in enumerate(p)) + sum(field.transitions[a, b] for a, b in zip(p, p[1:], strict=False)), p) for p in np.ndindex(*[len(field.tags)] * len(words))), key=lambda x: x[0])
    assert field.decode([[], words, words * 3, []])[1].tolist() == list(path)
    one_by_one = [field.decode([w])[0].tolist() for w, _ in rows]
    assert one_by_one == [y.tolist() for y in got]


def test_a_field_without_rows_finds_nothing():
    field = crf.train([])
    assert list(pii.all_spans(["call (743) 555-3824", ""], field)) == [([], []), ([], [])]


def test_whole_texts_are_decoded_like_the_field_alone():
    """Spans of texts decoded together are those of each text's best path, whatever is batched with it."""
    field = crf.train(pii.labelled_rows(200, 1))
    texts = [" ".join(w for words, _ in pii.labelled_rows(n, n) for w in words) for n in (1, 2, 30, 3, 0, 200)]
    together = list(pii.all_spans(texts, field))
    assert together == [next(pii.all_spans([t], field)) for t in texts]
    assert sum(len(spans) for _, spans in together) > 60


def test_spans_and_redaction(spark):
    field = pii.train_field(pii.labelled_table(spark, 200))
    docs = [(1, None), (2, ""), (3, "😀 mail a.b@c.example and 1.2.3.4"), (4, "call (743) 555-3824 now"), (5, 'the token = "' + "0a" * 20 + '" ou'), (6, "clean 2024 text"), (7, "an " * 30_000 + "x@y.example"), (3, "😀 mail a.b@c.example and 1.2.3.4")]
    df = spark.createDataFrame([(*d, "old") for d in docs], SCHEMA + ", spans string")
    got = pii.find_spans(df, field).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert [(s.kind, s.start, s.end) for s in by[3].base_spans] == [("email", 7, 20), ("ip", 25, 32)]
    assert [s.kind for s in by[4].spans] == ["phone"] and [s.kind for s in by[5].spans] == ["secret"] and by[6].spans == [] and len(by[7].base_spans) == 1
    assert by[1].spans == by[2].spans == []
    clean = {r.doc_id: r.text for r in pii.redact(df, field).collect()}
    assert clean[3] == "😀 mail [EMAIL] and [IP]" and clean[1] is None and clean[6] == "clean 2024 text" and "555" not in clean[4]
    assert pii.find_spans(spark.createDataFrame([], SCHEMA), field).collect() == []


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [40, 20_000])
def test_bpe_by_chunks_is_that_of_the_whole(spark, reference, chunk):
    texts = [*ODD, "it's 'r" * 40, "x'r" + "e" * 50, "ab\n\n\n cd " * 60, None]
    docs = spark.createDataFrame([(i, t, "c", i, i) for i, t in enumerate(texts)], SCHEMA + ", ids string, key int, chunk int")
    ids = bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=15 if chunk < 100 else 1000)
    got = {r.doc_id: r for r in bpe.decode(ids, RANKS, PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    empty = bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, PATTERN)
    assert bpe.decode(empty, RANKS, PATTERN).collect() == []


def test_chunks_that_start_after_blank_lines(spark, reference):
    texts = [("ab cd ef " * 4 + end) * 12 for end in ("gh\n\n", "gh\r\n", "gh\t\t", "g\n \n")]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), SCHEMA), RANKS, PATTERN, chunk=40, overlap=15).collect()
    assert len(got) == len(texts)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id]) for r in got)


def test_repeated_long_rows_stay(spark, reference):
    docs = spark.createDataFrame([(1, "ab cd " * 30)] * 3, SCHEMA)
    got = bpe.encode(docs, RANKS, PATTERN, chunk=40, overlap=15).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [reference.encode_ordinary("ab cd " * 30)] * 3


def test_words_are_those_of_the_tokenizer():
    ours, theirs = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    theirs.encode_special_tokens = True
    for text, ids in zip(ODD, ours.ids(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_ids_of_every_character_are_the_librarys():
    theirs, ours = Tokenizer.from_file(WORDS), WordEncoder(WORDS, added=True)
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    differ = 0
    for at in range(0, len(texts), 100_000):
        some = texts[at : at + 100_000]
        differ += sum(np.frombuffer(a, "<u4").tolist() != b.ids for a, b in zip(ours.ids(some), theirs.encode_batch(some, add_special_tokens=False), strict=True))
    assert differ == 0


def test_added_tokens_are_those_of_the_tokenizer(spark):
    theirs = Tokenizer.from_file(WORDS)
    texts = [*ODD, "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "x <|endoftext|> é<|endoftext|>\u0301 'S<|startoftext|>'s", "<|ENDOFTEXT|> <|endoftext|", "<|<|endoftext|>|>"]
    for text, ids in zip(texts, WordEncoder(WORDS, added=True).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text
    rows = packing.tokenise_and_cut(spark.createDataFrame(list(enumerate(texts)), SCHEMA), WORDS, 2, 64).where("start = 0").collect()
    assert all(r.doc_tokens == len(theirs.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in rows) and len(rows) == len(texts)


def test_best_fit_decreasing_against_a_plain_version():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64):
        lengths = rng.integers(1, capacity + 1, 300)
        window, offset = packing.best_fit_decreasing(lengths, capacity)
        left: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [x for x in left if x >= lengths[i]]
            assert capacity - offset[i] == (min(fits) if fits else capacity)
            if fits:
                left.remove(min(fits))
            left.append(capacity - offset[i] - lengths[i])
        for w in set(window.tolist()):
            parts = sorted((offset[i], lengths[i]) for i in np.flatnonzero(window == w))
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity


def test_packing_holds_every_id_once(spark):
    theirs = Tokenizer.from_file(WORDS)
    docs = [(i, "word other thing " * (i * 7 % 60)) for i in range(80)] + [(100, None), (101, ""), (102, "long " * 700), (102, "long " * 700)]
    pieces = packing.tokenise_and_cut(spark.createDataFrame(docs, SCHEMA), WORDS, 2, 64)
    got = packing.pack(pieces.withColumn("offset", F.lit("old")), 64, shards=3).collect()
    windows: dict[int, list] = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, text in docs[:-2]:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids) and all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in got if r.doc_id == 102) == 2 * 701
    assert sum(r.length for r in got) > 0.9 * 64 * len(windows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long"), 64).collect() == []


def test_page_sequences():
    html = '<script>x</script><p>One <b>two</b><img src="sha256:aa" alt="alt"> three</p><figure><img src="sha256:bb"><video src="v"></video><figcaption>cap &amp; tion</figcaption></figure>tail<img><figure><figcaption>alone</figcaption></figure>'
    got = [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in media.sequence(html)]
    assert got == [(0, "text", "One two", None, None), (1, "image", None, "sha256:aa", "alt"), (2, "text", "three", None, None), (3, "image", None, "sha256:bb", "cap & tion"), (4, "video", None, "v", "cap & tion"), (5, "text", "tail", None, None), (6, "text", "alone", None, None)]
    assert media.sequence(None) == media.sequence("") == []


def test_captions_of_nested_figures():
    show = lambda html: [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(html)]
    nested = '<figure><img src="a"><figcaption>outer <figure><img src="b"><figcaption>inner</figcaption></figure> tail</figcaption></figure>end'
    assert show(nested) == [("image", "a", "outer tail"), ("image", "b", "inner"), ("text", "end", None)]
    assert show('<figure><figcaption>first<p>then</p></figcaption><img src="a" alt="x"></figure>') == [("image", "a", "first then")]
    assert show('a<figure><figcaption>alone</figcaption><p>b</p></figure>c') == [("text", "a", None), ("text", "alone", None), ("text", "b", None), ("text", "c", None)]
    assert show('<figure><img src="a"><figcaption>not closed') == [("image", "a", "not closed")]
    assert show("</figure></figcaption>x") == [("text", "x", None)]


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 64, bytes(range(256)) * 3 + b"z", "é😀".encode() * 999])
def test_images_hold_payloads(payload):
    padded = media.pad(payload)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(payload) and not any(padded[len(payload) :])
    image = media.encode_image(padded)
    assert media.decode_image(image) == padded
    with pytest.raises(ValueError, match="damaged"):
        media.decode_image(image[:40] + bytes([image[40] ^ 1]) + image[41:])


def test_references_are_resolved_in_place(spark):
    texts = {1: "same", 2: "same", 3: "other", 4: ""}
    rows = [(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in texts.items()]
    payloads = spark.createDataFrame(rows, "doc_id long, digest string, text string")
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in [(i, f'<p>a</p><figure><img src="sha256:{d}"><figcaption>c{i}</figcaption></figure><img src="sha256:{"0" * 64}">') for i, d, _ in rows] + [(9, None)]], "page long, html string, position string, feature string")
    store = media.store_media(payloads, "digest", "text")
    got = media.resolve(media.sequences(pages), media.media_features(store)).collect()
    assert len(got) == 12 and all(r.position in (0, 1, 2) for r in got)
    for r in got:
        if r.position == 1:
            assert r.caption == f"c{r.page}" and r.payload_sha256 == brute.sha(media.pad(texts[r.page].encode())) and r.payload_bytes == 64
        else:
            assert r.payload_sha256 is None


def test_archives_round_trip(spark):
    rng = random.Random(8)
    long = ["x" * 999, "y" * 1000, "é" * 500, "word " * 400]
    pages = [(i, f"http://h/{i}\r\nX", rng.choice(long)) for i in range(40)] + [(100, None, None), (101, "u", ""), (None, "n", "y" * 1000), (102, "u", "short"), (102, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = warc.write_archives(warc.plan_records(df.withColumn("refers_to", df.url)))
    got = warc.read_archives(warc.archive_files(spark, folder)).collect()
    assert len(got) == len(pages) and all(r.error is None for r in got)
    last: dict[str, int] = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h in pages:
        body = (h or "").encode()
        r = next(r for r in got if r.page_id == i)
        revisit = len(body) >= 1000 and last[h or ""] != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None)
        assert (r.payload is None) == revisit and (revisit or bytes(r.payload) == body)
    files = [open(r.path.removeprefix("file:"), "rb").read() for r in warc.archive_files(spark, folder).select("path").collect()]
    assert len(files) > 1 and all(struct.unpack_from("<I", f)[0] == warc.DICTIONARY_MAGIC for f in files)
    assert sum(len(list(warc.frames(f))) for f in files) == len(pages)
    empty = warc.read_archives(warc.archive_files(spark, warc.write_archives(warc.plan_records(spark.createDataFrame([], df.schema)))))
    assert empty.collect() == []


def test_broken_archives_are_reported(spark):
    records = [warc.record(i, "http://h", b"body %d" % i, hashlib.sha1(b"body %d" % i).hexdigest(), 6, None) for i in range(5)]
    good = warc.archive(records)
    assert struct.unpack_from("<I", good)[0] == warc.DICTIONARY_MAGIC and [r for _, r in warc.frames(good)] == records
    wrong = zstandard.ZstdCompressor().compress(records[0].replace(b"Content-Length: 6\r\n\r\nbody", b"Content-Length: 7\r\n\r\nbody"))
    rows = [("a", good), ("cut", good[:-3]), ("none", b""), ("junk", b"not an archive"), ("wrong", wrong), ("null", None)]
    got = warc.read_archives(spark.createDataFrame(rows, "path string, content binary")).collect()
    by = {p: [r for r in got if r.path == p] for p, _ in rows}
    assert len(by["a"]) == 5 and not any(r.error for r in by["a"])
    assert [bool(r.error) for r in by["cut"]] == [False] * 4 + [True] and by["junk"][0].error and by["wrong"][0].error and by["none"] == by["null"] == []


def test_records_that_are_not_valid_are_errors():
    body = b"x" * 10
    digest = hashlib.sha1(body).hexdigest()
    good = warc.record(1, None, body, digest, 10, 2)
    assert warc.parse(good)["refers_to"] == 2
    for broken in (good.replace(b"<urn:page:2>", b"<page 2>"), good.replace(b"<urn:page:2>", b"<urn:page:99999999999999999999>"), warc.record(1 << 70, None, body, digest, 10, None)):
        with pytest.raises(ValueError):
            warc.parse(broken)
    packed = struct.pack("<I", warc.FRAME_MAGIC) + b"broken"
    with pytest.raises(ValueError):
        list(warc.frames(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed))


def test_payloads_are_read_as_streams_of_any_length(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a", "long " * 200_000), (2, "http://b", "short"), (3, None, None)], "page_id long, url string, html string")
    folder = warc.write_archives(warc.plan_records(pages))
    files = warc.archive_files(spark, folder)
    for r in warc.read_archives(files, payloads=False).collect():
        html = {1: "long " * 200_000, 2: "short", 3: ""}[r.page_id]
        assert (r.payload_bytes, r.payload_digest, r.payload, r.error) == (len(html), hashlib.sha1(html.encode()).hexdigest(), None, None)
    monkeypatch.setattr(warc, "MOST_FRAME", 1000)
    found = [warc.parsed(parts) for r in files.collect() for _, parts in warc.streams(bytes(r.content))]
    kept = {r["page_id"]: r for r in found}
    assert kept[1].get("payload") is None and "1000" in kept[1]["error"] and kept[1]["payload_bytes"] == 1_000_000 and kept[2]["payload"] == b"short" and "error" not in kept[2]


@pytest.mark.parametrize("step", [1, 5, 1 << 13])
def test_records_in_parts_are_parsed_as_wholes(step):
    body = b"a\r\n\r\nb" * 30
    raw = warc.record(7, "http://x", body, hashlib.sha1(body).hexdigest(), len(body), None)
    assert warc.parsed(raw[i : i + step] for i in range(0, len(raw), step)) == warc.parse(raw)
    assert warc.parse(raw)["payload"] == body and "payload" not in warc.parsed(iter([raw]), keep=False)
    for broken in (raw[:-1], raw + b"x", raw.replace(b"a\r", b"A\r", 1), raw[:100], b""):
        with pytest.raises(ValueError):
            warc.parsed(iter([broken[i : i + step] for i in range(0, len(broken), step)]))


def test_frames_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "MOST_FRAME", 1000)
    with pytest.raises(ValueError):
        list(warc.frames(zstandard.ZstdCompressor().compress(bytes(100_000))))


def test_chat_against_brute_force(spark):
    """Parents, threads and bodies of random conversations with nested quotes, some of them without an original."""
    rng = random.Random(5)
    rows = []
    for conv in range(12):
        said: list[str] = []
        for turn in range(rng.randint(1, 12)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                quoted = rng.choice([*said, "never said"])
                lines.append(">" * rng.randint(1, 3) + " " + (quoted.upper() if rng.random() < 0.3 else quoted.replace(" ", "   ")))
            said.append(f"words {rng.randint(0, 6)} of {conv % 3}")
            rows.append((conv, turn, "user", "\n".join([*lines, said[-1]])))
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    want = brute.chat(rows)
    assert {k: (r.parent_turn, r.root_turn, r.n_quoted, r.n_linked, r.body) for k, r in got.items()} == want
    assert sum(w[0] is not None for w in want.values()) > 30
    for conv in range(12):
        order = sorted((r for k, r in got.items() if k[0] == conv), key=lambda r: r.position)
        assert [r.position for r in order] == list(range(len(order))) and [(r.root_turn, r.turn) for r in order] == sorted((r.root_turn, r.turn) for r in order)


def test_chat_links_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, and you"), (1, 2, "user", ">> how  are YOU?\n> Fine, and you\n\nGood"), (1, 3, "user", "New topic"), (1, 4, "assistant", "> hello there\nhi"), (2, 0, None, None), (2, None, "user", "> nothing"), (None, 3, "user", "x"), (3, 0, "user", "> Fine, and you\nother conversation"), (3, 0, "user", "> Fine, and you\nother conversation")]
    got = chat.format_chat(spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, position int")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [(r.turn, r.parent_turn, r.root_turn, r.n_linked) for r in one] == [(0, None, 0, 0), (1, 0, 0, 1), (2, 1, 0, 2), (4, 0, 0, 1), (3, None, 3, 0)]
    assert [r.body for r in one] == ["Hello there\nHow are you?", "Fine, and you", "Good", "hi", "New topic"]
    assert one[1].formatted == "<|assistant|>\nFine, and you\n"
    assert all(r.parent_turn is None for r in got if r.conv_id != 1) and {r.role for r in got if r.conv_id == 2} == {"unknown", "user"}
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_positions_count_from_zero_in_each_conversation(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 20), i, "user", f"m{i}") for i in range(400)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.position, r.turn))
    for items in by.values():
        assert [p for p, _ in sorted(items)] == list(range(len(items))) and [t for _, t in sorted(items)] == sorted(t for _, t in items)
