"""The queries opN_<name> and their DuckDB SQL. Each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .chat import format_chat
from .collocations import collocations
from .divergence import divergence
from .exact_dedup import content_hash, exact_dedup
from .lexicon import decode_words, encode_words
from .media import media_features, resolve, sequences, store_media
from .packing import pack, tokenise_and_cut
from .pii import find_spans, labelled_table, train_field
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup
from .toxicity import held_out, score, train
from .warc import archive_files, plan_records, read_archives, write_archives


#: Where the public tokenizers lie; the files are never copied.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without an id"))
    html = F.concat(F.lit("<article><h1>document "), name, F.lit('</h1><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>document '), name, F.lit("</figcaption></figure><p>Its payload has "), F.col("n_bytes"), F.lit(" bytes.</p></article>"))
    items = sequences(docs.select("doc_id", "n_bytes", html.alias("html")))
    found = resolve(items, media_features(store_media(docs, "digest", "text"))).where("kind = 'image'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op1_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every page, in document order."""
    return sequences(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.inline("items"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), train_field(labelled_table(spark)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    ids = ids.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode(ids, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(read(spark, sf_dir, "conversations"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs.withColumn("text_sha256", content_hash(docs.text))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenise_and_cut(read(spark, sf_dir, "documents"), WORDS, end_id=2, capacity=4096)
    return pack(pieces, capacity=4096)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(plan_records(read(spark, sf_dir, "pages")))
    return read_archives(archive_files(spark, folder), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(read(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op13_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_words(read(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)
    ids = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    return decode_words(ids, WORDS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_media": op1_media,
    "op1_page_sequences": op1_page_sequences,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_chat": op6_chat,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_lexicon": op13_lexicon,
}

ORACLE_SQL = {
    "op2_substring_dedup": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
s AS (SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM d WHERE len(words) >= 35),
h AS (SELECT r, i, sha256(array_to_string(words[i : i + 34], ' ')) AS h FROM s),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM again),
w AS (SELECT r, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM d),
k AS (
  SELECT w.r, count(*) AS n, count(gone.p) AS gone,
         coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL), '') AS kept
  FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p
""",
    "op11_divergence": """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
g AS (
  SELECT s.lang, s.source, CAST(coalesce(n.n, 0) + 2 * coalesce(v.v, 0) AS HUGEINT) AS t
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang) LEFT JOIN n USING (lang, source)
),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // g.t AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
whole AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // CAST(sum(n) OVER (PARTITION BY lang) + 2 * v AS HUGEINT) AS q
  FROM whole JOIN v USING (lang)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_collocations": """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
),
p AS (SELECT r, lang, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS q FROM d),
s AS (SELECT r, q, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM p),
w AS (SELECT r, q, lang, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM s),
t AS (
  SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY r, q ORDER BY i)
),
f1 AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.w1, f2.w2, NULL AS w3, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL
  SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
),
scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
held AS (
  SELECT lang, w1, w2, max(f) AS longer
  FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
),
kept AS (
  SELECT b.lang, concat_ws(' ', b.w1, b.w2, b.w3) AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.w1 = b.w1 AND h.w2 = b.w2 AND b.w3 IS NULL
  WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op7_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""",
}
