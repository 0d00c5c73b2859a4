"""Queries over documents, benchmark passages, pages, labels, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import ask, passages, scoring, search
from ..sources import article, markup
from .registry import query
from .star_graph import view


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents")


@query("sf02_squeezed", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.squeezed("text").alias("t")).select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


@query("sf03_slug", "SELECT p_partkey, trim(regexp_replace(lower(concat(p_name, ' / ', p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select("p_partkey", fn.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("sf04_term_mentions", r"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\pL\pN_\pM])licensed($|[^\pL\pN_\pM])') GROUP BY lang")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(fn.mentions("text", "Licensed")).groupBy("lang").agg(F.count("*").alias("n"))


@query("sf38_pattern_mentions", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+\.[0-9]+'))), '|') AS found FROM documents")
def pattern_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(fn.all_matches("text", r"[0-9]+\.[0-9]+"), "|").alias("found"))


@query("sf05_substitutions", """
WITH r AS (SELECT p_partkey, ['R', 'Q', 'W', 'S'][1 + p_partkey % 4] AS x, ['L', 'K'][1 + p_size % 2] AS y, p_size + 100 AS n FROM part)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN y = 'L' THEN [concat(x, n, y), concat(x, n + 1, y)] ELSE [concat(x, n + 1, y)] END), '|') AS found FROM r""")  # fmt: skip
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-letter and one-letter codes in any case; a mixed one is none."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    i, j, n = F.col("p_partkey") % 4, F.col("p_size") % 2, F.col("p_size") + 100
    long = F.concat(F.lit("seen: p."), pick(("Arg", "gln", "TRP", "Ser"), i), n, pick(("Leu", "k"), j), F.lit(", again; "))
    short = F.concat(F.lower(pick(("R", "Q", "W", "S"), i)), n + 1, pick(("L", "K"), j), F.lit(" x"))
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.substitutions(F.concat(long, short)), "|").alias("found"))


@query("sf08_leading_number", r"SELECT c_custkey, TRY_CAST(replace(regexp_extract(concat(' ', c_acctbal, ' ± 3'), '^\s*([+-]?\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS number FROM customer")
def leading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").select("c_custkey", fn.leading_number(F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" ± 3"))).alias("number"))


@query("sf13_split_list", r"SELECT p_partkey, unnest(list_filter(regexp_split_to_array(p_type, '[|;,\s]+'), lambda x: x <> '')) AS part FROM part")
def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select("p_partkey", F.explode(fn.split_list("p_type")).alias("part"))


@query("pf03_tokens_overlap", r"SELECT p_partkey, list_has_any(regexp_split_to_array(p_name, '[|;,\s]+'), ['part', '17']) AS hit FROM part")
def tokens_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select("p_partkey", fn.tokens_overlap("p_name", ["part", "17"]).alias("hit"))


@query("sf14_substring_slice", "SELECT doc_id, substring(text, 11, 20) AS quote, length(text) AS n FROM documents")
def substring_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.substring("text", 11, 20).alias("quote"), F.length("text").alias("n"))


@query("sf15_length_bounds", r"SELECT doc_id, length(text) BETWEEN 50 AND 5000 AS fits, regexp_matches(text, '[\x00-\x08\x0B-\x1F]') AS controls FROM documents")
def length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length("text").between(50, 5000).alias("fits"), F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]").alias("controls"))


@query("sf42_content_ids", "SELECT doc_id, left(sha256(text), 16) AS short_id, left(sha256(text), 24) AS id FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.content_id("text", 16).alias("short_id"), fn.content_id("text", 24).alias("id"))


@query("gr15_content_groups", r"""
SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_id, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1""")  # fmt: skip
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.content_groups(docs(spark, sf_dir), "doc_id", "text")


@query("wn10_fixed_strides", """
WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, CAST(ceil((length(text) - 100) / 900) AS INT)) - 1)) AS chunk FROM documents WHERE text <> '')
SELECT doc_id AS id, CAST(chunk AS INT) AS chunk, CAST(chunk * 900 AS INT) AS start, CAST(least(chunk * 900 + 1000, length(text)) AS INT) AS "end", md5(substring(text, CAST(chunk * 900 + 1 AS INT), 1000)) AS digest FROM c""")  # fmt: skip
def fixed_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.strides(docs(spark, sf_dir), "doc_id", "text", 1000, 100)
    return rows.select("id", "chunk", "start", "end", F.md5("content").alias("digest"))


@query("wn10_word_chunks", r"""
WITH RECURSIVE t AS (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
n AS (SELECT id, t, length(t) AS n FROM t WHERE t <> ''),
c AS (
  SELECT id, t, n, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS s, CASE WHEN n <= 3600 THEN n ELSE coalesce(nullif(CASE WHEN strpos(reverse(substring(t, 1, 3600)), ' ') BETWEEN 1 AND 1800 THEN 3600 - strpos(reverse(substring(t, 1, 3600)), ' ') END, 0), 3600) END AS e FROM n
  UNION ALL
  SELECT id, t, n, chunk + 1, s, CASE WHEN n <= s + 3600 THEN n WHEN strpos(reverse(substring(t, s + 1, 3600)), ' ') BETWEEN 1 AND 1800 THEN s + 3600 - strpos(reverse(substring(t, s + 1, 3600)), ' ') ELSE s + 3600 END
  FROM (
    SELECT id, t, n, chunk, CASE WHEN substring(t, w, 1) = ' ' THEN w WHEN strpos(substring(t, w + 1, e - w), ' ') > 0 THEN w + strpos(substring(t, w + 1, e - w), ' ') ELSE w END AS s
    FROM (SELECT *, greatest(s + 1, e - 400) AS w FROM c WHERE e < n)
  )
)
SELECT id, CAST(chunk AS INT) AS chunk, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", substring(t, s + 1, e - s) AS content FROM c""")  # fmt: skip
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.word_chunks(docs(spark, sf_dir), "doc_id", "text")


@query("sk06_manifest", "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS INT) AS most_bytes FROM documents GROUP BY lang")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.manifest(docs(spark, sf_dir), "lang", "source", "text")


LOCATED = "SELECT item_id AS passage, doc_id AS id, CAST(strpos(d.text, b.text) - 1 AS INT) AS start, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS INT) AS \"end\" FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''"


@query("jn16_located_passages", LOCATED)
def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.locate(view(spark, sf_dir, "benchmark"), docs(spark, sf_dir), "item_id", "text", "doc_id", "text")


@query("gr15_grounded_spans", f"""
WITH l AS ({LOCATED}),
p AS (SELECT l.passage, l.id, l.start + CASE l.passage % 3 WHEN 1 THEN 1 ELSE 0 END AS s, l."end" - l.start AS n, concat(b.text, CASE l.passage % 3 WHEN 2 THEN '!' ELSE '' END) AS quote FROM l JOIN benchmark b ON b.item_id = l.passage)
SELECT p.passage, p.id, substring(d.text, CAST(s AS INT) + 1, CAST(n AS INT)) = quote AS exact FROM p JOIN documents d ON d.doc_id = p.id""")  # fmt: skip
def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which a third stand a place too far and a third quote a mark too many."""
    bench, found = view(spark, sf_dir, "benchmark"), located(spark, sf_dir)
    kind = F.col("passage") % 3
    quotes = bench.select(F.col("item_id").alias("passage"), F.concat("text", F.when(F.col("item_id") % 3 == 2, "!").otherwise("")).alias("quote"))
    far = (kind == 1).cast("int")
    spans = found.join(quotes, "passage").withColumnRenamed("id", "unit_id").withColumns({"start": F.col("start") + far, "end": F.col("end") + far})
    rows = passages.grounded(spans, docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), "text"))
    return rows.select("passage", F.col("unit_id").alias("id"), "exact")


KEYWORD_SQL = r"""
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> ''))) AS term FROM benchmark),
w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS m FROM w),
tf AS (SELECT id, len(words) AS size, unnest(words) AS term FROM w),
c AS (SELECT id, size, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
k AS (
  SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))) AS score
  FROM c JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL
),
kr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, 6) AS score FROM k))
"""


def keyword_ranks(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """The benchmark's items are the queries."""
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scores = search.keyword_scores(docs(spark, sf_dir), asked, "doc_id", "text", k=k).withColumn("score", F.round("score", 6))
    return search.best(scores, k)


@query("gr16_keyword_search", f"WITH {KEYWORD_SQL} SELECT query_id, id, score, rank FROM kr WHERE rank <= 50")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_ranks(spark, sf_dir)


@query("gr18_fused_search", f"""
WITH {KEYWORD_SQL},
v AS (
  SELECT item_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM benchmark JOIN embeddings a ON a.vec_id = item_id, embeddings b JOIN documents ON doc_id = b.vec_id
),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v),
u AS (SELECT query_id, id, rank FROM kr WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM vr WHERE rank <= 50),
x AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_channels FROM u GROUP BY ALL)
SELECT query_id, id, n_channels, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x""")  # fmt: skip
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword ranks fused with vector ranks. The vector of a document, and of a benchmark item, is that of its id."""
    vectors = view(spark, sf_dir, "embeddings")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    known = vectors.join(docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = search.best(search.vector_scores(known, asked, "vec_id", "embedding", k=50).withColumn("score", F.round("score", 6)), 50)
    rows = search.fused([keyword_ranks(spark, sf_dir), near]).withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.select("query_id", "id", "n_channels", F.round("score", 6).alias("score"), F.row_number().over(order).alias("rank"))


VECTOR_SQL = """
v AS (
  SELECT a.vec_id AS query_id, a.label AS label, b.vec_id AS id, b.label AS other,
    round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v)
"""


def vector_ranks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Vectors whose id is divisible by 100 are the stated queries, against all vectors but themselves."""
    every = view(spark, sf_dir, "embeddings")
    asked = every.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    scores = search.vector_scores(every, asked, "vec_id", "embedding", k=k + 1).where("query_id <> id")
    return search.best(scores.withColumn("score", F.round("score", 6)), k)


@query("gr17_vector_search", f"WITH {VECTOR_SQL} SELECT query_id, id, score, rank FROM vr WHERE rank <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_ranks(spark, sf_dir, 10)


@query("ag23_retrieval_quality", f"""
WITH {VECTOR_SQL}, f AS (SELECT query_id, min(rank) FILTER (label = other AND rank <= 5) AS first, bool_or(label = other) AS any_relevant FROM vr GROUP BY query_id)
SELECT count(*) AS n_queries, count(first) AS n_hits, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f WHERE any_relevant""")  # fmt: skip
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(labels.withColumnRenamed("vec_id", "id"), "label").where("query_id <> id").select("query_id", "id")
    found = search.retrieval_quality(vector_ranks(spark, sf_dir, 5), relevant, 5)
    return found.select("n_queries", "n_hits", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


# Predictions for the labelled documents, by a fixed rule: long texts are called good.
JUDGED = "j AS (SELECT source, d.doc_id, quality = 1 AS truth, CASE WHEN n_chars % 17 <> 0 THEN n_chars >= 400 END AS predicted FROM documents d JOIN labels USING (doc_id))"
COUNTED = f"{JUDGED}, c AS (SELECT source, count(*) FILTER (truth AND coalesce(predicted, false)) AS tp, count(*) FILTER (NOT truth AND coalesce(predicted, false)) AS fp, count(*) FILTER (truth AND NOT coalesce(predicted, false)) AS fn FROM j GROUP BY source)"
PRF = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "source", "n_chars").join(view(spark, sf_dir, "labels"), "doc_id")
    return rows.select("source", "doc_id", (F.col("quality") == 1).alias("truth"), F.when(F.col("n_chars") % 17 != 0, F.col("n_chars") >= 400).alias("predicted"))


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query("ag10_micro_scores", f"WITH {COUNTED}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c) SELECT tp, fp, fn, {PRF} FROM t")
def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.micro(judged(spark, sf_dir), "truth", "predicted"))


@query("ag11_macro_scores", f"""
WITH {COUNTED}, p AS (SELECT tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(precision) AS n_precision, count(recall) AS n_recall, count(f1) AS n_f1, count(*) AS n_groups FROM p""")  # fmt: skip
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.macro(scoring.micro(judged(spark, sf_dir), "truth", "predicted", ["source"])))


LABELS = ["good", "poor"]
NAMED = f"{JUDGED}, l AS (SELECT CASE WHEN truth THEN 'good' ELSE 'poor' END AS truth, coalesce(CASE WHEN predicted THEN 'good' WHEN NOT predicted THEN 'poor' END, 'abstain') AS predicted FROM j), m AS (SELECT a.t AS truth, b.p AS predicted, (SELECT count(*) FROM l WHERE truth = a.t AND predicted = b.p) AS n FROM (SELECT unnest(['good', 'poor']) AS t) a, (SELECT unnest(['good', 'poor', 'abstain']) AS p) b)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(F.col(c), "good").when(~F.col(c), "poor").alias(c)
    return judged(spark, sf_dir).select(name("truth"), name("predicted"))


@query("ag12_confusion", f"WITH {NAMED} SELECT truth, predicted, n FROM m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(named(spark, sf_dir), "truth", "predicted", LABELS)


@query("ag13_per_label", f"""
WITH {NAMED}, s AS (SELECT x AS label, CAST(sum(n) FILTER (truth = x AND predicted = x) AS BIGINT) AS tp, CAST(sum(n) FILTER (truth <> x AND predicted = x) AS BIGINT) AS fp,
CAST(sum(n) FILTER (truth = x AND predicted <> x) AS BIGINT) AS fn FROM m, (SELECT unnest(['good', 'poor']) AS x) GROUP BY x) SELECT label, tp, fp, fn, {PRF} FROM s""")  # fmt: skip
def per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.per_label(confusion(spark, sf_dir), "truth", "predicted", LABELS))


@query("ag15_bootstrap", f"""
WITH {JUDGED},
c AS (
  SELECT CAST(source AS VARCHAR) AS cluster, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT coalesce(predicted, false)) AS fn FROM j GROUP BY source
),
n AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS at_, count(*) OVER () AS k FROM c),
d AS (SELECT d, i, CAST(concat('0x', left(md5(concat(20261004, ':', d, ':', i)), 15)) AS BIGINT) % k AS at_ FROM generate_series(0, 499) x(d), (SELECT generate_series AS i, k FROM (SELECT DISTINCT k FROM n), generate_series(0, 999) WHERE generate_series < k)),
s AS (SELECT d, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn FROM d JOIN n USING (at_) GROUP BY d),
v AS (
  SELECT 'precision' AS metric, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END AS value FROM s UNION ALL SELECT 'recall', CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END FROM s
  UNION ALL SELECT 'f1', CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) END FROM s
),
l AS (SELECT metric, list_sort(list(value) FILTER (value IS NOT NULL)) AS v, count(*) - count(value) AS n_undefined FROM v GROUP BY metric)
SELECT metric, round(v[1 + CAST(floor(0.025 * (len(v) - 1)) AS INT)], 9) AS low, round(v[1 + CAST(floor(0.975 * (len(v) - 1)) AS INT)], 9) AS high, n_undefined FROM l""")  # fmt: skip
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bootstrap(scoring.counts(judged(spark, sf_dir), "truth", "predicted", ["source"]).withColumnRenamed("source", "cluster"), draws=500).select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n_undefined")


@query("ag16_accuracy", f"WITH {JUDGED} SELECT source, count(*) AS n, count(predicted) AS n_answered, round(avg(CASE WHEN predicted IS NOT NULL THEN CAST(predicted = truth AS INT) END), 6) AS accuracy FROM j GROUP BY source")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judged(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count("predicted").alias("n_answered"), F.avg((F.col("predicted") == F.col("truth")).cast("int")).alias("accuracy")))


@query("jn18_annotator_agreement", """
WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, quality, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'a_only' WHEN a.doc_id IS NULL THEN 'b_only' ELSE 'both' END AS side,
CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN CASE WHEN a.toxic <> b.toxic THEN 'toxic' ELSE '' END END AS differing FROM a FULL JOIN b ON a.doc_id = b.doc_id""")  # fmt: skip
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "labels")
    b = rows.where("doc_id % 11 <> 0").withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = scoring.compare_annotators(rows.where("doc_id % 7 <> 0"), b, ["doc_id"], ["quality", "toxic"])
    return found.withColumn("differing", F.array_join("differing", ","))


@query("va10_split_leaks", "SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.count_distinct("lang").alias("n")).where("n > 1")


@query("sf18_url_parts", r"""
SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS public, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '(^|\.)example\.com$') AS within FROM pages""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", fn.public_url("url").alias("public"), F.lower(fn.url_part("url", "HOST")).alias("host"), fn.host_within("url", "example.com").alias("within"))


@query("pf08_redacted_urls", r"""
SELECT page_id, regexp_replace(regexp_replace(u, '#.*$', ''), '(?i)([?&](?:api_key|apikey|key|token|access_token)=)[^&#]*', '\1REDACTED', 'g') AS url
FROM (SELECT page_id, concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'token=s3cret&x=', page_id) AS u FROM pages)""")  # fmt: skip
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("token=s3cret&x="), "page_id")
    return view(spark, sf_dir, "pages").select("page_id", fn.redacted_url(url).alias("url"))


@query("pf12_page_checks", """
SELECT page_id, CASE WHEN NOT contains(html, '<article') THEN 'no_article' WHEN length(html) < 800 THEN 'too_short' WHEN contains(lower(html), 'captcha') THEN 'challenge' ELSE 'ok' END AS verdict FROM pages""")  # fmt: skip
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(~F.col("html").contains("<article"), "no_article").when(F.length("html") < 800, "too_short").when(F.lower("html").contains("captcha"), "challenge").otherwise("ok")
    return view(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


@query("sf49_page_units")
def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_units(view(spark, sf_dir, "pages"), "page_id", "html")


@query("sf48_elements", r"""
WITH t AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2></\1>', 'g') AS html FROM pages
)
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM t) GROUP BY ALL""")  # fmt: skip
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.elements(view(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("sf49_articles")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each kind every page's article holds, and a digest of all that was found."""
    found = article.articles(view(spark, sf_dir, "pages"), "page_id", "html", "url")
    words = F.aggregate("units", F.lit(0), lambda n, u: n + F.size(F.split(u.text, " ")))
    digest = F.sha2(F.to_json(F.struct("units", "tables", "images", "supplement_links", "repairs")), 256)
    return article.counts(found, "page_id", words.alias("n_words"), digest.alias("digest"))


@query("sc18_page_links", r"""
WITH t AS (SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
n AS (SELECT page_id, url, 'nav' AS place, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="[^"]*">[^<]*</a>')) AS a FROM t),
f AS (SELECT page_id, url, 'footer', unnest(regexp_extract_all(regexp_extract(html, '(?s)<footer>.*?</footer>'), '<a href="[^"]*">[^<]*</a>')) FROM t)
SELECT page_id, place, concat(regexp_extract(url, '^https?://[^/?#]*'), regexp_extract(a, 'href="([^"]*)"', 1)) AS url, regexp_extract(a, '>([^<]*)<', 1) AS text, count(*) AS n
FROM (SELECT * FROM n UNION ALL SELECT * FROM f) GROUP BY ALL""")  # fmt: skip
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page with where they stand: in its navigation, its footer or its text."""
    links = markup.html_links(view(spark, sf_dir, "pages"), "page_id", "html", "url", everywhere=True)
    return links.groupBy("page_id", F.coalesce("place", F.lit("text")).alias("place"), "url", "text").agg(F.count("*").alias("n"))


@query("gr10_intents", r"""
SELECT conv_id, turn, CASE
  WHEN regexp_matches(lower(text), '\b(treat|treatment|cure|dose|dosage|medication|diagnose|diagnosis|take a drug)\b') THEN 'clinical'
  WHEN regexp_matches(lower(text), '\b(conflict|conflicting|contradict|contradiction|uncertain)\w*\b') THEN 'conflict'
  WHEN regexp_matches(lower(text), '\b(asset|assets|resource|resources|reuse|reusable|partner|partners)\b') THEN 'asset'
  WHEN regexp_matches(lower(text), '\b(evidence|source|sources|support|proof|paper|papers)\b') THEN 'evidence'
  WHEN regexp_matches(lower(text), '\b(connect|connected|connection|connections|related|why|similar)\b') THEN 'connections'
  WHEN regexp_matches(lower(text), '\b(what|tell|describe|about|show|who)\b') THEN 'describe'
  WHEN regexp_matches(lower(text), '\b(overview|graph|start|here|explore)\b') THEN 'overview'
  ELSE 'missing' END AS intent, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations""")  # fmt: skip
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ask.intent("text").alias("intent"), F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
