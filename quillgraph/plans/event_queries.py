"""Queries over events: audits, ordinals, repeated submissions, rates, dates, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import audit, passages, ranks
from ..operators.spread import parts_of
from ..sources import traverse
from ..storage import written
from ..streaming import ingest
from .registry import query
from .star_graph import view


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))


K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("ag18_membership_union", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS seen, count(*) AS n, arg_min(props, event_id) AS p FROM events GROUP BY ALL)
SELECT user_id, arg_min(p, seen) AS props, string_agg(event_type, ',' ORDER BY seen) AS memberships, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY user_id""")  # fmt: skip
def membership_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.membership_union(events(spark, sf_dir), "user_id", "event_id", "props", "event_type")
    return rows.withColumn("memberships", F.array_join("memberships", ","))


@query("ag19_pagination_audit", f"""
WITH e AS (SELECT *, {K} AS k FROM events)
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_items, CAST(max(k) - min(k) + 1 - count(DISTINCT k) AS BIGINT) AS n_missing_pages,
       coalesce(max(k) - min(k) + 1 - count(DISTINCT k) = 0 AND count(*) = count(DISTINCT user_id), false) AS complete FROM e GROUP BY event_type""")  # fmt: skip
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pagination(events(spark, sf_dir), "event_type", "k", "user_id")


@query("wn05_cursor_chain", f"""
WITH e AS (SELECT user_id, event_id, {K} AS k, lag({K} + 1) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (rn = 1 OR coalesce(before = k, false)) AS n_chained, count(*) AS n FROM e GROUP BY user_id""")  # fmt: skip
def cursor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.cursor_chain(events(spark, sf_dir).withColumn("following", F.col("k") + 1), "user_id", "event_id", "k", "following")
    return rows.groupBy("user_id").agg(F.count_if("chained").alias("n_chained"), F.count("*").alias("n"))


@query("ag20_pair_audit", "SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type)) AS n_pairs, count(*) - count(DISTINCT (user_id, event_type)) AS n_duplicates FROM events")
def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pair_audit(events(spark, sf_dir), "user_id", "event_type")


@query("ag21_prefix_totals", """
WITH c AS (SELECT left(CAST(user_id AS VARCHAR), 2) AS p, count(*) AS n FROM events GROUP BY 1)
SELECT 1 AS length, left(CAST(user_id AS VARCHAR), 1) AS prefix, count(*) AS n, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE left(p, 1) = left(CAST(user_id AS VARCHAR), 1)) AS n_children_sum
FROM events GROUP BY 2, 4""")  # fmt: skip
def prefix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.prefix_totals(events(spark, sf_dir), "user_id", (1, 2))


@query("ag22_status_totals", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ROLLUP (event_type)")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("ag28_dataset_audit", f"""
SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT event_id) AS n_ids, count(*) FILTER ({K} IS NULL) AS n_without_k,
max(event_id) - min(event_id) + 1 = count(DISTINCT event_id) AS continuous FROM events""")  # fmt: skip
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_distinct("event_id").alias("n_ids"), F.count_if(F.col("k").isNull()).alias("n_without_k"))
    return rows.withColumn("continuous", F.col("last_id") - F.col("first_id") + 1 == F.col("n_ids"))


@query("ag29_trailing_hour", """
SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")  # fmt: skip
def trailing_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.trailing_counts(events(spark, sf_dir), "ts", "event_id", 3600).select("event_id", "recent")


@query("ss01_submission_codes", """
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 201 WHEN event_type = first(event_type) OVER w THEN 200 ELSE 409 END AS code
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")  # fmt: skip
def submission_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.submissions(events(spark, sf_dir), "user_id", "event_type", "event_id").select("event_id", "code")


@query("wn03_ordinals", "SELECT event_id, 'feed' AS _source, 'events' AS _dataset, row_number() OVER (ORDER BY ts, event_id) AS _record FROM events")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_ordinals(events(spark, sf_dir), "feed", "events", ["ts", "event_id"]).select("event_id", "_source", "_dataset", "_record")


@query("wn06_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_rows(events(spark, sf_dir), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("wn07_last_write", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.max_by("props", "event_id").alias("props"))


@query("wn08_first_write", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


TYPES = "WITH t AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), x AS (SELECT user_id FROM events, t WHERE event_type = a AND json_extract_string(props, '$.k') = '1'), y AS (SELECT user_id FROM events, t WHERE event_type = b AND json_extract_string(props, '$.k') = '2')"


def first_and_last(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir)
    ends = F.broadcast(rows.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")))  # one row
    joined = rows.join(ends)
    return joined.where("event_type = a AND k = 1").select("user_id"), joined.where("event_type = b AND k = 2").select("user_id")


@query("st01_union", f"{TYPES} SELECT user_id FROM x UNION SELECT user_id FROM y")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = first_and_last(spark, sf_dir)
    return x.union(y).distinct()


@query("st02_intersect", f"{TYPES} SELECT user_id FROM x INTERSECT SELECT user_id FROM y")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = first_and_last(spark, sf_dir)
    return x.intersect(y)


@query("st03_except", f"{TYPES} SELECT user_id FROM x EXCEPT SELECT user_id FROM y")
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = first_and_last(spark, sf_dir)
    return x.subtract(y)


@query("st04_symmetric_difference", f"{TYPES} (SELECT user_id FROM x EXCEPT SELECT user_id FROM y) UNION (SELECT user_id FROM y EXCEPT SELECT user_id FROM x)")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = first_and_last(spark, sf_dir)
    return audit.coverage_difference(x, y, "user_id").select("user_id")


@query("jn12_coverage_difference", f"""
{TYPES} SELECT DISTINCT user_id, 'missing' AS side FROM x WHERE user_id NOT IN (SELECT user_id FROM y)
UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM y WHERE user_id NOT IN (SELECT user_id FROM x)""")  # fmt: skip
def coverage_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage_difference(*first_and_last(spark, sf_dir), "user_id")


@query("st05_replaced_partition", f"""
{TYPES} SELECT event_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM x) UNION ALL SELECT event_id, 'repaired' FROM events WHERE user_id IN (SELECT user_id FROM x)""")  # fmt: skip
def replaced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (x, _) = events(spark, sf_dir), first_and_last(spark, sf_dir)
    repaired = rows.join(x.distinct(), "user_id", "left_semi").select("event_id", F.lit("repaired").alias("event_type"))
    return rows.join(x.distinct(), "user_id", "left_anti").select("event_id", "event_type").unionByName(repaired)


@query("sf25_iso_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, true AS valid FROM events")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).withColumn("valid", fn.iso_date("day"))


@query("sf26_month_intervals", """
WITH r AS (SELECT event_type, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY event_type),
m AS (SELECT event_type, a, b, unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM r)
SELECT event_type, strftime(greatest(CAST(m AS DATE), a), '%Y-%m-%d') AS first, strftime(least(last_day(m), b), '%Y-%m-%d') AS last FROM m""")  # fmt: skip
def month_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    rows = rows.select("event_type", F.explode(fn.months("a", "b")).alias("m"))
    return rows.select("event_type", F.date_format("m.first", "yyyy-MM-dd").alias("first"), F.date_format("m.last", "yyyy-MM-dd").alias("last"))


@query("sf28_epoch_seconds", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.unix_timestamp("ts").alias("seconds"))


@query("sf40_deep_get", f"SELECT event_id, coalesce({K}, -1) AS k, coalesce(json_extract_string(props, '$.absent.deeper'), 'none') AS absent FROM events")
def deep_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.coalesce("k", F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.absent.deeper"), F.lit("none")).alias("absent"))


@query("sf41_canonical_json", """SELECT event_id, replace(props, ' ', '') AS canonical, left(sha256(replace(props, ' ', '')), 16) AS id FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", fn.canonical_json("props").alias("canonical")).withColumn("id", fn.content_id("canonical", 16))


@query("sf33_median", "SELECT event_type, round(median(value), 6) AS median, round(list_sort(list(value))[1 + CAST(floor(0.9 * (count(*) - 1)) AS INT)], 6) AS p90 FROM events GROUP BY event_type")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact elements at ranks, by a sort over all tasks."""
    found = ranks.elements(events(spark, sf_dir), "event_type", "value", low=lambda n: F.floor((n + 1) / 2), high=lambda n: F.floor((n + 2) / 2), p90=ranks.index_rank(0.9))
    return found.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("p90", 6).alias("p90"))


@query("ss03_acknowledged", """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS b FROM lineitem),
n AS (SELECT l_orderkey, b + 1 AS b FROM a UNION SELECT DISTINCT l_orderkey, 0 FROM lineitem)
SELECT l_orderkey, CAST(min(b) AS BIGINT) AS acknowledged FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = n.l_orderkey AND a.b = n.b) GROUP BY l_orderkey""")  # fmt: skip
def acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unbroken run of lines that each order begins with."""
    acks = view(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("batch"))
    return ingest.contiguous(acks, ["l_orderkey"], "batch", parts_of(acks))


@query("sk10_export_batches", """
WITH RECURSIVE s AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, strlen(coalesce(text, '')) AS size FROM documents
),
r AS (
  SELECT i, doc_id, size AS held, 1 AS n, CAST(0 AS BIGINT) AS batch FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, s.doc_id, CASE WHEN r.held + s.size > 200000 OR r.n = 100 THEN s.size ELSE r.held + s.size END,
    CASE WHEN r.held + s.size > 200000 OR r.n = 100 THEN 1 ELSE r.n + 1 END, CASE WHEN r.held + s.size > 200000 OR r.n = 100 THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN s ON s.i = r.i + 1
)
SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY batch""")  # fmt: skip
def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of at most 100 rows and 200,000 bytes of text, in order of their ids."""
    rows = view(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.lit(1).alias("all"))
    found = passages.greedy_batches(rows, "all", "doc_id", "size", 200_000, 100)
    return found.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("sc24_date_partitions", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
y AS (SELECT date_trunc('year', d) AS y, count(*) AS n FROM o GROUP BY ALL),
m AS (SELECT date_trunc('month', d) AS m, count(*) AS n FROM o WHERE date_trunc('year', d) IN (SELECT y FROM y WHERE n > 1000) GROUP BY ALL),
s AS (SELECT d, count(*) AS n FROM o WHERE date_trunc('month', d) IN (SELECT m FROM m WHERE n > 1000) GROUP BY ALL)
SELECT CAST(y AS DATE) AS first, CAST(y + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS last, n, true AS complete FROM y WHERE n <= 1000
UNION ALL SELECT CAST(m AS DATE), last_day(CAST(m AS DATE)), n, true FROM m WHERE n <= 1000 UNION ALL SELECT d, d, n, n <= 1000 FROM s""")  # fmt: skip
def date_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of orders split into months and days until no part has over 1,000; days that still have are not complete."""
    dates = view(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).groupBy("d").agg(F.count("*").alias("k"))
    dates = written(dates, "days")  # a row for each day of the calendar
    years = dates.select(F.year("d").alias("y")).distinct().select(F.make_date("y", F.lit(1), F.lit(1)).alias("first"), F.make_date("y", F.lit(12), F.lit(31)).alias("last"))

    def counted(parts: DataFrame) -> DataFrame:
        in_part = (F.col("d") >= F.col("first")) & (F.col("d") <= F.col("last"))
        return parts.join(dates, in_part, "left").groupBy(*parts.columns).agg(F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("n"))

    found = traverse.partitioned(years, counted, traverse.days, most=1000)
    return found.leaves.withColumn("complete", F.lit(True)).unionByName(found.too_large.withColumn("complete", F.lit(False)))
