"""Queries for filters, gates, joins, scalar functions and validators over the star schema and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import nested, rebuilt, scoring, select, state, validate
from ..storage import written
from .registry import query
from .star_graph import GRAPH_SQL, star_graph, view


@query("ag04_context_difference", f"""
WITH {GRAPH_SQL}, h AS (SELECT subject, list_distinct(list(tissue)) AS t, list_distinct(list(stage)) AS s FROM claims WHERE predicate = 'HAS_EFFECT' GROUP BY subject)
SELECT a.subject AS variant, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 'unknown' WHEN NOT list_has_any(a.t, b.t) THEN 'mismatch' END AS tissue,
CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 'unknown' WHEN NOT list_has_any(a.s, b.s) THEN 'mismatch' END AS stage
FROM h a JOIN h b ON b.subject = concat('V:', CAST(CAST(substring(a.subject, 3) AS BIGINT) + 1 AS VARCHAR))""")  # fmt: skip
def context_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir).claims.where("predicate = 'HAS_EFFECT'").groupBy("subject").agg(state.known_values(F.collect_set("tissue")).alias("t"), state.known_values(F.collect_set("stage")).alias("s"))
    other = rows.select(F.concat(F.lit("V:"), (F.substring("subject", 3, 20).cast("long") - 1).cast("string")).alias("subject"), F.col("t").alias("t2"), F.col("s").alias("s2"))
    return rows.join(other, "subject").select(F.col("subject").alias("variant"), state.context_difference(F.col("t"), F.col("t2")).alias("tissue"), state.context_difference(F.col("s"), F.col("s2")).alias("stage"))


@query("ag09_counters", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("ag24_source_rollups", "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, count(*) FILTER (n_chars >= 1000) AS n_long, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def source_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.count_if(F.col("n_chars") >= 1000).alias("n_long"), F.sum("n_chars").alias("n_chars"))


@query("ag25_tiers", """
WITH g AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS s, bool_or(o_orderpriority = '5-LOW') AS w, bool_or(o_totalprice > 300000) AS e FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN s AND e THEN 'A' WHEN s OR e THEN 'B' WHEN w THEN 'C' ELSE 'none' END AS tier FROM g""")  # fmt: skip
def customer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").withColumn("large", F.col("o_totalprice") > 300000)
    return select.tiers(rows, "o_custkey", "o_orderpriority", ["1-URGENT"], ["5-LOW"], "large")


@query("ag14_anchored_agreement", """
WITH a AS (SELECT doc_id, quality, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 4 <> 0),
p AS (SELECT a.quality = b.quality AS q, a.toxic = b.toxic AS t FROM a JOIN b USING (doc_id))
SELECT 'quality' AS field, count(*) AS n_pairs, count(*) FILTER (q) AS n_equal, round(count(*) FILTER (q) / count(*), 6) AS share FROM p
UNION ALL SELECT 'toxic', count(*), count(*) FILTER (t), round(count(*) FILTER (t) / count(*), 6) FROM p""")  # fmt: skip
def anchored_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "labels")
    b = rows.where("doc_id % 4 <> 0").withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return scoring.anchored_agreement(rows, b, ["doc_id"], ["quality", "toxic"]).withColumn("share", F.round("share", 6))


@query("ag17_cost_per_correct", "SELECT o_orderpriority, round(sum(o_totalprice) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 2) AS cost FROM orders GROUP BY o_orderpriority")
def cost_per_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(fn.ratio(F.sum("o_totalprice"), F.count_if(F.col("o_orderstatus") == "F")), 2).alias("cost"))


@query("pf02_native_struct", "SELECT concat('rec-', c_custkey) AS _record, c_name AS name, c_mktsegment AS segment FROM customer")
def native_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer").select(F.concat(F.lit("rec-"), "c_custkey").alias("_record"), "c_name", "c_mktsegment")
    return select.native(rows).select("_record", F.col("native.c_name").alias("name"), F.col("native.c_mktsegment").alias("segment"))


@query("pf05_metadata_filter", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') AND p_type = 'SMALL'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    return select.metadata(rows, words="ring", p_type="SMALL").select("p_partkey")


@query("pf06_without_empty", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS n_fields FROM orders")
def without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("status"), F.nullif("o_orderstatus", F.lit("O")), F.lit("priority"), F.col("o_orderpriority"), F.lit("blank"), F.lit(" "))
    return view(spark, sf_dir, "orders").select("o_orderkey", F.size(select.without_empty(fields)).alias("n_fields"))


@query("pf09_licence_status", r"""
WITH l AS (SELECT doc_id, lower(trim(regexp_extract(text, 'Licensed under (the )?([^.,\n]+)', 2))) AS l FROM documents)
SELECT doc_id, CASE WHEN l = '' THEN 'missing' WHEN l IN ('apache license', 'cc by 4', 'mit license') THEN 'open' WHEN l IN ('cc by-nc 4') THEN 'restricted' ELSE 'unknown' END AS status FROM l""")  # fmt: skip
def licence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"Licensed under (the )?([^.,\n]+)", 2).alias("licence"))
    return rows.select("doc_id", select.licence_status("licence", ["apache license", "cc by 4", "mit license"], ["cc by-nc 4"]).alias("status"))


@query("pf10_relevance_gate", r"SELECT page_id FROM pages WHERE page_id IN (3, 5) OR list_has_any(regexp_extract_all(url, '[a-z]+'), ['www', 'fr']) OR regexp_matches(concat(url, ' ', left(html, 200)), '(?i)lang=.de')")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("url", F.lit("[a-z]+"), F.lit(0))
    gate = F.col("page_id").isin(3, 5) | F.arrays_overlap(words, F.array(F.lit("www"), F.lit("fr"))) | F.concat_ws(" ", "url", F.left("html", F.lit(200))).rlike("(?i)lang=.de")
    return view(spark, sf_dir, "pages").where(gate).select("page_id")


@query("pf11_eligible_terms", """
WITH n AS (SELECT lower(trim(p_brand)) AS term, CAST(p_partkey AS VARCHAR) AS id FROM part UNION ALL
  SELECT term, id FROM (SELECT lower(trim(unnest(string_split(concat(p_name, '//x y//', p_type), '//')))) AS term, CAST(p_partkey AS VARCHAR) AS id FROM part) WHERE length(term) >= 10 AND contains(term, ' '))
SELECT term, count(DISTINCT id) AS n, min(id) AS first FROM n WHERE term <> '' GROUP BY term""")  # fmt: skip
def eligible_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "part").withColumn("aliases", F.concat_ws("//x y//", "p_name", "p_type"))
    return select.eligible_terms(rows, "p_brand", "aliases", "p_partkey").select("term", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"))


@query("pf14_nested_gate", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_quantity > 40)")
def nested_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    assays = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("parts"))
    return assays.where(F.exists("parts", lambda p: (p.l_returnflag == "R") & (p.l_quantity > 40))).select("l_orderkey")


ALIASES_SQL = "SELECT p_partkey, unnest([concat(p_name, '/', p_brand, '/', p_size), concat(p_name, '/', p_brand, '/', p_type, '/', p_partkey // 7)]) AS w FROM part"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part under two names, as a list that | separates."""
    name = lambda *rest: F.concat_ws("/", "p_name", "p_brand", *rest)
    return view(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", name("p_size"), name("p_type", F.floor(F.col("p_partkey") / 7).cast("string"))).alias("names"))


REFERENCES_SQL = f"w AS ({ALIASES_SQL}), s AS (SELECT p_partkey, list_sort(list(DISTINCT w)) AS refs FROM w GROUP BY p_partkey), c AS (SELECT refs, min(p_partkey) AS class, count(*) AS size FROM s GROUP BY refs)"


@query("jn13_reference_classes", f"WITH {REFERENCES_SQL} SELECT p_partkey AS id, class, size FROM s JOIN c USING (refs)")
def reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.reference_classes(aliases(spark, sf_dir), "p_partkey", "names", r"\|").select("id", "class", "size")


@query("jn13_cross_references", f"""
WITH w AS ({ALIASES_SQL}) SELECT DISTINCT a.p_partkey AS "left", b.p_partkey AS "right" FROM w a JOIN w b USING (w)""")  # fmt: skip
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts that share an alias, from the pairs of their classes."""
    classes = written(select.reference_classes(aliases(spark, sf_dir), "p_partkey", "names", r"\|"), "classes")
    return select.expanded_references(select.cross_references(classes, classes), classes)


@query("jn14_name_containment", "SELECT a.p_partkey AS part, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND contains(b.p_name, string_split(a.p_name, ' ')[2]) GROUP BY a.p_partkey")
def name_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on the brand, containment as what is left to check.

    Parts of one brand and name are counted first, so what is compared are the names of a brand, not its parts.
    """
    parts = view(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.get(F.split("p_name", " "), F.lit(1)).alias("word"))
    names = parts.groupBy("p_brand", "p_name").agg(F.count("*").alias("size"))
    asked = parts.select("p_brand", "word").distinct()
    counts = asked.join(names, "p_brand").where(F.col("p_name").contains(F.col("word"))).groupBy("p_brand", "word").agg(F.sum("size").alias("n"))
    return parts.join(counts, ["p_brand", "word"]).select(F.col("p_partkey").alias("part"), "n")


@query("jn15_hits_to_claims", f"WITH {GRAPH_SQL} SELECT c.id, count(*) AS n FROM claims c JOIN evidence e ON e.claim_id = c.id AND e.stance = 'supports' WHERE c.predicate = 'HAS_EFFECT' AND c.effect <> 'unknown' GROUP BY c.id")
def hits_to_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    wanted = g.claims.where("predicate = 'HAS_EFFECT' AND effect <> 'unknown'").select("id")
    return g.evidence.where("stance = 'supports'").groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("n")).join(wanted, "id", "left_semi")


@query("jn17_cell_coordinates", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(o_orderkey) > 0 AS known FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1 OR count(o_orderkey) = 0")
def cell_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    cells = view(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return cells.join(known, "l_orderkey", "left").withColumn("known", F.coalesce("known", F.lit(False))).where("n > 1 OR NOT known")


@query("jn20_overlaid_evidence", f"""
WITH {GRAPH_SQL}, t AS (SELECT id FROM claims WHERE predicate = 'HAS_EFFECT' AND id LIKE 'HE:1%')
SELECT stance, review_status, count(*) AS n FROM (
  SELECT stance, review_status FROM evidence WHERE claim_id NOT IN (SELECT id FROM t) UNION ALL SELECT 'supports', 'human_reviewed' FROM t) GROUP BY ALL""")  # fmt: skip
def overlaid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    reviewed = g.claims.where("id LIKE 'HE:1%' OR id LIKE 'HV:1%'").select(F.col("id").alias("claim_id"), F.lit("review").alias("source_id"), F.lit("supports").alias("stance"), F.lit("human_reviewed").alias("review_status"))
    return select.overlaid(g.claims, g.evidence, reviewed, "HAS_EFFECT").groupBy("stance", "review_status").agg(F.count("*").alias("n"))


@query("jn21_known_ids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return view(spark, sf_dir, "orders").join(found, "o_custkey", "left_semi").select("o_orderkey")


@query("sk10_read_back", """
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 50 = 0 OR doc_id % 7 = 0
UNION ALL SELECT -doc_id, 'added' FROM documents WHERE doc_id % 100 = 1""")  # fmt: skip
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    stored = docs.where("doc_id % 50 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("lang")))
    extra = docs.where("doc_id % 100 = 1").withColumn("doc_id", -F.col("doc_id"))
    return select.differences(docs, stored.unionByName(extra), "doc_id")


@query("sk08_short_excerpts", "SELECT doc_id, left(text, 300) AS excerpt, length(text) <= 300 AS whole FROM documents WHERE length(text) <= 300 OR source = 'src1'")
def short_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").where((F.length("text") <= 300) | (F.col("source") == "src1"))
    return rows.select("doc_id", F.left("text", F.lit(300)).alias("excerpt"), (F.length("text") <= 300).alias("whole"))


@query("gr21_ancestors", """
WITH RECURSIVE p AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1),
a AS (SELECT child, parent AS ancestor, 1 AS distance FROM p UNION ALL SELECT a.child, p.parent, distance + 1 FROM a JOIN p ON p.child = a.ancestor)
SELECT child, ancestor, distance FROM a""")  # fmt: skip
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return select.ancestors(rows)


@query("gr24_reconciled", """
WITH a AS (SELECT user_id FROM events WHERE event_id % 3 <> 0), b AS (SELECT user_id FROM events WHERE event_id % 5 = 0)
SELECT (SELECT count(DISTINCT user_id) FROM a) AS n_before, (SELECT count(DISTINCT user_id) FROM b) AS n_after,
(SELECT count(*) FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM a)) AS n_added, (SELECT count(*) FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)) AS n_absent,
NOT EXISTS (SELECT user_id FROM a EXCEPT SELECT user_id FROM b) AS complete""")  # fmt: skip
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events")
    return select.reconciled(rows.where("event_id % 3 <> 0"), rows.where("event_id % 5 = 0"), "user_id")


@query("mi06_long_format", "SELECT l_orderkey, l_linenumber, measure, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_tax']) AS measure, unnest([l_quantity, l_tax]) AS value FROM lineitem) GROUP BY ALL")
def long_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.long_format(view(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])
    return rows.groupBy("l_orderkey", "l_linenumber", "measure").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("mi07_exactly_one", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exactly_one(view(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == 17, "part 17")


@query("mi08_membership", "SELECT o_orderkey, EXISTS (FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linenumber = 3) AS has_third FROM orders")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = view(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    return view(spark, sf_dir, "orders").join(third, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("has_third"))


@query("sf07_residues", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'W' ELSE 'Xaa' END AS code FROM customer")
def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("Ala", "Gly", "Trp", "Xaa")]), (F.col("c_custkey") % 4).cast("int") + 1)
    return view(spark, sf_dir, "customer").select("c_custkey", fn.residue_code(name).alias("code"))


@query("sf10_quoted_or", """SELECT n_nationkey, concat('"', n_name, '" OR "', replace(concat('a"', r_name), '"', ''), '"') AS query FROM nation JOIN region ON r_regionkey = n_regionkey""")
def quoted_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", fn.quoted_or(F.array("n_name", F.concat(F.lit('a"'), "r_name"))).alias("query"))


@query("sf11_between_markers", "SELECT page_id, CASE WHEN contains(html, '<title>') AND contains(substring(html, strpos(html, '<title>') + 7), '</title>') THEN string_split(substring(html, strpos(html, '<title>') + 7), '</title>')[1] END AS title FROM pages")
def between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", fn.between_markers("html", "<title>", "</title>").alias("title"))


@query("sf16_plural_labels", "SELECT user_id, CASE WHEN count(*) = 1 THEN 'record' ELSE 'records' END AS label FROM events GROUP BY user_id")
def plural_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.count("*") == 1, "record").otherwise("records").alias("label"))


@query("sf17_first_label", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END, ''), nullif(p_brand, ''), 'part') AS label FROM part")
def first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select("p_partkey", fn.first_label(F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_name")), "p_brand", F.lit("part")).alias("label"))


@query("sf20_safe_urls", """SELECT page_id, page_id % 3 <> 0 AS safe FROM pages""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://user:pw@")).otherwise(F.col("url"))
    return view(spark, sf_dir, "pages").select("page_id", fn.without_credentials(url).alias("safe"))


@query("sf24_identifiers", "SELECT c_custkey, concat('PMC', c_custkey) AS pmc, concat('10.1/x', c_custkey) AS doi FROM customer")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    pmc = F.when(F.col("c_custkey") % 2 == 0, key).otherwise(F.concat(F.lit(" pmc"), key))
    return view(spark, sf_dir, "customer").select("c_custkey", fn.pmcid(pmc).alias("pmc"), fn.doi(F.concat(F.lit("https://doi.org/10.1/X"), key)).alias("doi"))


@query("sf30_descriptive_ratio", """
SELECT l_orderkey, l_linenumber, round(sum(CASE WHEN l_tax > 0 AND l_discount >= 0 THEN CASE WHEN l_returnflag = 'R' THEN l_tax / nullif(l_discount, 0) ELSE l_discount / l_tax END END), 6) AS ratio FROM lineitem GROUP BY ALL""")  # fmt: skip
def descriptive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fn.descriptive_ratio(F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag") == "R")
    return view(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(value), 6).alias("ratio"))


@query("sf32_same_number", """
SELECT l_orderkey, l_linenumber, count(*) FILTER (CAST(l_quantity AS DECIMAL(18,2)) = CAST(p_size AS DECIMAL(18,2))) AS n_same, count(*) FILTER (l_tax = l_discount) AS n_rates
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")  # fmt: skip
def same_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities (12.0) against sizes (12), and rates as they are written."""
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    same = lambda a, b: F.count_if(fn.same_number(F.col(a).cast("string"), F.col(b).cast("string")))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(same("l_quantity", "p_size").alias("n_same"), same("l_tax", "l_discount").alias("n_rates"))


@query("va03_node_rules", f"WITH {GRAPH_SQL} SELECT 'label' AS rule, count(*) AS n FROM nodes WHERE trim(CASE WHEN id LIKE '%7' THEN ' ' ELSE label END) = '' HAVING count(*) > 0")
def node_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    broken = g.nodes.withColumn("label", F.when(F.col("id").endswith("7"), " ").otherwise(F.col("label")))
    return validate.node_violations(type(g)(broken, g.sources, g.claims, g.evidence)).groupBy("rule").agg(F.count("*").alias("n"))


@query("va15_measurement_rules", """
WITH m AS (SELECT CASE l_returnflag WHEN 'R' THEN 'eq' WHEN 'A' THEN 'range' ELSE 'odd' END AS relation, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE '1.5' END AS estimate, l_tax AS lo, CASE WHEN l_discount > 0.02 THEN l_discount END AS hi FROM lineitem)
SELECT rule, count(*) AS n FROM (SELECT 'relation' AS rule FROM m WHERE relation = 'odd' UNION ALL SELECT 'estimate' FROM m WHERE relation = 'eq' AND estimate = 'x'
UNION ALL SELECT 'interval' FROM m WHERE hi IS NULL UNION ALL SELECT 'interval_order' FROM m WHERE lo > hi UNION ALL SELECT 'range' FROM m WHERE relation = 'range' AND hi IS NULL) GROUP BY rule""")  # fmt: skip
def measurement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    relation = F.when(F.col("l_returnflag") == "R", "eq").when(F.col("l_returnflag") == "A", "range").otherwise("odd")
    rows = view(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), relation.alias("relation"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("1.5").alias("estimate"),
        F.col("l_tax").cast("string").alias("ci_lower"), F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("string")).alias("ci_upper"), none.alias("uncertainty_type"), F.lit(None).cast("int").alias("n"),
    )
    return validate.measurement_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("va18_submission_rules", r"""SELECT conv_id, turn, length(trim(text)) BETWEEN 20 AND 200 AND NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F]') AND role IN ('user', 'assistant') AS accepted FROM conversations""")
def submission_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.length(F.trim("text")).between(20, 200) & ~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]") & F.col("role").isin("user", "assistant")
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", good.alias("accepted"))


@query("sf44_leaves", """
SELECT shape, kind, count(*) AS n, min(v) AS least FROM (
  SELECT '$.key' AS shape, 'bigint' AS kind, CAST(o_orderkey AS VARCHAR) AS v FROM orders
  UNION ALL SELECT '$.lines[*].part', 'bigint', CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT '$.lines[*].at.span.unit_id', 'string', concat('u', l_suppkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT '$.lines[*].at.span.start', 'bigint', CAST(l_linenumber AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT '$.lines[*].at.span.end', 'bigint', '4' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT '$.lines[*].at.span.quote', 'string', l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey
) GROUP BY ALL""")  # fmt: skip
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scalars in the nested text of every order are, by place."""
    return nested.leaf_shapes(nested_orders(spark, sf_dir), "text")


@query("sf43_span_counts", """
SELECT o_orderkey AS id, count(l_orderkey) AS n, count(*) FILTER (l_linenumber < 4) AS n_shaped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")  # fmt: skip
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans at any depth in the nested text of every order, and those that are as spans should be."""
    found = nested.spans(nested_orders(spark, sf_dir), "o_orderkey", "text")
    return found.groupBy("id").agg(F.count("*").alias("n"), F.count_if("shaped").alias("n_shaped"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a JSON text with its lines, each with a span two levels down that ends at 4."""
    span = F.struct(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("unit_id"), F.col("l_linenumber").alias("start"), F.lit(4).alias("end"), F.col("l_returnflag").alias("quote"))
    line = F.struct(F.col("l_partkey").alias("part"), F.struct(span.alias("span")).alias("at"))
    lines = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    orders = view(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), "lines")).alias("text"))


@query("va19_rebuilt", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 1009 <> 0
      UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 1013 = 0)
SELECT 'lines' AS name, (SELECT count(*) FROM a) AS n_committed, (SELECT count(*) FROM b) AS n_rebuilt,
  (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS n_removed, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS n_added, false AS equal
UNION ALL SELECT 'parts', count(*), count(*), 0, 0, true FROM part""")  # fmt: skip
def rebuilt_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some were changed, left out or repeated, and parts in another order."""
    a = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    key = F.col("l_orderkey")
    changed = a.where(key % 1009 != 0).withColumn("l_quantity", F.when(key % 997 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    parts = view(spark, sf_dir, "part")
    return rebuilt.compared({"lines": a, "parts": parts}, {"lines": changed.unionByName(a.where(key % 1013 == 0)), "parts": parts.orderBy(F.desc("p_partkey"))})


@query("sf07_short_residues", """
SELECT p_partkey, concat(['A', 'G', 'W', 'Xaa'][1 + p_partkey % 4], 10 + p_size, 'K in ', ['R', 'Abc'][1 + p_partkey % 2]) AS text FROM part""")  # fmt: skip
def short_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-letter codes inside the text of every part."""
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("p_partkey") % len(x)).cast("int") + 1)
    text = F.concat(F.lit("p."), pick("Ala", "Gly", "Trp", "Xaa"), (F.col("p_size") + 10).cast("string"), F.lit("Lys in "), pick("Arg", "Abc"))
    return view(spark, sf_dir, "part").select("p_partkey", fn.short_residues(text).alias("text"))


@query("sf10_condition_query", """
SELECT n_nationkey, concat('"', n_name, ' x" OR "', r_name, '"') AS query FROM nation JOIN region ON r_regionkey = n_regionkey""")  # fmt: skip
def condition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", fn.condition_query(F.array(F.concat("n_name", F.lit(" (x)")), F.concat(F.lit('["'), "r_name", F.lit('"]')), F.lit("{}"))).alias("query"))


@query("sf11_section_tokens", """
SELECT page_id, array_to_string(regexp_extract_all(string_split(regexp_replace(html, '(?s)^.*?<nav>', ''), '</nav>')[1], 'href="[^"]*"'), ' ') AS links FROM pages""")  # fmt: skip
def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in the first navigation of every page, which each must have."""
    return view(spark, sf_dir, "pages").select("page_id", F.array_join(fn.section_tokens("html", 'href="[^"]*"', "<nav>", "</nav>", "</body>"), " ").alias("links"))
