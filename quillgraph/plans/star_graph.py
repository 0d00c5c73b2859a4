"""An evidence graph derived from the star schema, with the same definitions in DuckDB SQL.

Customers are diseases, orders variants, parts mechanisms, market segments by region phenotypes, brands assets,
nations organisations and suppliers both sources and people. Every lineitem row is a piece of evidence.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import dealt, parts_of
from ..schema import EvidenceGraph

#: Claims and evidence in SQL that Spark and DuckDB both run.
CLAIMS = """
SELECT concat('HV:', o_orderkey) AS id, concat('D:', o_custkey) AS subject, 'HAS_VARIANT' AS predicate, concat('V:', o_orderkey) AS object,
       'reported' AS assertion_type, CAST(NULL AS VARCHAR(9)) AS effect, false AS negated,
       CAST(NULL AS VARCHAR(9)) AS species, CAST(NULL AS VARCHAR(9)) AS tissue, CAST(NULL AS VARCHAR(99)) AS stage
FROM orders
UNION ALL
SELECT concat('HE:', l_orderkey, ':', l_linenumber), concat('V:', l_orderkey), 'HAS_EFFECT', concat('M:', min(l_partkey)),
       CASE WHEN CAST(min(l_quantity) AS BIGINT) % 7 = 0 THEN 'inferred' ELSE 'reported' END,
       CASE min(l_returnflag) WHEN 'R' THEN 'loss_of_function' WHEN 'A' THEN 'gain_of_function' ELSE 'unknown' END,
       max(l_tax) = 0, min(o_orderstatus), min(l_linestatus), min(o_orderpriority)
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber
UNION ALL
SELECT concat('HP:', c_custkey), concat('D:', c_custkey), 'HAS_PHENOTYPE', concat('P:', c_mktsegment, ':', n_regionkey),
       'reported', NULL, c_custkey % 11 = 0, NULL, NULL, NULL
FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL
SELECT concat('RE:', c_custkey), concat('O:', c_nationkey), 'REPRESENTS', concat('D:', c_custkey), 'reported', NULL, c_custkey % 13 = 0, NULL, NULL, NULL
FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT concat('RT:', p_brand, ':', c_custkey), concat('A:', p_brand), 'RELEVANT_TO', concat('D:', c_custkey), 'reported', NULL, false, NULL, NULL, NULL
FROM (SELECT DISTINCT p_brand FROM part) JOIN customer ON c_custkey % 60 = length(p_brand) + CAST(right(p_brand, 1) AS INT)
UNION ALL
SELECT concat('CI:', p_brand, ':', c_custkey), concat('A:', p_brand), 'CONTRAINDICATED_FOR', concat('D:', c_custkey), 'reported', NULL, c_custkey % 2 = 0, NULL, NULL, NULL
FROM (SELECT DISTINCT p_brand FROM part) JOIN customer ON c_custkey % 60 = length(p_brand) + CAST(right(p_brand, 1) AS INT) WHERE c_custkey % 4 <> 1
UNION ALL
SELECT concat('MT:', n_nationkey, ':', p_brand), concat('O:', n_nationkey), 'MAINTAINS', concat('A:', p_brand), 'reported', NULL, n_nationkey % 4 = 3, NULL, NULL, NULL
FROM (SELECT DISTINCT p_brand FROM part) JOIN nation ON n_nationkey % 7 = CAST(right(p_brand, 1) AS INT)
UNION ALL
SELECT concat('ST:', s_suppkey, ':', p_partkey), concat('R:', s_suppkey), 'STUDIES', concat('M:', p_partkey), 'reported', NULL, false, NULL, NULL, NULL
FROM part JOIN supplier ON s_suppkey = 1 + p_partkey % 100
"""
EVIDENCE = """
SELECT concat('HE:', l_orderkey, ':', l_linenumber) AS claim_id, concat('S:', l_suppkey) AS source_id,
       CASE WHEN l_discount >= 0.09 THEN 'contradicts' ELSE 'supports' END AS stance,
       CASE l_partkey % 3 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'machine_checked' ELSE 'human_reviewed' END AS review_status
FROM lineitem
UNION ALL
SELECT id, concat('S:', length(subject) + length(object)), 'supports',
       CASE WHEN length(object) % 9 = 0 THEN 'unreviewed' ELSE 'human_reviewed' END
FROM claims WHERE predicate <> 'HAS_EFFECT'
"""
SOURCES = "SELECT concat('S:', s_suppkey) AS id, s_name AS title FROM supplier WHERE s_acctbal >= 0"
NODES = """
SELECT concat('D:', c_custkey) AS id, 'Disease' AS type, c_name AS label FROM customer
UNION ALL SELECT concat('V:', o_orderkey), 'Variant', concat('order ', o_orderkey) FROM orders
UNION ALL SELECT concat('M:', p_partkey), 'Mechanism', p_name FROM part
UNION ALL SELECT DISTINCT concat('P:', c_mktsegment, ':', n_regionkey), 'Phenotype', c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT concat('O:', n_nationkey), 'Organization', n_name FROM nation
UNION ALL SELECT DISTINCT concat('A:', p_brand), 'Asset', p_brand FROM part
UNION ALL SELECT concat('R:', s_suppkey), 'Person', s_name FROM supplier
"""
#: What was searched for each customer; those divisible by 500 but not by 3 have no record.
COVERAGE = """
SELECT concat('D:', c_custkey) AS entity_id, concat('S:', 1 + c_custkey % 100) AS source_id, c_mktsegment AS scope,
       CASE c_custkey % 4 WHEN 0 THEN 'searched' WHEN 1 THEN 'not_searched' WHEN 2 THEN 'failed' ELSE 'searched' END AS status
FROM customer WHERE c_custkey % 500 <> 0
UNION ALL
SELECT concat('D:', c_custkey), concat('S:', 1 + c_custkey % 97), 'variants', 'not_searched' FROM customer WHERE c_custkey % 3 = 0
"""
TABLES = ("customer", "lineitem", "nation", "orders", "part", "supplier")

#: The graph as common table expressions, for DuckDB; state follows the order of the claim states.
GRAPH_SQL = f"""
claims AS MATERIALIZED ({CLAIMS}),
evidence AS MATERIALIZED ({EVIDENCE}),
sources AS MATERIALIZED ({SOURCES}),
nodes AS MATERIALIZED ({NODES}),
flags AS MATERIALIZED (
  SELECT claim_id, bool_or(stance = 'contradicts') AS against, bool_or(stance = 'supports') AS backed,
         bool_or(stance = 'supports' AND review_status <> 'unreviewed') AS reviewed
  FROM evidence WHERE source_id IN (SELECT id FROM sources) GROUP BY claim_id
),
states AS MATERIALIZED (
  SELECT c.*, CASE WHEN negated THEN 'negated' WHEN against THEN 'contradicted'
    WHEN assertion_type <> 'reported' THEN CASE WHEN backed THEN 'inferred_only' ELSE 'unsupported' END
    WHEN reviewed THEN 'supported' WHEN backed THEN 'review_required' ELSE 'unsupported' END AS state
  FROM claims c LEFT JOIN flags ON claim_id = id
)
"""
PATHS_SQL = (
    GRAPH_SQL
    + """,
paths AS MATERIALIZED (
  SELECT v.subject AS disease, e.object AS mechanism, v.id AS first_id, e.id AS second_id, e.effect,
         v.state AS s1, e.state AS s2, e.assertion_type, e.species, e.tissue, e.stage
  FROM states v JOIN states e ON v.predicate = 'HAS_VARIANT' AND e.predicate = 'HAS_EFFECT' AND v.object = e.subject
)"""
)


#: The diseases that the queries of a single source start from: a stated set, the ids divisible by 100.
ASKED_SQL = "(SELECT concat('D:', c_custkey) FROM customer WHERE c_custkey % 100 = 0)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("D:"), "c_custkey").alias("disease"))


def view(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> EvidenceGraph:
    """The graph of the star schema; a lazy plan, nothing but the number of lines is read before it is used."""
    tables = {t: view(spark, sf_dir, t) for t in TABLES}
    parts = parts_of(tables["lineitem"])
    claims = spark.sql(_named(CLAIMS, tables), **tables | {"lineitem": dealt(tables["lineitem"], parts, "l_orderkey")})
    tables["claims"] = claims
    return EvidenceGraph(spark.sql(_named(NODES, tables), **tables), spark.sql(_named(SOURCES, tables), **tables), claims, spark.sql(_named(EVIDENCE, tables), **tables), parts=parts)


def star_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_named(COVERAGE, t := {"customer": view(spark, sf_dir, "customer")}), **t)


def _named(sql: str, tables: dict[str, DataFrame]) -> str:
    """SQL whose table names are replaced by references to DataFrames, which need no temporary views."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql)
