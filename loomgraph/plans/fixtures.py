"""Adapters from the driver tables to the engine's input shapes, as SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "mail_raw": """
SELECT role || '/sent/' || cast(conv_id AS STRING) || '.' || cast(turn AS STRING) AS file,
       'Message-ID: <' || cast(conv_id AS STRING) || '.' || cast(turn AS STRING) || '@example.com>' || chr(10)
    || 'Date: Mon, ' || cast(conv_id % 28 + 1 AS STRING) || ' May 2001 16:' || lpad(cast(turn AS STRING), 2, '0') || ':00 -0700 (PDT)' || chr(10)
    || 'From: ' || upper(role) || '@Example.com' || chr(10)
    || 'To: a' || cast(conv_id % 5 AS STRING) || '@example.com, B@example.com' || chr(10)
    || CASE WHEN conv_id % 3 = 0 THEN 'Cc: C@Example.com, staff, d' || cast(turn % 4 AS STRING) || '@example.com' || chr(10) ELSE '' END
    || 'Subject: ' || CASE WHEN turn % 3 = 1 THEN 'RE: ' WHEN turn % 3 = 2 THEN 'FW: ' ELSE '' END || 'conv ' || cast(conv_id AS STRING) || chr(10)
    || 'X-From: ' || role || chr(10) || 'X-Origin: ' || upper(role) || '-' || cast(conv_id % 4 AS STRING) || chr(10) || chr(10) || text AS message
FROM conversations""",
    "kg_nodes": """
SELECT 'region:' || cast(r_regionkey AS STRING) AS id, r_name AS canonical_name, 'topic' AS entity_type, cast(5 AS BIGINT) AS mention_count FROM region
UNION ALL SELECT 'nation:' || cast(n_nationkey AS STRING), n_name, 'organization', cast(n_nationkey % 9 + 1 AS BIGINT) FROM nation
UNION ALL SELECT 'supplier:' || cast(s_suppkey AS STRING), s_name, 'organization', cast(s_suppkey % 17 + 1 AS BIGINT) FROM supplier
UNION ALL SELECT 'customer:' || cast(c_custkey AS STRING), c_name, 'person', cast(c_custkey % 23 + 1 AS BIGINT) FROM customer
UNION ALL SELECT 'part:' || cast(p_partkey AS STRING), p_name || ' ' || cast(p_partkey AS STRING), 'project', cast(1 AS BIGINT) FROM part""",
    "kg_aliases": """
SELECT 'nation:' || cast(n_nationkey AS STRING) AS id, lower(replace(n_name, '_', ' ')) AS alias FROM nation
UNION ALL SELECT 'customer:' || cast(c_custkey AS STRING), lower(replace(c_name, '#', '.')) || '@corp.com' FROM customer""",
    "kg_edges": """
SELECT 'nation:' || cast(n_nationkey AS STRING) AS src, 'region:' || cast(n_regionkey AS STRING) AS dst, 'PART_OF' AS rel_type, cast(1.0 AS DOUBLE) AS confidence, cast(1 AS BIGINT) AS mention_count FROM nation
UNION ALL SELECT 'supplier:' || cast(s_suppkey AS STRING), 'nation:' || cast(s_nationkey AS STRING), 'PART_OF', cast(0.9 AS DOUBLE), cast(1 AS BIGINT) FROM supplier
UNION ALL SELECT 'customer:' || cast(c_custkey AS STRING), 'nation:' || cast(c_nationkey AS STRING), 'WORKS_AT', cast(0.8 AS DOUBLE), cast(1 AS BIGINT) FROM customer
UNION ALL SELECT 'nation:' || cast(n_nationkey AS STRING), 'nation:' || cast(n_nationkey AS STRING), 'DECIDED', cast(0.6 AS DOUBLE), cast(1 AS BIGINT) FROM nation WHERE n_nationkey % 7 = 0
UNION ALL SELECT 'customer:' || cast(o_custkey AS STRING), 'supplier:' || cast(l_suppkey AS STRING), 'COMMUNICATED_WITH', cast(5 + count(*) % 6 AS DOUBLE) / 10, cast(count(*) AS BIGINT)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    "comm": """
SELECT lower(sn.n_name) || '@enron.com' AS sender, lower(cn.n_name) || '@enron.com' AS recipient, lower(sn.n_name) AS mailbox
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey""",
}
#: Capitalised words per document with their place, in the dialect of each engine.
TOK_SPARK = "SELECT doc_id, cast(p AS BIGINT) AS idx, name FROM documents LATERAL VIEW posexplode(regexp_extract_all(text, '[A-Z][a-z]{3,}', 0)) t AS p, name"
TOK_DUCKDB = "SELECT doc_id, cast(i - 1 AS BIGINT) AS idx, a[i] AS name FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{3,}', 0) AS a FROM documents) t, generate_series(1, len(a)) g(i)"
MENTIONS = """
SELECT t.doc_id AS artifact_id, t.idx, t.name,
       CASE (length(t.name) + t.doc_id) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'person' ELSE 'topic' END AS entity_type,
       CASE WHEN t.doc_id % 7 = 0 THEN n.name END AS alias
FROM tok t LEFT JOIN tok n ON n.doc_id = t.doc_id AND n.idx = t.idx + 1"""
RAW_CLAIMS = """
SELECT t.doc_id AS artifact_id, t.idx,
       CASE t.idx % 4 WHEN 0 THEN 'mentioned_in' WHEN 1 THEN 'communicated_with' WHEN 2 THEN 'works_on' ELSE 'decided' END AS claim_type,
       t.name AS subject,
       CASE WHEN t.idx % 11 = 5 THEN '' WHEN t.idx % 13 = 6 THEN 'zz unresolved' ELSE coalesce(n.name, '') END AS object,
       t.name || ' ' || coalesce(n.name, '') AS excerpt,
       cast(5 + (t.doc_id + t.idx) % 6 AS DOUBLE) / 10 AS confidence
FROM tok t LEFT JOIN tok n ON n.doc_id = t.doc_id AND n.idx = t.idx + 1"""
#: ord of a mention or claim: artifact, then place. A text with more mentions is refused, not mixed with the next.
PER_DOC = 10_000_000
ORD = f"artifact_id * {PER_DOC} + CASE WHEN idx < {PER_DOC} THEN idx ELSE raise_error('a text has too many mentions') END"
TABLES = {"mail_raw": ["conversations"], "kg_nodes": ["region", "nation", "supplier", "customer", "part"], "kg_aliases": ["nation", "customer"], "kg_edges": ["nation", "supplier", "customer", "lineitem", "orders"], "comm": ["lineitem", "orders", "supplier", "nation", "customer"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES[name]:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(TOK_SPARK)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok(spark, sf_dir).createOrReplaceTempView("tok")
    return spark.sql(f"SELECT {ORD} AS ord, artifact_id, name, entity_type, CASE WHEN alias IS NULL THEN array() ELSE array(alias) END AS aliases FROM ({MENTIONS})")


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok(spark, sf_dir).createOrReplaceTempView("tok")
    return spark.sql(f"SELECT {ORD} AS ord, artifact_id, cast(NULL AS STRING) AS date, claim_type, subject, object, cast(idx AS STRING) AS detail, excerpt, confidence FROM ({RAW_CLAIMS})")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import functions as F

    nodes, aliases = fixture(spark, sf_dir, "kg_nodes"), fixture(spark, sf_dir, "kg_aliases")
    held = aliases.groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return nodes.join(held, "id", "left"), fixture(spark, sf_dir, "kg_edges")
