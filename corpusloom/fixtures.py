"""Corpus tables as views over the test tables, in SQL that Spark and DuckDB both run.

``VIEWS`` is in order of dependence: a view may use those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "papers": """SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS venue, o_totalprice AS price, o_custkey AS author_id,
        CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'maybe' ELSE 'exclude' END AS triage_label FROM orders""",
    "authors": "SELECT o_orderkey AS paper_id, 1 AS position, c_name AS author FROM orders JOIN customer ON o_custkey = c_custkey",
    "categories": "SELECT DISTINCT l_orderkey AS paper_id, p_name AS category FROM lineitem JOIN part ON l_partkey = p_partkey",
    "grid": "SELECT p_partkey AS paper_id, p_name AS category, p_brand AS brand, p_brand || ' ' || p_type AS method, p_size AS domain, CASE WHEN p_size = 50 THEN 'unknown' ELSE 'size ' || p_size END AS sample FROM part",
    "fields": """SELECT o_orderkey AS paper_id, 'method_family' AS field_name, o_orderpriority AS field_value FROM orders
        UNION ALL SELECT o_orderkey, 'system_domain', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT o_orderkey, 'sample_type', CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE o_orderstatus END FROM orders
        UNION ALL SELECT o_orderkey, 'challenges_existing', CASE WHEN o_totalprice > 300000 THEN 'confirmed' WHEN o_totalprice < 100000 THEN 'refuted' ELSE 'unknown' END FROM orders
        UNION ALL SELECT o_orderkey, 'total_price', CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR(20)) FROM orders""",
    "usage": "SELECT l_orderkey AS paper_id, p_name AS canonical, p_type AS kind FROM lineitem JOIN part ON l_partkey = p_partkey",
    "results": "SELECT l_orderkey AS paper_id, l_returnflag AS metric, p_brand AS dataset, l_linestatus AS split, l_quantity / 50 AS value FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cites": "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem",
    "graph": "SELECT l_suppkey AS src, l_partkey % (SELECT 2 * count(*) FROM supplier) AS dst FROM lineitem",
    "claims": """SELECT vec_id AS claim_id, vec_id % 50 AS paper_id, label AS cluster_id,
        CASE vec_id % (2 + label % 4) WHEN 0 THEN 'theorises' WHEN 1 THEN 'extends' WHEN 2 THEN 'validates' WHEN 3 THEN 'challenges' ELSE 'asserts' END AS stance,
        CASE vec_id % 6 WHEN 0 THEN 'finding' WHEN 1 THEN 'limitation' WHEN 2 THEN 'framework' WHEN 3 THEN 'method' WHEN 4 THEN 'future' ELSE 'finding' END AS claim_type,
        CASE (vec_id % 50) % 5 WHEN 0 THEN 'survey' WHEN 1 THEN 'experimental' WHEN 2 THEN 'theoretical' WHEN 3 THEN 'case_study' ELSE 'other' END AS method_family,
        vec_id % 50 % 6 AS topic, embedding FROM embeddings""",
    "clustered": """SELECT p_partkey AS paper_id, CAST(p_size AS BIGINT) AS paper_cluster_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) % 97 END AS method_cluster_id FROM part""",
    "texts": """SELECT d.doc_id AS paper_id, substr(d.text, 1, 80) AS title, d.text AS abstract, d.source AS venue, 2015 + d.doc_id % 10 AS year, d.lang,
        CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'include' WHEN l.quality = 1 THEN 'maybe' WHEN l.quality = 0 THEN 'exclude' ELSE '' END AS triage_label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "scores": "SELECT l_orderkey AS paper_id, l_returnflag AS field, p_type AS label, max(l_quantity / 50) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_returnflag, p_type",
    "reports": """SELECT l_orderkey AS paper_id, l_linenumber * 100000000 + l_partkey AS sentence_idx, p_name AS name, l_returnflag, l_linestatus, l_quantity, l_partkey,
        'On the ' || p_name || ' ' || CASE l_returnflag WHEN 'A' THEN 'test' WHEN 'N' THEN 'validation' ELSE 'training' END || ' set the ' || CASE l_linestatus WHEN 'F' THEN 'F1 score' ELSE 'accuracy' END || ' reaches '
        || CAST(CAST(l_quantity AS INT) AS VARCHAR(4)) || '.5 % for n = ' || CAST(l_partkey AS VARCHAR(12)) || ' cases.' AS sentence FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "vectors": "SELECT e.vec_id AS id, e.embedding, e.label, l.quality FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id",
}


_registered: list = []


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view over the tables below sf_dir; temporary views are made once for each session and folder."""
    if _registered != [spark, sf_dir] or not spark.catalog.tableExists("texts"):
        for table in TABLES:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        for v, sql in VIEWS.items():
            spark.sql(sql).createOrReplaceTempView(v)
        _registered[:] = [spark, sf_dir]
    return spark.table(name)


def with_views(*names: str) -> str:
    """A WITH clause of the views, and of those they use."""
    need, order = set(names), list(VIEWS)
    for v in reversed(order):
        if v in need:
            need |= {u for u in order[: order.index(v)] if f" {u}" in VIEWS[v].replace("(", " ")}
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order if v in need)
