"""Merging, upserts and decisions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import merge


@register(
    "merge_by_key",
    """WITH r AS (SELECT o_custkey AS doi, o_orderkey AS ord, o_orderpriority AS venue, o_orderstatus AS source FROM orders)
SELECT doi, arg_max(venue, length(venue) * 1000000000 - ord) AS venue, array_to_string(list_sort(list(DISTINCT source)), '+') AS source, count(*) AS n_merged FROM r GROUP BY 1""",
)
def merge_by_key(spark, sf_dir):
    rows = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doi"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("source"))
    return merge.merge_by_key(rows, "doi", "at", ["venue"], "source")


@register("merge_new_rows", with_views("papers", "cites") + "SELECT DISTINCT dst AS paper_id FROM cites WHERE dst NOT IN (SELECT paper_id FROM papers WHERE triage_label = 'include')")
def merge_new_rows(spark, sf_dir):
    candidates = view(spark, sf_dir, "cites").select(F.col("dst").alias("paper_id")).distinct()
    return merge.new_rows(candidates, view(spark, sf_dir, "papers").where("triage_label = 'include'"), ["paper_id"])


@register(
    "merge_upsert",
    "SELECT conv_id, turn, role, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def merge_upsert(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations")
    latest = merge.upsert(rows.where("role = 'user'"), rows.where("role <> 'user'"), ["conv_id"], "turn")
    return latest.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@register(
    "merge_decisions",
    with_views("texts") + """, d AS (SELECT vec_id AS paper_id, CASE label WHEN 0 THEN 'perhaps' ELSE 'include' END AS label FROM embeddings)
SELECT d.paper_id, d.label, CASE WHEN t.paper_id IS NULL THEN 'unknown row' WHEN d.label = 'perhaps' THEN 'invalid label' WHEN triage_label <> '' THEN 'skipped' ELSE 'applied' END AS status FROM d LEFT JOIN texts t USING (paper_id)""",
)
def merge_decisions(spark, sf_dir):
    label = F.when(F.col("label") == 0, "perhaps").otherwise("include")
    decisions = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), label.alias("label"))
    return merge.apply_decisions(view(spark, sf_dir, "texts"), decisions)
