"""Decision rules over score tables that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import decisions as D

_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, label) AS nth, lead(score) OVER (PARTITION BY {by} ORDER BY score DESC, label) AS second FROM scores)"
_MARGIN = "round(score - coalesce(second, 0), 9)"


@register(
    "dec_zero_shot_fields",
    with_views("scores") + ", " + _RANKED.format(by="paper_id, field") + f""" SELECT paper_id, field, CASE WHEN score >= t AND {_MARGIN} >= m THEN lower(label) ELSE 'unknown' END AS value, score, {_MARGIN} AS margin
FROM r JOIN (VALUES ('A', 0.5, 0.1), ('N', 0.8, 0.02), ('R', 0.2, 0.3)) q(field, t, m) USING (field) WHERE nth = 1""",
)
def dec_zero_shot_fields(spark, sf_dir):
    found = D.zero_shot_fields(view(spark, sf_dir, "scores"), {"A": (0.5, 0.1), "N": (0.8, 0.02), "R": (0.2, 0.3)})
    return found.withColumn("value", F.lower("value"))


@register("dec_categories", with_views("scores") + ", " + _RANKED.format(by="paper_id") + " SELECT paper_id, nth, label AS category, score FROM r WHERE nth = 1 OR (nth <= 3 AND score >= 0.5)")
def dec_categories(spark, sf_dir):
    return D.categories(view(spark, sf_dir, "scores"))


@register("dec_method_families", with_views("scores") + ", " + _RANKED.format(by="paper_id") + f" SELECT paper_id, CASE WHEN score >= 0.55 AND {_MARGIN} >= 0.05 THEN label ELSE 'other' END AS method_family, score, {_MARGIN} AS margin FROM r WHERE nth = 1")
def dec_method_families(spark, sf_dir):
    return D.method_families(view(spark, sf_dir, "scores"))


@register(
    "dec_topic_relevance",
    "SELECT o_orderkey AS paper_id, CASE WHEN o_totalprice / 500000 >= 0.55 THEN 'core' WHEN o_totalprice / 500000 >= 0.40 THEN 'important' ELSE 'peripheral' END AS relevance, o_totalprice / 500000 AS score FROM orders WHERE o_orderstatus <> 'P'",
)
def dec_topic_relevance(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_totalprice") / 500000).alias("score"), "o_orderstatus")
    return D.topic_relevance(orders.select("paper_id", "score"), orders.where("o_orderstatus = 'P'"))


_SIGNAL = """SELECT l_orderkey AS paper_id, l_returnflag AS signal, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS sentence_idx, l_quantity / 50 AS cosine, l_discount * 10 AS entail_pos, l_tax * 10 AS contradict_neg,
    (l_partkey % 10) / 10 AS entail_neg, (l_suppkey % 10) / 10 AS contradict_pos FROM lineitem"""


@register(
    "dec_bool_signals",
    f"""WITH s AS ({_SIGNAL}), n AS (SELECT *, round(entail_pos + contradict_neg - entail_neg - contradict_pos, 9) AS support FROM s WHERE cosine >= 0.72),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY paper_id, signal ORDER BY abs(support) DESC, sentence_idx) = 1), l AS (SELECT DISTINCT paper_id, signal FROM s WHERE cosine = 1 AND signal = 'A'),
e AS (SELECT DISTINCT paper_id, signal FROM s)
SELECT e.paper_id, e.signal, CASE WHEN l.paper_id IS NOT NULL THEN 'confirmed' WHEN support IS NULL OR abs(support) < 0.3 THEN 'unknown' WHEN support > 0 THEN 'confirmed' ELSE 'refuted' END AS value,
    CASE WHEN l.paper_id IS NOT NULL THEN 'url_match' WHEN support IS NULL THEN 'unknown:no_cosine_candidate_above_floor' WHEN abs(support) < 0.3 THEN 'unknown:support_below_floor' ELSE 'cosine+nli' END AS mechanism
FROM e LEFT JOIN b USING (paper_id, signal) LEFT JOIN l USING (paper_id, signal)""",
)
def dec_bool_signals(spark, sf_dir):
    view(spark, sf_dir, "lineitem")
    scored = spark.sql(_SIGNAL)
    return D.bool_signals(scored, scored.where("cosine = 1 and signal = 'A'")).select("paper_id", "signal", "value", "mechanism")


@register(
    "dec_span_types",
    """WITH s AS (SELECT l_orderkey AS span_id, p_type AS type, max(l_quantity / 50) AS cosine, max(l_discount * 10) AS entail FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
n AS (SELECT * FROM s WHERE cosine >= 0.4 QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY cosine DESC, type) <= 3),
r AS (SELECT *, row_number() OVER w AS nth, lead(entail) OVER w AS second FROM n WINDOW w AS (PARTITION BY span_id ORDER BY entail DESC, type))
SELECT span_id, type AS kind, cosine, entail, round(entail - coalesce(second, 0), 9) AS margin FROM r WHERE nth = 1 AND entail >= 0.45 AND round(entail - coalesce(second, 0), 9) >= 0.05 - 1e-9""",
)
def dec_span_types(spark, sf_dir):
    lines = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return D.span_types(lines.select(F.col("l_orderkey").alias("span_id"), F.col("p_type").alias("type"), (F.col("l_quantity") / 50).alias("cosine"), (F.col("l_discount") * 10).alias("entail")))


@register(
    "dec_paper_entities",
    """WITH s AS (SELECT l_orderkey AS paper_id, p_type AS kind, p_name AS raw, l_quantity / 50 AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, CASE WHEN raw LIKE 's%' THEN upper(raw) ELSE replace(raw, ' ', '_') END AS canonical FROM s)
SELECT paper_id, kind, canonical, raw, score, CASE WHEN raw LIKE 's%' THEN 'exact' ELSE 'novel' END AS how FROM n QUALIFY row_number() OVER (PARTITION BY paper_id, kind, canonical ORDER BY score DESC, raw) = 1""",
)
def dec_paper_entities(spark, sf_dir):
    parts = view(spark, sf_dir, "part")
    lines = view(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    spans = lines.select(F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("kind"), F.col("p_name").alias("raw"), (F.col("l_quantity") / 50).alias("score"))
    known = parts.where("p_name like 's%'").select(F.col("p_type").alias("kind"), F.col("p_name").alias("raw"), F.upper("p_name").alias("canonical"), F.lit("exact").alias("status")).distinct()
    return D.paper_entities(spans, known)


@register(
    "dec_context_classes",
    """WITH scores AS (SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS label, max(l_quantity / 50) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, label) AS nth FROM scores)
SELECT src, dst, CASE WHEN score >= 0.4 THEN label END AS context_class, score FROM r WHERE nth = 1""",
)
def dec_context_classes(spark, sf_dir):
    scores = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("label")).agg(F.max(F.col("l_quantity") / 50).alias("score"))
    return D.context_classes(scores)


@register(
    "dec_section_labels",
    """WITH c AS (SELECT o_orderkey AS chunk_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'introduction' WHEN '2-HIGH' THEN 'related_work' WHEN '3-MEDIUM' THEN 'methods' END AS told FROM orders),
b AS (SELECT l_orderkey AS chunk_id, l_returnflag AS label, max(l_quantity / 50) AS x FROM lineitem GROUP BY ALL), s AS (SELECT *, round(exp(x) / sum(exp(x)) OVER (PARTITION BY chunk_id), 6) AS share FROM b),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY share DESC, label) = 1)
SELECT chunk_id, coalesce(told, label, 'other') AS label, CASE WHEN told IS NULL THEN coalesce(share, 0) ELSE 1 END::DOUBLE AS score FROM c LEFT JOIN t USING (chunk_id)""",
)
def dec_section_labels(spark, sf_dir):
    slug = F.when(F.col("o_orderpriority") == "1-URGENT", "1_introduction").when(F.col("o_orderpriority") == "2-HIGH", "2_related_work").when(F.col("o_orderpriority") == "3-MEDIUM", "3_2_methods").otherwise("cache_priming")
    chunks = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), slug.alias("slug"))
    return D.section_labels(chunks, view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 50).alias("cosine")))


_STUDY = """SELECT p_partkey AS doc_id, 'The ' || p_name || CASE p_size % 4 WHEN 0 THEN ' is compared with baselines by F1 and top-5, with 95% CI.' WHEN 1 THEN ' runs on a laptop; we curated our own dataset.' WHEN 2 THEN ' has a public benchmark, exact match and mean IoU on 12,000 samples.'
    ELSE ' is at github.com.' END AS text FROM part"""


@register(
    "dec_study_signals",
    """SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'f1,top_5' WHEN 2 THEN 'exact_match,iou' ELSE '' END AS metrics, CASE p_size % 4 WHEN 2 THEN 12000 ELSE 0 END AS case_count, p_size % 4 = 0 AS baseline_compared, p_size % 4 = 0 AS uncertainty,
p_size % 4 = 1 AS hobby_project_scale, p_size % 4 = 1 AS self_constructed_ground_truth, p_size % 4 = 2 AS external_ground_truth, p_size % 4 = 3 AS reproducible FROM part""",
)
def dec_study_signals(spark, sf_dir):
    view(spark, sf_dir, "part")
    return D.study_signals(spark.sql(_STUDY)).withColumn("metrics", F.array_join("metrics", ","))


@register("dec_reranked")
def dec_reranked(spark, sf_dir):
    """Lexical candidates in the order of a stand-in pair model."""
    from corpusloom.operators import retrieval as R

    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    queries = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = R.bm25(docs, queries, 20).select("query_id", "doc_id").join(docs, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    return D.reranked(found, D.overlap_scorer, 5).select("query_id", "rank", "score")


@register("dec_embedded")
def dec_embedded(spark, sf_dir):
    """Texts through a stand-in embedding model."""
    rows = D.with_model(view(spark, sf_dir, "benchmark").select("item_id", "text"), "text", D.hash_embedder(16), "embedding", "array<double>")
    return rows.select("item_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))
