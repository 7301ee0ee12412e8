"""Reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import reports
from corpusloom.queries.gap_queries import rounded

_OK = "triage_label IN ('include', 'maybe')"


@register(
    "report_coverage",
    with_views("papers", "fields") + f""", e AS (SELECT paper_id FROM papers WHERE {_OK}), k AS (SELECT count(*) AS n_eligible FROM e),
f AS (SELECT field_name, count(DISTINCT paper_id) FILTER (field_value <> '') AS n_filled, count(DISTINCT paper_id) FILTER (field_value NOT IN ('', 'unknown')) AS n_known FROM fields JOIN e USING (paper_id) GROUP BY 1)
SELECT field_name, n_filled, n_known, n_eligible, round(100 * n_filled / n_eligible, 2) AS pct_filled, round(100 * n_known / n_eligible, 2) AS pct_known FROM f, k""",
)
def report_coverage(spark, sf_dir):
    return reports.field_coverage(view(spark, sf_dir, "papers"), view(spark, sf_dir, "fields"))


_SNAP = ("papers", "authors", "categories", "fields", "usage", "results", "cites", "claims", "texts")


@register("report_snapshot", with_views(*_SNAP) + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _SNAP))
def report_snapshot(spark, sf_dir):
    return reports.snapshot({t: view(spark, sf_dir, t) for t in _SNAP})


@register("report_labels", with_views("texts") + "SELECT coalesce(nullif(triage_label, ''), 'pending') AS label, count(*) AS n FROM texts GROUP BY 1")
def report_labels(spark, sf_dir):
    return reports.label_summary(view(spark, sf_dir, "texts"))


@register(
    "report_matrix",
    with_views("papers", "usage", "fields") + f""", c AS (SELECT DISTINCT paper_id, kind AS category FROM usage), m AS (SELECT paper_id, field_value AS method FROM fields WHERE field_name = 'method_family')
SELECT category, method, grouping_id(category, method)::INT AS level, count(DISTINCT p.paper_id) AS n_papers, count(DISTINCT CASE WHEN triage_label = 'include' THEN p.paper_id END) AS n_accepted
FROM papers p JOIN c USING (paper_id) JOIN m USING (paper_id) WHERE {_OK} GROUP BY CUBE (category, method)""",
)
def report_matrix(spark, sf_dir):
    c = view(spark, sf_dir, "usage").select("paper_id", F.col("kind").alias("category")).distinct()
    m = view(spark, sf_dir, "fields").where("field_name = 'method_family'").select("paper_id", F.col("field_value").alias("method"))
    return reports.matrix(view(spark, sf_dir, "papers"), c, m)


@register("report_corpus_index", with_views("usage") + "SELECT canonical, count(DISTINCT paper_id) AS n_papers, count(*) AS n_mentions FROM usage WHERE kind = 'ECONOMY' GROUP BY 1")
def report_corpus_index(spark, sf_dir):
    return reports.corpus_index(view(spark, sf_dir, "usage"), "ECONOMY")


@register(
    "report_category_check",
    with_views("categories") + ", d AS (SELECT DISTINCT c_mktsegment AS category FROM customer UNION SELECT min(category) FROM categories), u AS (SELECT DISTINCT category FROM categories) SELECT category, 'unused' AS status FROM d ANTI JOIN u USING (category) UNION ALL SELECT category, 'undeclared' FROM u ANTI JOIN d USING (category)",
)
def report_category_check(spark, sf_dir):
    used = view(spark, sf_dir, "categories")
    declared = view(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")).union(used.agg(F.min("category")))
    return reports.validate_categories(declared, used)


@register(
    "report_prisma",
    with_views("texts") + f"""SELECT (SELECT sum((props->>'$.k')::BIGINT)::BIGINT FROM events) AS identified, (SELECT count(*) FROM events) AS queries, (SELECT count(DISTINCT event_type) FROM events) AS sources,
    count(*) AS records, count(*) FILTER (triage_label = 'include') AS included, count(*) FILTER (triage_label = 'maybe') AS maybe, count(*) FILTER (triage_label = 'exclude') AS excluded, count(*) FILTER (triage_label = '') AS pending,
    (SELECT count(DISTINCT conv_id) FROM conversations JOIN texts ON conv_id = paper_id WHERE {_OK}) AS read FROM texts""",
)
def report_prisma(spark, sf_dir):
    papers = view(spark, sf_dir, "texts")
    searches = view(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("result_count"))
    return reports.prisma(searches, papers, view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id")))


@register(
    "report_exclusions",
    with_views("texts") + r"SELECT substr(lower(trim(regexp_split_to_array(abstract, '[.,;]')[1])), 1, 80) AS reason, count(*) AS n FROM texts WHERE triage_label = 'exclude' AND abstract <> '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 5",
)
def report_exclusions(spark, sf_dir):
    return reports.exclusion_reasons(view(spark, sf_dir, "texts").withColumn("reason", F.col("abstract")))


@register(
    "report_verdicts",
    """WITH i AS (SELECT o_custkey AS candidate_id, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM orders),
n AS (SELECT candidate_id, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'PASS') AS n_pass FROM i GROUP BY 1)
SELECT *, CASE WHEN n_fail > 0 OR n_partial >= 4 THEN 'reject' WHEN n_pass >= 7 THEN 'accept' WHEN n_partial + n_pass >= 1 THEN 'refine' ELSE 'pending' END AS verdict FROM n""",
)
def report_verdicts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("FAIL")
    return reports.verdicts(view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), status.alias("status")))


@register(
    "report_catalogue",
    with_views("papers", "categories") + f""", r AS (SELECT p.*, category FROM papers p JOIN categories USING (paper_id) WHERE {_OK}), s AS (SELECT category, count(DISTINCT paper_id) AS n_papers FROM r GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY n_papers DESC, category) AS chapter FROM s), x AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY year DESC NULLS LAST, paper_id) AS place FROM r)
SELECT chapter, category, n_papers, place, paper_id, year FROM x JOIN c USING (category) WHERE place <= 50""",
)
def report_catalogue(spark, sf_dir):
    return reports.catalogue(view(spark, sf_dir, "papers"), view(spark, sf_dir, "categories"))


@register("report_uncategorised", with_views("papers", "categories") + f"SELECT paper_id, year FROM papers WHERE {_OK} AND paper_id NOT IN (SELECT paper_id FROM categories)")
def report_uncategorised(spark, sf_dir):
    return reports.uncategorised(view(spark, sf_dir, "papers"), view(spark, sf_dir, "categories"))


@register(
    "report_round_robin",
    with_views("papers") + "SELECT paper_id, venue, turn FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY price DESC, paper_id) AS turn FROM papers) ORDER BY turn, venue LIMIT 60",
)
def report_round_robin(spark, sf_dir):
    return reports.round_robin(view(spark, sf_dir, "papers"), "venue", [F.desc("price"), "paper_id"], 60).select("paper_id", "venue", "turn")


@register(
    "agg_quantiles",
    with_views("papers") + """, r AS (SELECT venue, price, row_number() OVER (PARTITION BY venue ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM papers),
f AS (SELECT venue, max(price) FILTER (i = least(n - 1, floor(n * 0.9))) AS floor_index, max(price) FILTER (i = floor(n / 2)) AS upper_median FROM r GROUP BY 1)
SELECT venue, round(floor_index, 6) AS floor_index, round(upper_median, 6) AS upper_median, round(q, 6) AS interpolated FROM f JOIN (SELECT venue, quantile_cont(price, 0.9) AS q FROM papers GROUP BY 1) USING (venue)""",
)
def agg_quantiles(spark, sf_dir):
    return rounded(reports.quantiles(view(spark, sf_dir, "papers"), "price", "venue", 0.9), "floor_index", "upper_median", "interpolated")


@register(
    "agg_histogram",
    "SELECT b.bin::INT AS bin, count(o_totalprice) AS n FROM range(50) b(bin) LEFT JOIN orders ON greatest(0, least(49, floor(o_totalprice / 10000))) = b.bin GROUP BY 1",
)
def agg_histogram(spark, sf_dir):
    return reports.histogram(view(spark, sf_dir, "orders"), "o_totalprice", 0, 500000, 10000)


@register(
    "agg_threshold_sweep",
    with_views("papers") + ", t(threshold) AS (VALUES (100000.0::DOUBLE), (200000.0::DOUBLE), (300000.0::DOUBLE)), c AS (SELECT threshold, count(*) FILTER (price >= threshold AND triage_label = 'include') AS tp, count(*) FILTER (price >= threshold AND triage_label <> 'include') AS fp, count(*) FILTER (price < threshold AND triage_label = 'include') AS fn FROM papers, t GROUP BY 1) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
)
def agg_threshold_sweep(spark, sf_dir):
    rows = view(spark, sf_dir, "papers").withColumn("truth", F.col("triage_label") == "include")
    return rounded(reports.threshold_sweep(rows, "price", "truth", [100000.0, 200000.0, 300000.0]), "precision", "recall")


@register("agg_min_max", with_views("papers") + "SELECT paper_id, round((price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w), 6) AS scaled FROM papers WINDOW w AS (PARTITION BY venue)")
def agg_min_max(spark, sf_dir):
    return rounded(reports.min_max(view(spark, sf_dir, "papers"), "price", ["venue"]), "scaled").select("paper_id", "scaled")


@register(
    "win_character_budget",
    "WITH b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, turn, least(length(text), 1500 - before)::BIGINT AS taken FROM b WHERE before < 1500",
)
def win_character_budget(spark, sf_dir):
    return reports.character_budget(view(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 1500).select("conv_id", "turn", F.col("taken").cast("long").alias("taken"))
