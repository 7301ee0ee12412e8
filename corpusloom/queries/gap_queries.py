"""Detectors over declared axes and over clusters, citation networks and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.catalog import ORACLE_SQL, register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import gaps, network, phase4


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(
    "gap_evidence",
    with_views("results") + """
SELECT metric, dataset, count(DISTINCT paper_id) AS n_papers, count(*) AS n_values, round(max(value) - min(value), 6) AS range,
    round(stddev_pop(value) / abs(avg(value)), 6) AS cv, round((max(value) - min(value)) * ln(1 + count(DISTINCT paper_id)), 6) AS salience
FROM results GROUP BY metric, dataset
HAVING count(DISTINCT paper_id) >= 8 AND NOT (max(value) - min(value) < 0.1 AND stddev_pop(value) / abs(avg(value)) < 0.15)""",
)
def gap_evidence(spark, sf_dir):
    found = gaps.evidence_gap(view(spark, sf_dir, "results"), min_papers=8, limit=1000)
    return rounded(found, "range", "cv", "salience").select("metric", "dataset", "n_papers", "n_values", "range", "cv", "salience")


def _axes_sql(*axes: str) -> str:
    """Empty cells of the axes with the sum and number of their neighbours, by a join of cells that differ in one axis."""
    names, k = ", ".join(axes), len(axes)
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {a} FROM n)" for a in axes)
    same = " + ".join(f"(e.{a} = n.{a})::INT" for a in axes)
    size = " + ".join(f"(SELECT count(DISTINCT {a}) FROM n)" for a in axes)
    return f""", n AS (SELECT {names}, count(DISTINCT paper_id) AS n FROM grid WHERE {" AND ".join(f"{a}::VARCHAR NOT IN ('', 'unknown')" for a in axes)} GROUP BY ALL),
all_cells AS (SELECT * FROM {grid}), e AS (SELECT * FROM all_cells ANTI JOIN n USING ({names})),
nb AS (SELECT {", ".join("e." + a for a in axes)}, sum(n.n) AS s, count(*) AS d FROM e JOIN n ON ({same}) = {k - 1} GROUP BY ALL), size AS (SELECT {size} - {k} AS k)
SELECT {names}, round(s / k, 6) AS mean_neighbours, d AS dense_neighbours, round(s / k * d, 6) AS salience FROM nb, size"""


@register("gap_knowledge", with_views("grid") + _axes_sql("category", "brand", "domain") + " WHERE s / k >= 0.05")
def gap_knowledge(spark, sf_dir):
    found = gaps.knowledge_gap(view(spark, sf_dir, "grid"), ["category", "brand", "domain"], 0.05, limit=1_000_000)
    return rounded(found, "mean_neighbours", "salience").drop("signature")


@register("gap_population", with_views("grid") + _axes_sql("category", "sample") + " WHERE s / k >= 0.5")
def gap_population(spark, sf_dir):
    found = gaps.population_gap(view(spark, sf_dir, "grid"), ["category", "sample"], 0.5, limit=1_000_000)
    return rounded(found, "mean_neighbours", "salience").drop("signature")


@register(
    "gap_methodological",
    with_views("grid") + """, r AS (SELECT category, count(DISTINCT paper_id) AS row_total FROM grid GROUP BY 1), m AS (SELECT method, count(DISTINCT paper_id) AS column_total FROM grid GROUP BY 1)
SELECT category, method, row_total, column_total, row_total * greatest(1, column_total) AS salience FROM r CROSS JOIN m
WHERE row_total >= 2 AND NOT EXISTS (SELECT 1 FROM grid c WHERE c.category = r.category AND c.method = m.method)""",
)
def gap_methodological(spark, sf_dir):
    return gaps.methodological_gap(view(spark, sf_dir, "grid"), "category", "method", 2, limit=1_000_000).drop("signature")


@register(
    "gap_empirical",
    with_views("claims") + """SELECT cluster_id, count(*) FILTER (stance = 'theorises') AS theorises, count(*) FILTER (stance = 'validates') AS validates, count(*) AS n_claims,
    count(DISTINCT paper_id) AS n_papers, count(*) FILTER (stance = 'theorises') * count(DISTINCT paper_id) AS salience
FROM claims GROUP BY cluster_id HAVING theorises >= 2 AND validates = 0""",
)
def gap_empirical(spark, sf_dir):
    return gaps.empirical_gap(view(spark, sf_dir, "claims")).drop("signature")


@register(
    "gap_practical",
    with_views("claims") + """, s AS (SELECT *, CASE WHEN method_family IN ('survey', 'observational', 'case_study') THEN 'p' WHEN method_family IN ('experimental', 'theoretical', 'formal', 'review') THEN 'l' END AS side FROM claims),
k AS (SELECT cluster_id, side, stance, count(*) AS n FROM s WHERE side IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id, side ORDER BY n DESC, stance) = 1),
z AS (SELECT cluster_id, count(*) FILTER (side = 'p') AS practice_claims, count(DISTINCT paper_id) FILTER (side = 'p') AS practice_papers, count(*) FILTER (side = 'l') AS literature_claims, count(DISTINCT paper_id) FILTER (side = 'l') AS literature_papers FROM s GROUP BY 1)
SELECT z.*, p.stance AS practice_mode, l.stance AS literature_mode, least(practice_papers, literature_papers) * greatest(practice_claims, literature_claims) AS salience
FROM z JOIN m p ON p.cluster_id = z.cluster_id AND p.side = 'p' JOIN m l ON l.cluster_id = z.cluster_id AND l.side = 'l' WHERE p.stance <> l.stance""",
)
def gap_practical(spark, sf_dir):
    return gaps.practical_gap(view(spark, sf_dir, "claims")).drop("signature")


@register(
    "gap_theoretical",
    with_views("papers", "categories", "usage", "fields") + """, p AS (SELECT paper_id FROM papers WHERE triage_label IN ('include', 'maybe')),
a AS (SELECT DISTINCT paper_id, canonical FROM usage WHERE kind = 'PROMO'),
o AS (SELECT category, count(DISTINCT c.paper_id) AS n_papers, count(DISTINCT a.canonical) AS k FROM categories c JOIN p USING (paper_id) LEFT JOIN a ON a.paper_id = c.paper_id GROUP BY 1),
d AS (SELECT canonical, count(DISTINCT a.paper_id) AS n_papers, count(DISTINCT a.paper_id) FILTER (f.field_value = 'confirmed') AS n FROM a JOIN p USING (paper_id) LEFT JOIN fields f ON f.paper_id = a.paper_id AND f.field_name = 'challenges_existing' GROUP BY 1)
SELECT 'orphan' AS reason, category AS name, n_papers, round(n_papers / greatest(1, k), 6) AS ratio, round(n_papers * (n_papers / greatest(1, k) / 15), 6) AS salience FROM o WHERE n_papers / greatest(1, k) >= 15
UNION ALL SELECT 'disputed', canonical, n_papers, round(n / n_papers, 6), round(n * (n / n_papers) * 10, 6) FROM d WHERE n / n_papers >= 0.25 AND n_papers >= 2""",
)
def gap_theoretical(spark, sf_dir):
    papers = view(spark, sf_dir, "papers").where("triage_label in ('include', 'maybe')")
    fields = view(spark, sf_dir, "fields").where("field_name = 'challenges_existing'").select("paper_id", F.col("field_value").alias("verdict"))
    anchors = view(spark, sf_dir, "usage").where("kind = 'PROMO'").select("paper_id", "canonical")
    found = gaps.theoretical_gap(papers, view(spark, sf_dir, "categories"), anchors, fields, orphan_ratio=15, limit=100_000)
    return rounded(found, "ratio", "salience").drop("signature")


@register(
    "p4_evidence",
    with_views("results") + """SELECT metric, dataset, count(*) AS n_papers, round(stddev_pop(value) / abs(avg(value)), 6) AS cv, round(count(*) * stddev_pop(value) / abs(avg(value)) * 10, 2) AS salience
FROM results WHERE dataset <> '' GROUP BY metric, dataset HAVING count(*) >= 2 AND stddev_pop(value) / abs(avg(value)) >= 0.1""",
)
def p4_evidence(spark, sf_dir):
    return rounded(phase4.evidence(view(spark, sf_dir, "results")), "cv").drop("signature")


_CELLS = ", cells AS (SELECT paper_cluster_id, method_cluster_id, count(*) AS n FROM clustered WHERE paper_cluster_id IS NOT NULL AND method_cluster_id IS NOT NULL GROUP BY ALL)"


@register(
    "p4_knowledge",
    with_views("clustered") + _CELLS + """, r AS (SELECT paper_cluster_id, sum(n)::BIGINT AS row_density FROM cells GROUP BY 1), c AS (SELECT method_cluster_id, sum(n)::BIGINT AS column_density FROM cells GROUP BY 1)
SELECT paper_cluster_id, method_cluster_id, row_density, column_density, row_density + column_density AS neighbours, round((row_density + column_density) / 2, 2) AS salience
FROM r CROSS JOIN c WHERE row_density + column_density >= 2 AND NOT EXISTS (SELECT 1 FROM cells x WHERE x.paper_cluster_id = r.paper_cluster_id AND x.method_cluster_id = c.method_cluster_id)""",
)
def p4_knowledge(spark, sf_dir):
    return phase4.knowledge(view(spark, sf_dir, "clustered")).drop("signature")


@register(
    "p4_methodological",
    with_views("clustered") + _CELLS + """, r AS (SELECT paper_cluster_id, count(*) AS topic_size FROM clustered GROUP BY 1), c AS (SELECT method_cluster_id, count(*) AS method_size FROM clustered WHERE method_cluster_id IS NOT NULL GROUP BY 1)
SELECT paper_cluster_id, method_cluster_id, topic_size, method_size, round(topic_size * method_size / 10, 2) AS salience FROM r CROSS JOIN c
WHERE topic_size >= 2 AND method_size >= 2 AND NOT EXISTS (SELECT 1 FROM cells x WHERE x.paper_cluster_id = r.paper_cluster_id AND x.method_cluster_id = c.method_cluster_id)""",
)
def p4_methodological(spark, sf_dir):
    return phase4.methodological(view(spark, sf_dir, "clustered")).drop("signature")


@register(
    "p4_empirical",
    with_views("claims") + "SELECT cluster_id, count(*) FILTER (stance = 'theorises') AS theorises, count(*) FILTER (stance = 'validates') AS validates, count(DISTINCT paper_id) AS n_papers, round(count(*) FILTER (stance = 'theorises') * 1.5, 2)::DOUBLE AS salience FROM claims GROUP BY 1 HAVING theorises >= 2 AND validates = 0",
)
def p4_empirical(spark, sf_dir):
    return phase4.empirical(view(spark, sf_dir, "claims")).withColumn("salience", F.col("salience").cast("double")).drop("signature")


@register(
    "p4_theoretical",
    with_views("claims") + """, g AS (SELECT topic, count(*) FILTER (claim_type = 'finding') AS findings, count(*) FILTER (claim_type = 'framework') AS frameworks FROM claims GROUP BY 1)
SELECT topic, findings, frameworks, round(frameworks / findings, 6) AS ratio, round((findings - frameworks) * 0.5, 2)::DOUBLE AS salience FROM g WHERE findings >= 2 AND frameworks / findings <= 0.6""",
)
def p4_theoretical(spark, sf_dir):
    return rounded(phase4.theoretical(view(spark, sf_dir, "claims"), max_ratio=0.6), "ratio").withColumn("salience", F.col("salience").cast("double")).drop("signature")


@register(
    "p4_population",
    with_views("clustered") + """, u AS (SELECT DISTINCT p_partkey AS paper_id, p_brand || ' ' || p_type AS label FROM part WHERE regexp_matches(p_brand, '#[1-3]')),
x AS (SELECT u.*, paper_cluster_id AS topic FROM u JOIN clustered USING (paper_id)), m AS (SELECT label, count(DISTINCT paper_id) AS mentions FROM x GROUP BY 1)
SELECT topic, label, mentions, round(mentions * 0.5, 2)::DOUBLE AS salience FROM (SELECT DISTINCT paper_cluster_id AS topic FROM clustered) CROSS JOIN m ANTI JOIN x USING (topic, label)""",
)
def p4_population(spark, sf_dir):
    topics = view(spark, sf_dir, "clustered").select("paper_id", F.col("paper_cluster_id").alias("topic"))
    mentions = view(spark, sf_dir, "grid").select("paper_id", F.col("method").alias("label"))
    return phase4.population(mentions, topics, "#[1-3]").withColumn("salience", F.col("salience").cast("double")).drop("signature")


@register(
    "p4_practical",
    with_views("claims") + """, k AS (SELECT cluster_id, topic, stance, count(*) AS n FROM claims GROUP BY ALL), m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id, topic ORDER BY n DESC, stance) = 1),
g AS (SELECT cluster_id, count(*) AS topics, count(*) FILTER (stance IN ('validates', 'asserts', 'extends')) AS supporting, count(*) FILTER (stance = 'challenges') AS challenging FROM m GROUP BY 1)
SELECT g.*, n_papers, round(n_papers * 0.8, 2)::DOUBLE AS salience FROM g JOIN (SELECT cluster_id, count(DISTINCT paper_id) AS n_papers FROM claims GROUP BY 1) USING (cluster_id) WHERE topics >= 2 AND supporting > 0 AND challenging > 0""",
)
def p4_practical(spark, sf_dir):
    return phase4.practical(view(spark, sf_dir, "claims")).withColumn("salience", F.col("salience").cast("double")).drop("signature")


@register(
    "net_co_citation",
    with_views("cites") + ", c AS (SELECT DISTINCT src, dst FROM cites) SELECT x.dst AS a, y.dst AS b, count(*) AS strength FROM c x JOIN c y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL HAVING count(*) >= 2 ORDER BY strength DESC, a, b LIMIT 40",
)
def net_co_citation(spark, sf_dir):
    return network.co_citation(view(spark, sf_dir, "cites"), 2, 40)


@register(
    "net_coupling",
    with_views("cites") + ", c AS (SELECT DISTINCT src, dst FROM cites) SELECT x.src AS a, y.src AS b, count(*) AS strength FROM c x JOIN c y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 2 ORDER BY strength DESC, a, b LIMIT 40",
)
def net_coupling(spark, sf_dir):
    return network.bibliographic_coupling(view(spark, sf_dir, "cites"), 2, 40)


def _pagerank_sql(rounds: int) -> str:
    sql = with_views("graph") + """, w AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM graph GROUP BY ALL), o AS (SELECT src, sum(w) AS total FROM w GROUP BY 1),
nodes AS MATERIALIZED (SELECT node, total FROM (SELECT src AS node FROM w UNION SELECT dst FROM w) LEFT JOIN o ON node = src), k AS (SELECT count(*) AS k FROM nodes), r0 AS (SELECT node, total, 1.0::DOUBLE / k AS rank FROM nodes, k)"""
    for i in range(rounds):
        sql += f""", r{i + 1} AS MATERIALIZED (SELECT n.node, n.total, 0.15::DOUBLE / k + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE total IS NULL) / k) AS rank
    FROM nodes n CROSS JOIN k LEFT JOIN (SELECT dst, sum(rank * w / total) AS got FROM w JOIN r{i} ON src = node GROUP BY 1) g ON g.dst = n.node)"""
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@register("net_pagerank", _pagerank_sql(8))
def net_pagerank(spark, sf_dir):
    return rounded(network.pagerank(view(spark, sf_dir, "graph"), max_rounds=8, tolerance=None), "rank")


@register("net_pagerank_converged")
def net_pagerank_converged(spark, sf_dir):
    return rounded(network.pagerank(view(spark, sf_dir, "graph")), "rank")


@register(
    "net_triangulation",
    with_views("papers", "cites") + "SELECT dst, count(DISTINCT src) AS n_citing FROM cites JOIN papers p ON src = p.paper_id WHERE price > 50000 AND triage_label = 'include' AND dst NOT IN (SELECT paper_id FROM papers WHERE price > 50000) GROUP BY 1 HAVING n_citing >= 2 ORDER BY n_citing DESC, dst LIMIT 30",
)
def net_triangulation(spark, sf_dir):
    return network.triangulation(view(spark, sf_dir, "cites"), view(spark, sf_dir, "papers").where("price > 50000"))


@register(
    "net_rerank",
    with_views("cites", "categories") + """, d AS (SELECT dst, count(*) AS n FROM cites GROUP BY 1), c AS (SELECT 'category:' || category AS signature, paper_id FROM categories), s AS (SELECT signature, count(*) AS salience FROM c GROUP BY 1),
w AS (SELECT signature, avg(1 + ln(1 + coalesce(n, 0))) AS weight FROM c LEFT JOIN d ON dst = paper_id GROUP BY 1) SELECT signature, salience, round(weight, 6) AS weight, round(salience * weight, 6) AS reranked FROM s JOIN w USING (signature)""",
)
def net_rerank(spark, sf_dir):
    c = view(spark, sf_dir, "categories").select(F.concat(F.lit("category:"), "category").alias("signature"), "paper_id")
    return rounded(network.rerank(c.groupBy("signature").agg(F.count("*").alias("salience")), c, view(spark, sf_dir, "cites")), "weight", "reranked")


@register("net_main_path")
def net_main_path(spark, sf_dir):
    graph = view(spark, sf_dir, "graph")
    years = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct().select("node", (2001 - F.col("node") % 12).alias("year"))
    return network.main_path(graph, years)


@register(
    "net_coherence",
    with_views("usage") + "SELECT paper_id, count(DISTINCT kind) AS n_types, array_to_string(list_sort(list(DISTINCT kind)), ',') AS types FROM usage GROUP BY 1 HAVING count(DISTINCT kind) >= 3",
)
def net_coherence(spark, sf_dir):
    return network.coherence(view(spark, sf_dir, "usage").select(F.col("kind").alias("type"), "paper_id"))


@register(
    "trend_temporal",
    with_views("papers", "usage", "fields", "categories") + """, u AS (SELECT kind AS axis, canonical AS value, paper_id FROM usage UNION ALL SELECT 'category', category, paper_id FROM categories UNION ALL SELECT field_name, field_value, paper_id FROM fields WHERE field_name = 'method_family'),
r AS (SELECT u.*, year FROM u JOIN papers USING (paper_id)), t AS (SELECT axis, value, count(DISTINCT paper_id) AS total FROM r GROUP BY ALL), y0 AS (SELECT axis, value, year, count(*) AS n FROM r GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY axis, value ORDER BY year DESC) AS nth FROM y0),
g AS (SELECT axis, value, sum(CASE WHEN year > 2001 - 3 THEN n ELSE 0 END)::BIGINT AS recent, max(n) FILTER (nth = 1) AS y1, max(n) FILTER (nth = 2) AS y2, max(n) FILTER (nth = 3) AS y3 FROM y GROUP BY ALL),
z AS (SELECT *, recent / total AS f FROM t JOIN g USING (axis, value) WHERE total >= 4),
q AS (SELECT *, CASE WHEN f >= 0.45 THEN 'emerging' WHEN 1 - f >= 0.6 THEN 'declining' WHEN y1 > y2 AND y2 > y3 THEN 'accelerating' END AS trend FROM z)
SELECT axis, value, trend, total, recent, round(f, 6) AS recent_fraction, round((total * CASE trend WHEN 'emerging' THEN 1.5 WHEN 'declining' THEN 1.0 ELSE 1.2 END)::DOUBLE, 6) AS salience FROM q WHERE trend IS NOT NULL""",
)
def trend_temporal(spark, sf_dir):
    usage = view(spark, sf_dir, "usage").select(F.col("kind").alias("axis"), F.col("canonical").alias("value"), "paper_id")
    categories = view(spark, sf_dir, "categories").select(F.lit("category").alias("axis"), F.col("category").alias("value"), "paper_id")
    methods = view(spark, sf_dir, "fields").where("field_name = 'method_family'").select(F.col("field_name").alias("axis"), F.col("field_value").alias("value"), "paper_id")
    rows = usage.union(categories).union(methods).join(view(spark, sf_dir, "papers").select("paper_id", "year"), "paper_id")
    found = network.temporal_trends(rows, 2001, emerging=0.45, declining=0.6, limit=100_000)
    return rounded(found, "recent_fraction", "salience").drop("signature")
