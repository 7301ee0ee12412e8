"""Vector operators over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import vectors as V
from corpusloom.queries.gap_queries import rounded

_N = "u AS (SELECT vec_id AS id, label, [x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings)"
_NEAR = f"""{_N}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _rows(spark, sf_dir):
    return view(spark, sf_dir, "vectors").select("id", "embedding", "label", "quality")


@register("vec_knn", f"WITH {_NEAR} SELECT query_id, rank::INT AS rank, score FROM near WHERE rank <= 5")
def vec_knn(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return V.knn(rows, rows, 5).select("query_id", "rank", "score")


@register("vec_paraphrases", f"WITH {_NEAR} SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM near WHERE rank <= 5 AND score >= 0.35 GROUP BY ALL")
def vec_paraphrases(spark, sf_dir):
    return V.paraphrases(_rows(spark, sf_dir), 5, 0.35)


_CENTROID = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
k AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), c AS (SELECT label, [x / sqrt(list_dot_product(c, c)) FOR x IN c] AS c FROM k)"""


@register("vec_centroids", f"WITH {_CENTROID} SELECT label, unnest(range(len(c)))::INT AS i, round(unnest(c), 6) AS x FROM c")
def vec_centroids(spark, sf_dir):
    c = V.centroids(_rows(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("i", "x"))
    return rounded(c, "x")


@register("vec_outliers", f"WITH {_N}, {_CENTROID} SELECT id, label, round(1 - list_dot_product(v, c), 6) AS distance FROM u JOIN c USING (label) WHERE round(1 - list_dot_product(v, c), 6) >= 0.9")
def vec_outliers(spark, sf_dir):
    return V.outliers(_rows(spark, sf_dir), "label", 0.9)


@register(
    "vec_prototypes",
    f"""WITH {_N}, {_CENTROID}, p AS (SELECT CASE WHEN label < 5 THEN 'include' ELSE 'exclude' END AS side, c FROM c), s AS (SELECT id, max(round(list_dot_product(v, c), 6)) FILTER (side = 'include') AS include, max(round(list_dot_product(v, c), 6)) FILTER (side = 'exclude') AS exclude FROM u, p GROUP BY 1)
SELECT *, CASE WHEN round(include - exclude, 6) > 0.1 AND include > 0.2 THEN 'include' WHEN round(exclude - include, 6) > 0.1 AND exclude > 0.2 THEN 'exclude' ELSE 'borderline' END AS label, round(1 - abs(round(include - exclude, 6)), 6) AS uncertainty FROM s""",
)
def vec_prototypes(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = V.centroids(rows, "label").select(F.when(F.col("label") < 5, "include").otherwise("exclude").alias("side"), F.col("centroid").alias("embedding"))
    return V.prototype_labels(rows, p, 0.1, 0.2)


@register(
    "vec_lof",
    f"""WITH {_NEAR}, k AS (SELECT query_id, id, greatest(0, 1 - score) AS d FROM near WHERE rank <= 10), kd AS (SELECT query_id AS id, max(d) AS kd FROM k GROUP BY 1),
r AS (SELECT query_id AS id, 1 / avg(greatest(d, kd)) AS lrd FROM k JOIN kd USING (id) GROUP BY 1) SELECT k.query_id AS id, round(avg(r.lrd) / any_value(o.lrd), 6) AS lof FROM k JOIN r ON r.id = k.id JOIN r o ON o.id = k.query_id GROUP BY 1""",
)
def vec_lof(spark, sf_dir):
    return rounded(V.local_outlier_factor(_rows(spark, sf_dir), 10), "lof")


@register("vec_quantised", "SELECT vec_id AS id, unnest(range(len(embedding)))::INT AS i, greatest(-127, least(127, round(unnest(embedding)::DOUBLE * 127)))::INT AS q FROM embeddings")
def vec_quantised(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", F.posexplode(V.quantise(F.col("embedding"))).alias("i", "q"))


@register("vec_communities")
def vec_communities(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return V.communities(V.pairs_above(rows, 0.35), rows.select("id"), 3)
