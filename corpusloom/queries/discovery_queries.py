"""Clusters, prototypes, training, recommendations and voids over the embeddings; rows of labels 0 to 4 play one part, those of 5 to 9 the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import discovery as D
from corpusloom.operators import vectors as V
from corpusloom.operators.decisions import hash_embedder, with_model
from corpusloom.queries.gap_queries import rounded
from corpusloom.queries.vector_queries import _N, _NEAR

_SIDES = f"""{_N}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label < 5 AND b.label >= 5),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _rows(spark, sf_dir):
    return view(spark, sf_dir, "vectors").select("id", "embedding", "label", "quality")


def _sides(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.where("label < 5"), rows.where("label >= 5")


@register("vec_autotune", f"WITH {_NEAR}, k AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM near WHERE rank = 3) SELECT greatest(0.55, least(0.92, score))::DOUBLE AS threshold, greatest(2, n // 5) AS min_size FROM k WHERE i = n // 2")
def vec_autotune(spark, sf_dir):
    return spark.createDataFrame([D.tuned(_rows(spark, sf_dir))], "threshold double, min_size long")


@register("vec_phase3_clusters")
def vec_phase3_clusters(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    members = D.clusters(rows, "claim", threshold=0.35, min_size=3)
    return D.representatives(rows, members, 5)


@register(
    "vec_bigram_labels",
    r"""WITH w AS (SELECT source AS community, doc_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\- ]', ' ', 'g'), '\s+') IF length(x) > 2 AND NOT list_contains(string_split('"""
    + " ".join(D.LABEL_STOP)
    + r"""', ' '), x)] AS w FROM documents),
g AS (SELECT community, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w), c AS (SELECT community, g, count(*) AS n FROM g GROUP BY ALL)
SELECT community, g AS label FROM c QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, g) = 1""",
)
def vec_bigram_labels(spark, sf_dir):
    return D.bigram_labels(view(spark, sf_dir, "documents").select(F.col("source").alias("community"), "text"))


@register(
    "vec_axis_labels",
    r"""WITH w AS (SELECT source AS community, doc_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s-]', ' ', 'g'), '\s+') IF length(x) > 2 AND NOT list_contains(string_split('"""
    + " ".join(x.replace("'", "''") for x in D.AXIS_STOP)
    + r"""', ' '), x)] AS w FROM documents),
g AS (SELECT DISTINCT community, doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w), df AS (SELECT g, count(*) AS df FROM g GROUP BY 1), z AS (SELECT community, count(*) AS size FROM w GROUP BY 1),
c AS (SELECT community, g, count(*) AS c FROM g GROUP BY ALL)
SELECT community, g AS label FROM c JOIN df USING (g) JOIN z USING (community) WHERE c >= 2 OR size <= 2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY round(c / sqrt(df), 6) DESC, g) = 1""",
)
def vec_axis_labels(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("community"))
    return D.axis_labels(docs, docs.select("id", "text"))


@register("vec_longest_methods", "SELECT conv_id AS paper_id, md5(text) AS digest FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1")
def vec_longest_methods(spark, sf_dir):
    label = F.when(F.col("role") == "system", "references").when(F.col("role") == "user", "methods")
    chunks = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_idx"), label.alias("label"), "text")
    return D.longest_methods(chunks).select("paper_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("vec_distributions", with_views("claims") + "SELECT cluster_id AS community, stance AS value, count(*) AS n FROM claims GROUP BY ALL")
def vec_distributions(spark, sf_dir):
    claims = view(spark, sf_dir, "claims")
    found = D.distributions(claims.select(F.col("cluster_id").alias("community"), F.col("claim_id").alias("id")), claims.select(F.col("claim_id").alias("id"), "stance", "claim_type"), "stance", "claim_type")
    return found.select("community", F.explode("stance").alias("value", "n"))


_SCORES = f"""{_N}, q AS (SELECT id, v, label, quality FROM u JOIN (SELECT e.vec_id AS id, l.quality FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id) USING (id)),
z AS (SELECT q.id, max(round(list_dot_product(q.v, p.v), 6)) FILTER (p.quality = 1) AS include, max(round(list_dot_product(q.v, p.v), 6)) FILTER (p.quality = 0) AS exclude FROM q JOIN q p ON p.quality IS NOT NULL WHERE q.quality IS NULL GROUP BY 1)"""


def _scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    prototypes = rows.where("quality is not null").select(F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("side"), "embedding")
    return D.side_scores(rows.where("quality is null"), prototypes)


@register(
    "vec_proposed_decisions",
    f"WITH {_SCORES} SELECT *, round(include - exclude, 6) AS margin, CASE WHEN round(include - exclude, 6) > 0.1 AND include > 0.3 THEN 'include' WHEN round(exclude - include, 6) > 0.1 AND exclude > 0.3 THEN 'exclude' ELSE 'borderline' END AS decision FROM z",
)
def vec_proposed_decisions(spark, sf_dir):
    return D.proposed_decisions(_scores(spark, sf_dir), 0.1, 0.3)


@register("vec_remaining_decisions", f"WITH {_SCORES} SELECT *, CASE WHEN include > exclude THEN 'include' WHEN exclude > include THEN 'exclude' ELSE 'maybe' END AS decision FROM z WHERE include IS NOT NULL AND exclude IS NOT NULL")
def vec_remaining_decisions(spark, sf_dir):
    return D.remaining_decisions(_scores(spark, sf_dir))


@register(
    "vec_missed_includes",
    f"""WITH {_N}, p AS (SELECT u.id, v, quality FROM u JOIN labels ON id = doc_id), z AS (SELECT a.id, max(round(list_dot_product(a.v, b.v), 6)) AS include FROM p a JOIN p b ON b.quality = 1 WHERE a.quality = 0 GROUP BY 1)
SELECT id, include FROM z WHERE include >= 0.25 ORDER BY include DESC, id LIMIT 20""",
)
def vec_missed_includes(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("quality is not null")
    label = F.when(F.col("quality") == 1, "include").otherwise("exclude")
    prototypes = rows.where("quality = 1").select(label.alias("side"), "embedding")
    return D.missed_includes(D.side_scores(rows.where("quality = 0"), prototypes), rows.select("id", label.alias("label")), 0.25).select("id", "include")


@register("vec_sub_prototypes")
def vec_sub_prototypes(spark, sf_dir):
    return D.sub_prototypes(_rows(spark, sf_dir).where("quality = 1").select("id", "embedding")).select("id", "size")


@register(
    "vec_training_state",
    with_views("texts") + """, n AS (SELECT count(*) FILTER (triage_label = 'include') AS include, count(*) FILTER (triage_label = 'exclude') AS exclude, count(*) FILTER (triage_label = 'maybe') AS maybe, count(*) FILTER (triage_label = '') AS pending FROM texts)
SELECT include + exclude + maybe AS decided, *, include > 0 AND exclude > 0 AND include + exclude + maybe >= 10 AS unlocked FROM n""",
)
def vec_training_state(spark, sf_dir):
    return D.training_state(view(spark, sf_dir, "texts").select(F.col("triage_label").alias("label")))


@register("vec_training_step")
def vec_training_step(spark, sf_dir):
    """A batch of three, answered with include, and what follows from it."""
    rows = _rows(spark, sf_dir)
    label = F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "exclude")
    labels = rows.select("id", label.alias("label"))
    members = D.clusters(rows, "paper", threshold=0.35, min_size=3)
    batch = D.training_batch(rows, members, rows.where("quality is null"), 3, 0.35)
    answers = batch.select(F.col("centre").alias("id")).distinct().withColumn("label", F.lit("include"))
    return D.training_step(labels, answers, batch, _scores(spark, sf_dir))


@register("vec_cosine_profile")
def vec_cosine_profile(spark, sf_dir):
    return D.cosine_profile(_rows(spark, sf_dir), 1000)


@register(
    "vec_recommend",
    with_views("claims") + f""", {_N}, c AS (SELECT id, id % 50 AS p, v FROM u), m AS (SELECT a.id AS q, b.p, round(list_dot_product(a.v, b.v), 6) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.id) AS k FROM c a JOIN c b ON a.p < 5 AND b.p >= 5),
x AS (SELECT p, sum(s) AS raw FROM m WHERE k <= 5 AND s > 0 GROUP BY 1), y AS (SELECT l_partkey % 50 AS p, count(*)::DOUBLE AS raw FROM lineitem WHERE l_suppkey % 50 < 5 AND l_partkey % 50 >= 5 GROUP BY 1),
a AS (SELECT p, CASE WHEN (SELECT max(raw) = min(raw) FROM x) THEN 1 ELSE (raw - (SELECT min(raw) FROM x)) / ((SELECT max(raw) FROM x) - (SELECT min(raw) FROM x)) END AS s FROM x),
b AS (SELECT p, CASE WHEN (SELECT max(raw) = min(raw) FROM y) THEN 1 ELSE (raw - (SELECT min(raw) FROM y)) / ((SELECT max(raw) FROM y) - (SELECT min(raw) FROM y)) END AS c FROM y)
SELECT p AS paper_id, round(0.6 * coalesce(s, 0) + 0.4 * coalesce(c, 0), 4) AS score, round(coalesce(s, 0), 4) AS claim_similarity, round(coalesce(c, 0), 4) AS citation_pull FROM a FULL JOIN b USING (p) ORDER BY score DESC, paper_id LIMIT 20""",
)
def vec_recommend(spark, sf_dir):
    claims = view(spark, sf_dir, "claims").select("claim_id", "paper_id", "embedding")
    cites = view(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst"))
    papers = claims.select("paper_id").distinct()
    return D.recommend(claims, cites, papers, papers.where("paper_id < 5"))


@register("vec_drift", f"WITH {_N} SELECT u.id AS query_id, round(list_dot_product(u.v, t.v), 6) AS score FROM u, (SELECT v FROM u WHERE id = 0) t")
def vec_drift(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return D.drift(rows, rows.where("id = 0"))


@register(
    "vec_filtered_search",
    f"""WITH {_N}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id <> b.id AND b.label < 5 AND b.id NOT IN (SELECT doc_id FROM labels)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, score FROM near WHERE rank <= 3""",
)
def vec_filtered_search(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return D.search(rows, rows, 3, F.col("label") < 5, rows.where("quality is not null"))


@register("vec_density_voids", f"WITH {_SIDES}, v AS (SELECT query_id AS id, round(1 - max(score), 6) AS void, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5) AS neighbours FROM near GROUP BY 1) SELECT * FROM v ORDER BY void DESC, id LIMIT 20")
def vec_density_voids(spark, sf_dir):
    probes, corpus = _sides(spark, sf_dir)
    return D.density_voids(probes, corpus).withColumn("neighbours", F.array_join("neighbours", ","))


@register("vec_contradictions", f"WITH {_N} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id < b.id AND a.id % 50 <> b.id % 50 WHERE round(list_dot_product(a.v, b.v), 6) >= 0.35 ORDER BY score DESC, a, b LIMIT 30")
def vec_contradictions(spark, sf_dir):
    return D.contradictions(_rows(spark, sf_dir).withColumn("paper_id", F.col("id") % 50), 0.35)


@register("vec_themes")
def vec_themes(spark, sf_dir):
    return D.themes(_rows(spark, sf_dir).withColumn("paper_id", F.col("id") % 50), 0.35, 3).withColumn("ids", F.array_join("ids", ","))


@register("vec_external_gaps")
def vec_external_gaps(spark, sf_dir):
    corpus, external = _sides(spark, sf_dir)
    return D.external_gaps(corpus, external, 0.3, 3, 2, 2)


@register("vec_claim_clusters")
def vec_claim_clusters(spark, sf_dir):
    claims = view(spark, sf_dir, "claims")
    fields = claims.select("paper_id", F.lit("method_family").alias("field_name"), F.col("method_family").alias("field_value")).distinct()
    categories = claims.select("paper_id", F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("category"))
    found = D.claim_clusters(claims.drop("method_family"), fields, categories, ("method_family",), 0.35, 3)
    return found.withColumn("categories", F.array_join("categories", ","))


@register("vec_grounding", f"WITH {_SIDES} SELECT query_id AS id, id AS chunk_id, id % 7 AS page, score FROM near WHERE rank = 1 AND score >= 0.3")
def vec_grounding(spark, sf_dir):
    passages, chunks = _sides(spark, sf_dir)
    return D.grounded_passages(passages, chunks.withColumn("page", F.col("id") % 7))


@register(
    "vec_field_bundles",
    f"""WITH {_SIDES}, t AS (SELECT query_id, rank, id, repeat('chunk ' || id || ' ', 4) AS text FROM near WHERE rank <= 6), b AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) - length(text) AS before FROM t)
SELECT 'f' || query_id AS field, md5(string_agg(substr(text, 1, (100 - before)::BIGINT), chr(10) || chr(10) ORDER BY rank)) AS digest FROM b WHERE before < 100 GROUP BY 1""",
)
def vec_field_bundles(spark, sf_dir):
    fields, chunks = _sides(spark, sf_dir)
    text = F.repeat(F.concat(F.lit("chunk "), F.col("id").cast("string"), F.lit(" ")), 4)
    found = D.field_bundles(fields.withColumn("field", F.concat(F.lit("f"), F.col("id").cast("string"))), chunks.withColumn("text", text), 6, 100)
    return found.select("field", F.md5(F.col("text").cast("binary")).alias("digest"))


@register(
    "vec_binary",
    "WITH b AS (SELECT vec_id AS id, unnest(range(8)) AS i, [(x > 0)::INT FOR x IN embedding] AS b FROM embeddings) SELECT id, i::INT AS i, (b[8*i+1]*128 + b[8*i+2]*64 + b[8*i+3]*32 + b[8*i+4]*16 + b[8*i+5]*8 + b[8*i+6]*4 + b[8*i+7]*2 + b[8*i+8])::INT AS byte FROM b",
)
def vec_binary(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", F.posexplode(V.binary(F.col("embedding"))).alias("i", "byte"))


@register(
    "vec_truncated",
    "WITH t AS (SELECT vec_id AS id, embedding[1:8]::DOUBLE[] AS t FROM embeddings) SELECT id, unnest(range(8))::INT AS i, round(unnest([x / sqrt(list_dot_product(t, t)) FOR x IN t]), 6) AS x FROM t",
)
def vec_truncated(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select("id", F.posexplode(V.truncated(F.col("embedding"), 8)).alias("i", "x")), "x")


@register(
    "vec_softmax",
    "WITH t AS (SELECT vec_id AS id, [exp(x::DOUBLE * 4) FOR x IN embedding] AS e FROM embeddings) SELECT id, unnest(range(len(e)))::INT AS i, round(unnest([x / list_sum(e) FOR x IN e]), 6) AS x FROM t",
)
def vec_softmax(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select("id", F.posexplode(V.softmax(F.col("embedding"), 0.25)).alias("i", "x")), "x")


@register(
    "vec_dequantised",
    "SELECT vec_id AS id, unnest(range(len(embedding)))::INT AS i, round(greatest(-127, least(127, round(unnest(embedding)::DOUBLE * 127))) / 127, 6) AS x FROM embeddings",
)
def vec_dequantised(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select("id", F.posexplode(V.dequantise(V.quantise(F.col("embedding")))).alias("i", "x")), "x")


@register("vec_seeded_axis")
def vec_seeded_axis(spark, sf_dir):
    """Axis values for the documents, from vectors of a stand-in model."""
    texts = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.seeded_axis(texts, with_model(texts, "text", hash_embedder(64), "embedding", "array<double>").select("id", "embedding"), 8)
