"""Entity resolution, fuzzy joins and duplicate tests over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.functions import text as T
from corpusloom.operators import entities as E
from corpusloom.queries.gap_queries import rounded

_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{{n},}}')) AS w FROM {t}"
_NAMES = f"r AS ({_WORDS.format(n=9, t='conversations')}), e AS (SELECT w, row_number() OVER (ORDER BY w) AS ord FROM ({_WORDS.format(n=9, t='benchmark')}))"
_SIMILAR = "1 - damerau_levenshtein(r.w, {f}) / greatest(length(r.w), length({f}))"


def _words(spark, sf_dir, table, least=9):
    text = F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return view(spark, sf_dir, table).select(F.explode(text).alias("name")).distinct()


def _entries(spark, sf_dir):
    """Words of the benchmark; an alias is the word with another ending, and a version after it."""
    words = _words(spark, sf_dir, "benchmark")
    alias = F.array(F.concat(F.expr("substring(name, 1, length(name) - 3)"), F.lit("xyz")), F.concat("name", F.lit(" v2.1")))
    return words.select(F.col("name").alias("canonical"), alias.alias("aliases"), F.col("name").alias("ord"))


@register("er_fuzzy_join", f"WITH {_NAMES}, s AS (SELECT r.w AS l, e.w AS r, round({_SIMILAR.format(f='e.w')}, 6) AS score FROM r JOIN e ON abs(length(r.w) - length(e.w)) <= 0.15 * greatest(length(r.w), length(e.w))) SELECT * FROM s WHERE score >= 0.85")
def er_fuzzy_join(spark, sf_dir):
    left, right = _words(spark, sf_dir, "conversations"), _words(spark, sf_dir, "benchmark")
    return rounded(E.fuzzy_join(left.select(F.col("name").alias("l")), right.select(F.col("name").alias("r")), 0.85), "score")


@register(
    "er_canonicalise",
    f"""WITH {_NAMES}, f AS (SELECT w AS form, w AS canonical, 0 AS alias FROM e UNION ALL SELECT substr(w, 1, length(w) - 3) || 'xyz', w, 1 FROM e),
s AS (SELECT r.w AS name, canonical, alias, {_SIMILAR.format(f='form')} AS score FROM r JOIN f ON abs(length(r.w) - length(form)) <= 0.15 * greatest(length(r.w), length(form))),
b AS (SELECT * FROM s WHERE score >= 0.85 - 1e-12 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, alias, canonical) = 1)
SELECT r.w AS name, canonical, CASE WHEN score = 1 THEN 'exact' WHEN score IS NULL THEN 'low_confidence' ELSE 'edit' END AS status, round(coalesce(score, 0), 6) AS score FROM r LEFT JOIN b ON r.w = b.name""",
)
def er_canonicalise(spark, sf_dir):
    found = E.canonicalise(_words(spark, sf_dir, "conversations"), _entries(spark, sf_dir))
    return rounded(found, "score").select("name", "canonical", "status", "score")


@register("er_canonicalise_or_add")
def er_canonicalise_or_add(spark, sf_dir):
    names = _words(spark, sf_dir, "conversations").withColumn("ord", F.col("name"))
    return E.canonicalise_or_add(names, _entries(spark, sf_dir))


@register("er_vector", """WITH u AS (SELECT vec_id, label, [x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings),
s AS (SELECT 'n' || a.vec_id AS name, 'n' || b.vec_id AS canonical, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label >= 5 AND b.label < 5),
b AS (SELECT * FROM s WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, substr(canonical, 2)::BIGINT) = 1)
SELECT 'n' || vec_id AS name, b.score, CASE WHEN label < 5 THEN 'exact' WHEN score IS NULL THEN 'low_confidence' ELSE 'embedding' END AS status FROM u LEFT JOIN b ON b.name = 'n' || vec_id""")
def er_vector(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("text"), "embedding", "vec_id", "label")
    entries = rows.where("label < 5").select(F.col("text").alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.col("vec_id").alias("ord"))
    found = E.canonicalise(rows.select(F.col("text").alias("name")), entries, least_edit=1.0, least_cosine=0.35, vectors=rows.select("text", "embedding"))
    return rounded(found, "score").select("name", "status", F.when(F.col("status") == "embedding", F.col("score")).alias("score"))


@register("er_entity_forms", r"""WITH p AS (SELECT DISTINCT p_name || ' v' || (p_size % 4) || '.' || (p_size % 7) AS raw, p_name FROM part) SELECT raw, trim(regexp_replace(p_name, '[^a-z0-9 ]', ' ', 'g')) AS normalised FROM p""")
def er_entity_forms(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" v"), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"))
    return view(spark, sf_dir, "part").select(raw.alias("raw")).distinct().select("raw", T.normalise_entity(F.col("raw")).alias("normalised"))


_TITLE = r"list_sort(list_distinct([w FOR w IN string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' ') IF w <> '']))"
_JACCARD = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


@register("txt_similar_titles", with_views("texts") + f", t AS (SELECT DISTINCT {_TITLE.format(c='title')} AS t FROM texts WHERE triage_label <> ''), u AS (SELECT paper_id, {_TITLE.format(c='title')} AS t FROM texts WHERE triage_label = ''), m AS (SELECT DISTINCT u.t FROM (SELECT DISTINCT t FROM u WHERE len(t) > 0) u JOIN (SELECT t FROM t WHERE len(t) > 0) t ON {_JACCARD.format(a='u.t', b='t.t')} >= 0.85) SELECT paper_id, CASE WHEN m.t IS NULL THEN NULL ELSE 'title' END AS matched_by FROM u LEFT JOIN m USING (t)")
def txt_similar_titles(spark, sf_dir):
    rows = view(spark, sf_dir, "texts").select("paper_id", "title", "triage_label")
    return E.existing(rows.where("triage_label = ''"), rows.where("triage_label <> ''"), [], "title").select("paper_id", "matched_by")


@register("txt_fuzzy_titles")
def txt_fuzzy_titles(spark, sf_dir):
    return E.deduplicate_titles(view(spark, sf_dir, "texts").select(F.col("paper_id").alias("id"), "title"))


@register(
    "merge_existing",
    "WITH c AS (SELECT o_orderkey AS id, o_orderkey AS doi, o_custkey AS arxiv FROM orders WHERE o_orderpriority = '1-URGENT'), k AS (SELECT o_orderkey + 5 AS doi, o_custkey AS arxiv FROM orders WHERE o_orderpriority = '5-LOW') SELECT id, CASE WHEN doi IN (SELECT doi FROM k) THEN 'doi' WHEN arxiv IN (SELECT arxiv FROM k) THEN 'arxiv' END AS matched_by FROM c",
)
def merge_existing(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    candidates = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doi"), F.col("o_custkey").alias("arxiv"))
    corpus = orders.where("o_orderpriority = '5-LOW'").select((F.col("o_orderkey") + 5).alias("doi"), F.col("o_custkey").alias("arxiv"))
    return E.existing(candidates, corpus, ["doi", "arxiv"]).select("id", "matched_by")
