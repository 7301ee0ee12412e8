"""The queries ``opN_<name>`` of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, class_lm, exact_dedup, langid, mixing, quality, simhash, substring_dedup, topk, warc

#: The public tokenizer that op9 is held against.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.sparse_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_topk(rows.where("id % 100 = 0"), rows, k=10)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op2_exact_topk, op3_source_mixing, op4_language_id, op5_substring_dedup, op6_warc, op7_quality_crf, op8_exact_dedup, op9_bpe, op10_class_lm)
}

_BASE32 = " || ".join(
    f"substr('{warc.BASE32}', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT) >> {shift}) & 31)::INT + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
WITH v AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY embedding) AS nth, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.nth AS own, c.vec_id, c.nth, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.nth <> c.nth WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id, nth) AS rank FROM s) WHERE rank <= 10""",
    "op3_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
r AS (SELECT *, idx % 3 + 1 AS w FROM s),
p AS (SELECT *, sum(ss) OVER () AS t, sum(w) OVER () AS tw,
        coalesce(sum(ss) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS held
      FROM r WINDOW o AS (ORDER BY ss / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (t - 3 * capped)::DOUBLE / (tw - held)::DOUBLE AS share FROM p),
l AS (SELECT share AS level FROM f WHERE share * w <= 3 * ss ORDER BY ss / w, idx LIMIT 1),
g AS (SELECT source, ss, least((3 * ss)::DOUBLE, coalesce((SELECT level FROM l) * w, (3 * ss)::DOUBLE)) AS target FROM r),
q AS (SELECT *, least(round(target)::BIGINT, 3 * ss) AS quota FROM g),
u AS (SELECT *, CASE WHEN ss > 0 THEN quota // ss ELSE 0 END AS passes FROM q),
b AS (SELECT doc_id, source, size, unnest(range((size + 511) // 512)) AS block FROM d WHERE size > 0),
k AS (SELECT doc_id, source, least(512, size - 512 * block) AS n, md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || block::VARCHAR) AS h, block FROM b),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
taken AS (SELECT c.doc_id, sum(passes * n + greatest(0, least(n, quota - passes * ss - before)))::BIGINT AS taken
    FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source GROUP BY c.doc_id)
SELECT d.doc_id, d.size, u.ss AS source_size, u.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN taken ON d.doc_id = taken.doc_id""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20),
g AS (SELECT s.doc_id, s.p, md5(array_to_string(d.w[s.p + 1 : s.p + 20], ' ')) AS h FROM s JOIN d USING (doc_id)),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM d""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
}
