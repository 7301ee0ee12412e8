"""A corpus pipeline of five stages, each one of the operators in ``corpusloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
it as Parquet in the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import bpe, exact_dedup, langid, mixing, simhash
from corpusloom.llm.common import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; ``und`` and those without any evidence go."""
    rows = docs.select(*COLUMNS)
    filters = langid.train(rows)
    found = langid.predict(rows, filters, keep_text=True)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0)).select(*COLUMNS)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return _keep(docs, exact_dedup.exact_dedup(docs).where("kept").select(_row_key(F.col("text_sha256")).alias("key")))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each component of five-word shingle similarity 0.8 and more."""
    found = simhash.similar_dedup(docs.select("doc_id", "text", _row_key(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("key")))
    return _keep(docs, found.where("kept").select("key"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, as documents."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_ok of each document of the mix."""
    import public_tokenizers

    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _row_key(text_sha256: Column) -> Column:
    """Tells rows apart by id, null included, and by text up to white space; rows that agree in both are interchangeable."""
    return F.concat(text_sha256, F.lit(":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each key in kept; of rows that repeat a key, one stays."""
    keyed = docs.select(*COLUMNS, _row_key(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("key"))
    one = Window.partitionBy("key").orderBy(F.lit(0))
    return keyed.join(kept.distinct(), "key", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*COLUMNS)


STAGES = [("language", stage_language), ("exact", stage_exact), ("simhash", stage_simhash), ("mix", stage_mix), ("bpe", stage_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
        if last is not None:
            discard(last)
        docs = last = out
    return docs
