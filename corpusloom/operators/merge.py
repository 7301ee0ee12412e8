"""De-duplication and upserts of bibliographic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def longest(column: str, order: str) -> Column:
    """The longest trimmed value of a group; of equals the first by ``order``."""
    value = F.trim(F.col(column))
    return F.max_by(value, F.struct(F.length(F.coalesce(value, F.lit(""))), -F.col(order)))


def merge_by_key(rows: DataFrame, key: str, order: str, fields: list[str], source: str) -> DataFrame:
    """One row for each key: the longest value of each field, and the sources joined by +, sorted."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[longest(f, order).alias(f) for f in fields], F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(source, r"\+"))))), "+").alias(source), F.count("*").alias("n_merged")
    )


def new_rows(candidates: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that share none of the keys with the corpus; a null key matches nothing."""
    out = candidates
    for k in keys:
        out = out.join(corpus.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return out.select(*candidates.columns)


def fill_blanks(rows: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with their blank fields filled from extra, which has one row for each key."""
    e = extra.select(key, *[F.col(f).alias(f"extra_{f}") for f in fields])
    joined = rows.join(e, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"extra_{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions the change stands."""
    both = current.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(version), F.desc("is_change"))
    return both.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "is_change")


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper_id, label, status): what becomes of each decision (paper_id, label) on rows (paper_id, triage_label)."""
    joined = decisions.join(rows.select("paper_id", "triage_label", F.lit(True).alias("known")), "paper_id", "left")
    status = F.when(F.col("known").isNull(), "unknown row").when(~F.col("label").isin("include", "exclude", "maybe"), "invalid label").when(F.coalesce("triage_label", F.lit("")) != "", "skipped").otherwise("applied")
    return joined.select("paper_id", "label", status.alias("status"))
