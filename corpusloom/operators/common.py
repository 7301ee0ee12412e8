"""Helpers of the detectors: candidates have a type, cell columns, a statistic, papers, salience and a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signature(kind: str, *keys: str) -> Column:
    """``kind:a=1|b=2`` with keys in order of name."""
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in sorted(keys)]
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("|", *pairs))


def top(candidates: DataFrame, n: int) -> DataFrame:
    """The n most salient; ties by signature."""
    return candidates.orderBy(F.desc("salience"), "signature").limit(n)


def safe_cv(std: Column, mean: Column) -> Column:
    return F.when(mean != 0, std / F.abs(mean)).otherwise(F.lit(0.0))


def first_mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties to the smallest."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by, value).agg(F.count("*").alias("mode_count"))
    order = Window.partitionBy(*by).orderBy(F.desc("mode_count"), value)
    return counts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").withColumnRenamed(value, "mode")


def papers_list(column: str = "paper_id") -> Column:
    """Distinct contributing papers, sorted, as text."""
    return F.array_join(F.transform(F.sort_array(F.collect_set(column)), lambda p: p.cast("string")), ",")
