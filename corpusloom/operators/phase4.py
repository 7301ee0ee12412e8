"""Gap detectors over emergent clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.common import first_mode, safe_cv, signature, top


def evidence(results: DataFrame, min_papers: int = 2, min_cv: float = 0.10) -> DataFrame:
    """Values of one metric and dataset that vary; n_papers counts rows."""
    groups = results.where("dataset is not null and dataset <> ''").groupBy("metric", "dataset").agg(
        F.count("*").alias("n_papers"), F.count("value").alias("n_values"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    found = groups.withColumn("cv", safe_cv(F.col("std"), F.col("mean"))).where((F.col("n_papers") >= min_papers) & (F.col("n_values") >= min_papers) & (F.col("cv") >= min_cv))
    return found.select("metric", "dataset", "n_papers", "cv", F.round(F.col("n_papers") * F.col("cv") * 10, 2).alias("salience"), signature("evidence", "metric", "dataset").alias("signature"))


def _cells(papers: DataFrame) -> DataFrame:
    return papers.where("paper_cluster_id is not null and method_cluster_id is not null").groupBy("paper_cluster_id", "method_cluster_id").agg(F.count("*").alias("n"))


def knowledge(papers: DataFrame, min_neighbours: int = 2) -> DataFrame:
    """Pairs of a topic and a method cluster that no paper has, both of which papers have."""
    cells = _cells(papers)
    rows = cells.groupBy("paper_cluster_id").agg(F.sum("n").alias("row_density"))
    columns = cells.groupBy("method_cluster_id").agg(F.sum("n").alias("column_density"))
    empty = rows.crossJoin(F.broadcast(columns)).join(cells, ["paper_cluster_id", "method_cluster_id"], "left_anti")
    found = empty.withColumn("neighbours", F.col("row_density") + F.col("column_density")).where(F.col("neighbours") >= min_neighbours)
    return found.withColumn("salience", F.round(F.col("neighbours") / 2, 2)).withColumn("signature", signature("knowledge", "paper_cluster_id", "method_cluster_id"))


def methodological(papers: DataFrame, min_size: int = 2) -> DataFrame:
    """Methods that a topic does not use, both of at least min_size papers."""
    topics = papers.where("paper_cluster_id is not null").groupBy("paper_cluster_id").agg(F.count("*").alias("topic_size"))
    methods = papers.where("method_cluster_id is not null").groupBy("method_cluster_id").agg(F.count("*").alias("method_size"))
    pairs = topics.where(F.col("topic_size") >= min_size).crossJoin(F.broadcast(methods.where(F.col("method_size") >= min_size)))
    unused = pairs.join(_cells(papers), ["paper_cluster_id", "method_cluster_id"], "left_anti")
    return unused.withColumn("salience", F.round(F.col("topic_size") * F.col("method_size") / 10, 2)).withColumn("signature", signature("methodological", "paper_cluster_id", "method_cluster_id"))


def empirical(claims: DataFrame, min_theorises: int = 2) -> DataFrame:
    """Claim clusters that theorise and never validate."""
    groups = claims.groupBy("cluster_id").agg(F.count_if(F.col("stance") == "theorises").alias("theorises"), F.count_if(F.col("stance") == "validates").alias("validates"), F.count_distinct("paper_id").alias("n_papers"))
    found = groups.where((F.col("theorises") >= min_theorises) & (F.col("validates") == 0))
    return found.withColumn("salience", F.round(F.col("theorises") * 1.5, 2)).withColumn("signature", signature("empirical", "cluster_id"))


def theoretical(claims: DataFrame, min_findings: int = 2, max_ratio: float = 0.1) -> DataFrame:
    """Topics with findings and hardly a framework."""
    groups = claims.where("topic is not null").groupBy("topic").agg(F.count_if(F.col("claim_type") == "finding").alias("findings"), F.count_if(F.col("claim_type") == "framework").alias("frameworks"))
    found = groups.withColumn("ratio", F.try_divide("frameworks", "findings")).where((F.col("findings") >= min_findings) & (F.col("ratio") <= max_ratio))
    return found.withColumn("salience", F.round((F.col("findings") - F.col("frameworks")) * 0.5, 2)).withColumn("signature", signature("theoretical", "topic"))


def population(mentions: DataFrame, topics: DataFrame, pattern: str) -> DataFrame:
    """Populations that a topic never mentions though other topics do.

    mentions: (paper_id, label); topics: (paper_id, topic); pattern picks the labels that are populations.
    """
    used = mentions.where(F.col("label").rlike(pattern)).select("paper_id", "label").distinct().join(topics, "paper_id")
    totals = used.groupBy("label").agg(F.count_distinct("paper_id").alias("mentions"))
    grid = topics.select("topic").distinct().crossJoin(F.broadcast(totals))
    uncovered = grid.join(used.select("topic", "label").distinct(), ["topic", "label"], "left_anti")
    return uncovered.withColumn("salience", F.round(F.col("mentions") * 0.5, 2)).withColumn("signature", signature("population", "topic", "label"))


def practical(claims: DataFrame, supportive: tuple[str, ...] = ("validates", "asserts", "extends")) -> DataFrame:
    """Claim clusters that some topics mostly support and others mostly challenge."""
    modes = first_mode(claims.where("topic is not null"), ["cluster_id", "topic"], "stance")
    sides = modes.groupBy("cluster_id").agg(F.count("*").alias("topics"), F.count_if(F.col("mode").isin(*supportive)).alias("supporting"), F.count_if(F.col("mode") == "challenges").alias("challenging"))
    found = sides.where("topics >= 2 and supporting > 0 and challenging > 0").join(claims.groupBy("cluster_id").agg(F.count_distinct("paper_id").alias("n_papers")), "cluster_id")
    return found.withColumn("salience", F.round(F.col("n_papers") * 0.8, 2)).withColumn("signature", signature("practical", "cluster_id"))


def run(detectors: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The most salient candidates of all detectors: type, signature, salience."""
    parts = [df.select(F.lit(kind).alias("type"), "signature", F.col("salience").cast("double").alias("salience")) for kind, df in detectors.items()]
    return top(reduce(DataFrame.unionByName, parts), limit)
