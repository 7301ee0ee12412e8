"""Research-gap detectors over declared axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.common import first_mode, safe_cv, signature, top
from corpusloom.scale import stated

PRACTICE = ("survey", "observational", "case_study")
LITERATURE = ("experimental", "theoretical", "formal", "review")
ASSERTIVE = ("asserts", "validates")
CRITICAL = ("challenges", "extends", "theorises")


def evidence_gap(results: DataFrame, min_papers: int = 2, min_range: float = 0.10, min_cv: float = 0.15, limit: int = 50) -> DataFrame:
    """Results that disagree: (metric, dataset) of at least min_papers papers, unless both range and variation are small.

    One aggregation; deviations are of the population. A null dataset is a group.
    """
    groups = results.groupBy("metric", "dataset").agg(
        F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    spread = groups.withColumn("range", F.col("hi") - F.col("lo")).withColumn("cv", safe_cv(F.col("std"), F.col("mean")))
    found = spread.where((F.col("n_papers") >= max(2, min_papers)) & ~((F.col("range") < min_range) & (F.col("cv") < min_cv)))
    salience = F.col("range") * F.log1p("n_papers")
    return top(found.withColumn("salience", salience).withColumn("signature", signature("evidence", "metric", "dataset")), limit)


def _grid(rows: DataFrame, axes: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Every combination of the axes' values, and the axes; axes are vocabularies, of a size that does not grow with papers."""
    values = [rows.select(a).distinct() for a in axes]
    grid = values[0]
    for v in values[1:]:
        grid = grid.crossJoin(F.broadcast(v))
    return grid, values


def knowledge_gap(rows: DataFrame, axes: list[str], min_neighbours: float = 2.0, limit: int = 50, kind: str = "knowledge") -> DataFrame:
    """Empty cells of the tensor of axes with crowded neighbours.

    A neighbour differs in one axis. Since the cell itself is empty, the sum over
    its neighbours is the sum, over axes, of the marginal with that axis free;
    there is no join of neighbours. The mean is over all neighbours, zeros included.
    """
    for a in axes:
        rows = rows.where(stated(a))
    cells = rows.groupBy(*axes).agg(F.count_distinct("paper_id").alias("n"))
    grid, values = _grid(cells, axes)
    empty = grid.join(cells, axes, "left_anti")
    neighbours = F.lit(-len(axes))
    for v, a in zip(values, axes):
        empty = empty.crossJoin(F.broadcast(v.agg(F.count("*").alias(f"n_{a}"))))
        neighbours = neighbours + F.col(f"n_{a}")
    total, dense = F.lit(0), F.lit(0)
    for a in axes:
        fixed = [x for x in axes if x != a]
        margin = cells.groupBy(*fixed).agg(F.sum("n").alias(f"s_{a}"), F.count("*").alias(f"d_{a}"))
        empty = empty.join(margin, fixed, "left")
        total, dense = total + F.coalesce(f"s_{a}", F.lit(0)), dense + F.coalesce(f"d_{a}", F.lit(0))
    found = empty.withColumn("mean_neighbours", total / neighbours).withColumn("dense_neighbours", dense)
    found = found.where(F.col("mean_neighbours") >= min_neighbours).withColumn("salience", F.col("mean_neighbours") * F.col("dense_neighbours")).withColumn("signature", signature(kind, *axes))
    return top(found.select(*axes, "mean_neighbours", "dense_neighbours", "salience", "signature"), limit)


def population_gap(rows: DataFrame, axes: list[str], min_neighbours: float = 2.0, limit: int = 50) -> DataFrame:
    """:func:`knowledge_gap` over domain and sample."""
    return knowledge_gap(rows, axes, min_neighbours, limit, "population")


def methodological_gap(rows: DataFrame, row_axis: str, column_axis: str, min_row: int = 2, limit: int = 50) -> DataFrame:
    """Unused (row, column) pairs of rows with at least min_row papers; totals are of distinct papers."""
    rows = rows.where(stated(row_axis) & stated(column_axis))
    by_row = rows.groupBy(row_axis).agg(F.count_distinct("paper_id").alias("row_total"))
    by_column = rows.groupBy(column_axis).agg(F.count_distinct("paper_id").alias("column_total"))
    grid = by_row.where(F.col("row_total") >= min_row).crossJoin(F.broadcast(by_column))
    empty = grid.join(rows.select(row_axis, column_axis).distinct(), [row_axis, column_axis], "left_anti")
    found = empty.withColumn("salience", F.col("row_total") * F.greatest(F.lit(1), F.col("column_total"))).withColumn("signature", signature("methodological", row_axis, column_axis))
    return top(found, limit)


def empirical_gap(claims: DataFrame, min_theorises: int = 2, max_validates: int = 0, limit: int = 25) -> DataFrame:
    """Clusters that theorise and do not validate."""
    groups = claims.groupBy("cluster_id").agg(
        F.count_if(F.col("stance") == "theorises").alias("theorises"), F.count_if(F.col("stance") == "validates").alias("validates"), F.count("*").alias("n_claims"), F.count_distinct("paper_id").alias("n_papers")
    )
    found = groups.where((F.col("theorises") >= max(2, min_theorises)) & (F.col("validates") <= max_validates))
    return top(found.withColumn("salience", F.col("theorises") * F.col("n_papers")).withColumn("signature", signature("empirical", "cluster_id")), limit)


def practical_gap(claims: DataFrame, min_side: int = 1, limit: int = 25) -> DataFrame:
    """Clusters on which practice and literature take different stances, by the mode of each side."""
    side = F.when(F.lower("method_family").isin(*PRACTICE), "practice").when(F.lower("method_family").isin(*LITERATURE), "literature")
    sided = claims.withColumn("side", side).where("side is not null").withColumn("stance", F.lower("stance"))
    sizes = sided.groupBy("cluster_id").agg(
        *[f(s).alias(f"{s}_{n}") for s in ("practice", "literature") for n, f in (("claims", lambda s: F.count_if(F.col("side") == s)), ("papers", lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("paper_id")))))]
    )
    modes = first_mode(sided, ["cluster_id", "side"], "stance")
    mode = lambda s: modes.where(F.col("side") == s).select("cluster_id", F.col("mode").alias(f"{s}_mode"))
    both = sizes.where((F.col("practice_claims") >= min_side) & (F.col("literature_claims") >= min_side)).join(mode("practice"), "cluster_id", "left").join(mode("literature"), "cluster_id", "left")
    mismatch = F.lit(False)
    for a, b in (("practice", "literature"), ("literature", "practice")):
        mismatch = mismatch | (F.col(f"{a}_mode").isin(*CRITICAL) & F.col(f"{b}_mode").isin(*ASSERTIVE))
    found = both.where((F.col("practice_mode") != F.col("literature_mode")) | mismatch)
    salience = F.least("practice_papers", "literature_papers") * F.greatest("practice_claims", "literature_claims")
    return top(found.withColumn("salience", salience).withColumn("signature", signature("practical", "cluster_id")), limit)


def theoretical_gap(papers: DataFrame, categories: DataFrame, anchors: DataFrame, challenges: DataFrame, orphan_ratio: float = 3, disputed: float = 0.25, min_papers: int = 2, limit: int = 50) -> DataFrame:
    """Categories with few frameworks to their papers, and frameworks that many of their papers challenge.

    anchors: (paper_id, canonical) of the anchor kinds; challenges: (paper_id, verdict).
    """
    c = categories.join(papers.select("paper_id"), "paper_id", "left_semi")
    per = c.join(anchors, "paper_id", "left").groupBy("category").agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("canonical").alias("n_frameworks"))
    ratio = F.col("n_papers") / F.greatest(F.lit(1), F.col("n_frameworks"))
    orphan = per.withColumn("ratio", ratio).where((F.col("ratio") >= orphan_ratio) & (F.col("n_papers") >= min_papers))
    orphan = orphan.select(F.lit("orphan").alias("reason"), F.col("category").alias("name"), "n_papers", "ratio", (F.col("n_papers") * (F.col("ratio") / orphan_ratio)).alias("salience"))
    used = anchors.select("paper_id", "canonical").distinct().join(papers.select("paper_id"), "paper_id", "left_semi").join(challenges, "paper_id", "left")
    counts = used.groupBy("canonical").agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct(F.when(F.col("verdict") == "confirmed", F.col("paper_id"))).alias("n_against"))
    against = counts.withColumn("ratio", F.col("n_against") / F.col("n_papers")).where((F.col("ratio") >= disputed) & (F.col("n_papers") >= min_papers))
    against = against.select(F.lit("disputed").alias("reason"), F.col("canonical").alias("name"), "n_papers", "ratio", (F.col("n_against") * F.col("ratio") * 10).alias("salience"))
    return top(orphan.unionByName(against).withColumn("signature", signature("theoretical", "reason", "name")), limit)
