"""Aggregated reports over the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.scale import eligible
from corpusloom.scratch import cut_lineage


def field_coverage(papers: DataFrame, fields: DataFrame) -> DataFrame:
    """Of eligible papers, how many have each field: any value, and one that is not unknown; percentages to two places."""
    chosen = papers.where(eligible()).select("paper_id")
    total = chosen.agg(F.count("*").alias("n_eligible"))
    rows = fields.join(chosen, "paper_id", "left_semi")
    filled = F.col("field_value").isNotNull() & (F.col("field_value") != "")
    per = rows.groupBy("field_name").agg(
        F.count_distinct(F.when(filled, F.col("paper_id"))).alias("n_filled"), F.count_distinct(F.when(filled & (F.col("field_value") != "unknown"), F.col("paper_id"))).alias("n_known")
    )
    out = per.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("pct_filled", F.round(F.try_divide(100 * F.col("n_filled"), "n_eligible"), 2)).withColumn("pct_known", F.round(F.try_divide(100 * F.col("n_known"), "n_eligible"), 2))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])


def label_summary(papers: DataFrame) -> DataFrame:
    return papers.groupBy(F.coalesce(F.nullif("triage_label", F.lit("")), F.lit("pending")).alias("label")).agg(F.count("*").alias("n"))


def matrix(papers: DataFrame, categories: DataFrame, methods: DataFrame) -> DataFrame:
    """Category by method with row, column and grand totals: a cube. Totals count distinct papers, so they are no sums of cells.

    n_accepted counts include papers alone. ``level``: 0 cell, 1 row total, 2 column total, 3 grand total.
    """
    rows = papers.where(eligible()).join(categories, "paper_id").join(methods, "paper_id")
    return rows.cube("category", "method").agg(
        F.grouping_id().cast("int").alias("level"), F.count_distinct("paper_id").alias("n_papers"), F.count_distinct(F.when(F.col("triage_label") == "include", F.col("paper_id"))).alias("n_accepted")
    )


def corpus_index(usage: DataFrame, kind: str) -> DataFrame:
    """Names of a kind with their papers and mentions; most papers first."""
    return usage.where(F.col("kind") == kind).groupBy("canonical").agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_mentions")).orderBy(F.desc("n_papers"), "canonical")


def validate_categories(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(category, status): declared and unused, or used and undeclared."""
    d, u = declared.select("category").distinct(), used.select("category").where("category is not null").distinct()
    return d.join(u, "category", "left_anti").withColumn("status", F.lit("unused")).union(u.join(d, "category", "left_anti").withColumn("status", F.lit("undeclared")))


def prisma(searches: DataFrame, papers: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: the funnel from records found to papers read. searches: (source, result_count)."""
    found = searches.agg(F.coalesce(F.sum("result_count"), F.lit(0)).alias("identified"), F.count("*").alias("queries"), F.count_distinct("source").alias("sources"))
    label = lambda *x: F.count_if(F.col("triage_label").isin(*x))
    screened = papers.agg(F.count("*").alias("records"), label("include").alias("included"), label("maybe").alias("maybe"), label("exclude").alias("excluded"), F.count_if(F.coalesce("triage_label", F.lit("")) == "").alias("pending"))
    read = notes.join(papers.where(eligible()), "paper_id", "left_semi").agg(F.count_distinct("paper_id").alias("read"))
    return found.crossJoin(screened).crossJoin(read)  # one row each


def exclusion_reasons(papers: DataFrame, limit: int = 5) -> DataFrame:
    """First clause of the reason, in lower case, 80 characters at most; the most frequent."""
    head = F.substring(F.lower(F.trim(F.split("reason", "[.,;]")[0])), 1, 80)
    rows = papers.where("triage_label = 'exclude' and reason is not null and reason <> ''").select(head.alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def verdicts(indicators: DataFrame) -> DataFrame:
    """(candidate_id, verdict) from rows of (candidate_id, status): a FAIL or four PARTIAL reject, seven PASS accept, else refine."""
    count = lambda s: F.count_if(F.upper("status") == s)
    n = indicators.groupBy("candidate_id").agg(count("FAIL").alias("n_fail"), count("PARTIAL").alias("n_partial"), count("PASS").alias("n_pass"))
    rule = F.when((F.col("n_fail") > 0) | (F.col("n_partial") >= 4), "reject").when(F.col("n_pass") >= 7, "accept").when(F.col("n_partial") + F.col("n_pass") >= 1, "refine").otherwise("pending")
    return n.withColumn("verdict", rule)


def round_robin(items: DataFrame, group: str, rank: list, limit: int) -> DataFrame:
    """The best of each group, then the second best, and so on."""
    order = Window.partitionBy(group).orderBy(*rank)
    return items.withColumn("turn", F.row_number().over(order)).orderBy("turn", group).limit(limit)


def catalogue(papers: DataFrame, categories: DataFrame, per_chapter: int = 50) -> DataFrame:
    """Chapters by number of papers; in each the newest papers. chapter is the chapter's place, from 1."""
    rows = papers.where(eligible()).join(categories, "paper_id")
    sizes = rows.groupBy("category").agg(F.count_distinct("paper_id").alias("n_papers"))
    numbered = sizes.withColumn("chapter", F.row_number().over(Window.orderBy(F.desc("n_papers"), "category")))  # a row for each category
    place = Window.partitionBy("category").orderBy(F.desc_nulls_last("year"), "paper_id")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_chapter).join(F.broadcast(numbered), "category").select("chapter", "category", "n_papers", "place", "paper_id", "year")


def uncategorised(papers: DataFrame, categories: DataFrame) -> DataFrame:
    return papers.where(eligible()).join(categories, "paper_id", "left_anti").select("paper_id", "year")


def at_places(values: DataFrame, column: str, group: str, places: DataFrame, n_bins: int = 1024) -> DataFrame:
    """(group, place, column): each group's value in a place, from 0, of the ascending order; places (group, place).

    Equal values are counted first. Each group's range is cut into bins; running sums over the bins tell which one a place falls into, and
    only the values of those bins are sorted. Nulls do not count.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    span = counts.groupBy(group).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(n_bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins))).otherwise(0).cast("int")
    binned = cut_lineage(counts.join(F.broadcast(span), group).select(group, column, "n", bin_.alias("bin")), "places")
    sums = binned.groupBy(group, "bin").agg(F.sum("n").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(group).orderBy("bin"))).select(group, "bin", (F.col("upto") - F.col("n")).alias("before"), "upto")
    asked = places.join(upto, group).where("place >= before and place < upto").select(group, "place", "bin", "before")
    order = Window.partitionBy(group, "place").orderBy(column)
    inside = binned.join(F.broadcast(asked), [group, "bin"]).withColumn("end", F.sum("n").over(order) + F.col("before"))  # a few places a group
    return inside.where("place < end and place >= end - n").select(group, "place", column)


def quantiles(values: DataFrame, column: str, group: str, p: float) -> DataFrame:
    """Three definitions: interpolated, by floor of the index, and the upper median."""
    n = cut_lineage(values.where(F.col(column).isNotNull()).groupBy(group).agg(F.count("*").alias("n")), "quantiles")
    of = {"floor_index": F.least(F.col("n") - 1, F.floor(F.col("n") * p)), "upper_median": F.floor(F.col("n") / 2), "lower": F.floor((F.col("n") - 1) * p), "upper": F.ceil((F.col("n") - 1) * p)}
    places = n.select(group, F.explode(F.array_distinct(F.array(*[c.cast("long") for c in of.values()]))).alias("place"))
    found = at_places(values, column, group, places)
    at = n.join(found, group).groupBy(group, "n").agg(*[F.max(F.when(F.col("place") == c.cast("long"), F.col(column))).alias(k) for k, c in of.items()])
    part = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    return at.select(group, "floor_index", "upper_median", (F.col("lower") + part * (F.col("upper") - F.col("lower"))).alias("interpolated"))


def histogram(values: DataFrame, column: str, lo: float, hi: float, width: float) -> DataFrame:
    """(bin, n) for every bin of [lo, hi); what lies outside goes to the nearest."""
    n_bins = round((hi - lo) / width)
    bins = values.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    place = F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.floor((F.col(column) - lo) / width))).cast("int")
    counts = values.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Precision and recall of score >= threshold, for each threshold, in one pass."""
    counts = scored.agg(
        *[f(t).alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, f in (("tp", lambda t: F.count_if((F.col(score) >= t) & F.col(truth))), ("fp", lambda t: F.count_if((F.col(score) >= t) & ~F.col(truth))), ("fn", lambda t: F.count_if((F.col(score) < t) & F.col(truth))))]
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn")) for i, t in enumerate(thresholds)])
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def min_max(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``scaled``: to 0..1, 1 where all are equal."""
    span = values.groupBy(*(by or [])).agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    joined = values.join(span, by) if by else values.crossJoin(F.broadcast(span))  # one row
    scaled = F.when(F.col("hi_") == F.col("lo_"), 1.0).otherwise((F.col(column) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))
    return joined.withColumn("scaled", scaled).select(*values.columns, "scaled")


def character_budget(chunks: DataFrame, paper: str, order: list, text: str, budget: int) -> DataFrame:
    """The leading chunks of each paper within a budget of characters; the one that crosses it is cut short."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(paper).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = chunks.withColumn("before", before).where(F.col("before") < budget)
    return cut.withColumn("taken", F.least(F.length(text), F.lit(budget) - F.col("before"))).drop("before")
