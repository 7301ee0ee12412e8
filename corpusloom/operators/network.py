"""Citation networks and time: edges are (src, dst), a row for each citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.common import top
from corpusloom.scratch import cut_lineage


def shared_pairs(edges: DataFrame, of: str, by: str, min_strength: int, hub: int = 1000) -> DataFrame:
    """(a, b, strength): pairs of ``of`` with at least min_strength distinct ``by`` in common.

    A self-join on ``by`` after distinct; only ``of`` that could reach min_strength at all take part. A ``by`` of more than ``hub``
    is dealt over several tasks: one side by a salt, the other to each of its salts.
    """
    pairs = edges.select(F.col(of).alias("x"), F.col(by).alias("k")).where("x is not null and k is not null").distinct()
    if min_strength > 1:
        enough = pairs.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= min_strength).select("x")
        pairs = pairs.join(enough, "x", "left_semi")
    degree = pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / hub).cast("int").alias("salts"))
    pairs = cut_lineage(pairs.join(degree, "k"), "pairs")
    left = pairs.select(F.col("x").alias("a"), "k", F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"))
    right = pairs.select(F.col("x").alias("b"), "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["k", "salt"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("strength")).where(F.col("strength") >= min_strength)


def co_citation(edges: DataFrame, min_strength: int = 2, limit: int = 40) -> DataFrame:
    """Papers that are cited together."""
    return shared_pairs(edges, "dst", "src", min_strength).orderBy(F.desc("strength"), "a", "b").limit(limit)


def bibliographic_coupling(edges: DataFrame, min_strength: int = 2, limit: int = 40) -> DataFrame:
    """Papers that cite the same papers."""
    return shared_pairs(edges, "src", "dst", min_strength).orderBy(F.desc("strength"), "a", "b").limit(limit)


def pagerank(edges: DataFrame, damping: float = 0.85, max_rounds: int = 30, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank), summing to 1; parallel edges count each, dangling mass goes to all.

    A round is one join on the source and one aggregation on the target; lineage
    is cut every few rounds. tolerance None runs max_rounds.
    """
    weighted = cut_lineage(edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("w")), "pagerank-edges")
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    nodes = cut_lineage(weighted.select(F.col("src").alias("node")).union(weighted.select(F.col("dst").alias("node"))).distinct().join(out, F.col("node") == F.col("src"), "left").select("node", "out"), "pagerank-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, max_rounds + 1):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("dangling"))
        moved = weighted.join(ranks.select(F.col("node").alias("src"), "out", "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w") / F.col("out")).alias("got"))
        fresh = nodes.join(moved, "node", "left").crossJoin(F.broadcast(dangling))  # one row
        fresh = fresh.select("node", "out", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("dangling") / n)).alias("rank"))
        if tolerance is None and step % 4 and step < max_rounds:
            ranks = fresh
            continue
        fresh = cut_lineage(fresh, "pagerank")
        done = tolerance is not None and fresh.alias("f").join(ranks.alias("r"), "node").agg(F.sum(F.abs(F.col("f.rank") - F.col("r.rank")))).first()[0] < tolerance
        ranks = fresh
        if done:
            break
    return ranks.select("node", "rank")


def triangulation(edges: DataFrame, corpus: DataFrame, min_citing: int = 2, limit: int = 30) -> DataFrame:
    """Works outside the corpus that at least min_citing included papers cite. corpus: (paper_id, triage_label)."""
    citing = edges.join(corpus.where("triage_label = 'include'").select(F.col("paper_id").alias("src")), "src", "left_semi")
    outside = citing.join(corpus.select(F.col("paper_id").alias("dst")), "dst", "left_anti")
    return outside.groupBy("dst").agg(F.count_distinct("src").alias("n_citing")).where(F.col("n_citing") >= min_citing).orderBy(F.desc("n_citing"), "dst").limit(limit)


def rerank(candidates: DataFrame, contributors: DataFrame, edges: DataFrame) -> DataFrame:
    """Salience times the mean of 1 + ln(1 + in-degree) over contributing papers; 1 without any.

    contributors: (signature, paper_id).
    """
    degree = edges.groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("n"))
    weight = contributors.join(degree, "paper_id", "left").groupBy("signature").agg(F.avg(1 + F.log1p(F.coalesce("n", F.lit(0)))).alias("weight"))
    return candidates.join(weight, "signature", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("reranked", F.col("salience") * F.col("weight"))


def coherence(candidates: DataFrame, min_types: int = 3) -> DataFrame:
    """Papers among the candidates of at least min_types detectors. candidates: (type, paper_id)."""
    found = candidates.groupBy("paper_id").agg(F.count_distinct("type").alias("n_types"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    return found.where(F.col("n_types") >= min_types)


def main_path(edges: DataFrame, years: DataFrame, max_length: int = 30) -> DataFrame:
    """(step, src, dst, spc): the main path by search path counts. years: (node, year).

    Only citations from a later year to an earlier one count, so the graph has no
    cycle, and paths are counted in one round for each year. The chain starts at
    the heaviest edge (ties: smaller ids) and is extended greedily at both ends.
    """
    y = years.select("node", "year")
    e = edges.select("src", "dst").distinct().join(y.toDF("src", "sy"), "src").join(y.toDF("dst", "dy"), "dst").where("sy > dy")
    e = cut_lineage(e, "path-edges")
    nodes = e.select(F.col("src").alias("node"), F.col("sy").alias("year")).union(e.select("dst", "dy")).distinct()
    order = [r["year"] for r in nodes.select("year").distinct().orderBy("year").collect()]  # a row for each year

    def counts(frm: str, to: str, frm_year: str, sequence: list) -> DataFrame:
        """Paths between a node and the ends of the graph, along frm -> to; years in an order in which to precedes frm."""
        done = None
        for year in sequence:
            here = nodes.where(F.col("year") == year).select("node")
            if done is not None:
                into = e.where(F.col(frm_year) == year).join(done.toDF(to, "p"), to).groupBy(F.col(frm).alias("node")).agg(F.sum("p").alias("p"))
                here = here.join(into, "node", "left")
            else:
                here = here.withColumn("p", F.lit(None).cast("double"))
            here = here.select("node", F.coalesce("p", F.lit(1.0)).alias("p"))  # without a way on, the node is an end
            done = cut_lineage(here if done is None else done.union(here), "path-counts")
        return done

    if not order:
        return edges.sparkSession.createDataFrame([], "step int, src long, dst long, spc double")
    after = counts("src", "dst", "sy", order).toDF("dst", "after")
    before = counts("dst", "src", "dy", order[::-1]).toDF("src", "before")
    spc = cut_lineage(e.join(before, "src").join(after, "dst").select("src", "dst", (F.col("before") * F.col("after")).alias("spc")), "path-spc")
    chain = spc.orderBy(F.desc("spc"), "src", "dst").limit(1).collect()
    while chain and len(chain) < max_length:
        ahead = spc.where(F.col("src") == chain[-1]["dst"]).orderBy(F.desc("spc"), "dst").limit(1).collect()
        back = spc.where(F.col("dst") == chain[0]["src"]).orderBy(F.desc("spc"), "src").limit(1).collect() if len(chain) + len(ahead) < max_length else []
        if not ahead and not back:
            break
        chain = back + chain + ahead
    return edges.sparkSession.createDataFrame([(i, r["src"], r["dst"], r["spc"]) for i, r in enumerate(chain)], "step int, src long, dst long, spc double")


def temporal_trends(usage: DataFrame, current_year: int, recent_years: int = 3, min_total: int = 4, emerging: float = 0.6, declining: float = 0.6, limit: int = 100) -> DataFrame:
    """Emerging, declining and accelerating values of rows (axis, value, paper_id, year).

    Year buckets count rows and totals count papers. Accelerating: the last three
    observed years rise strictly.
    """
    rows = usage.where("value is not null and value <> '' and year is not null")
    totals = rows.groupBy("axis", "value").agg(F.count_distinct("paper_id").alias("total"))
    years = rows.groupBy("axis", "value", "year").agg(F.count("*").alias("n"))
    order = Window.partitionBy("axis", "value").orderBy(F.desc("year"))
    ranked = years.withColumn("nth", F.row_number().over(order))
    last = ranked.groupBy("axis", "value").agg(
        F.sum(F.when(F.col("year") > current_year - recent_years, F.col("n")).otherwise(0)).alias("recent"), *[F.max(F.when(F.col("nth") == i, F.col("n"))).alias(f"y{i}") for i in (1, 2, 3)]
    )
    t = totals.join(last, ["axis", "value"]).withColumn("recent_fraction", F.col("recent") / F.col("total"))
    t = t.where(F.col("total") >= min_total)
    rising = (F.col("total") >= 4) & (F.col("recent_fraction") >= emerging)
    falling = (F.col("total") >= 4) & (1 - F.col("recent_fraction") >= declining) & ~rising
    accelerating = F.coalesce((F.col("y1") > F.col("y2")) & (F.col("y2") > F.col("y3")), F.lit(False))
    trend = F.when(rising, "emerging").when(falling, "declining").when(accelerating, "accelerating")
    weight = F.when(F.col("trend") == "emerging", 1.5).when(F.col("trend") == "declining", 1.0).otherwise(1.2)
    found = t.withColumn("trend", trend).where("trend is not null").withColumn("salience", F.col("total") * weight)
    found = found.withColumn("signature", F.concat_ws("|", F.concat(F.lit("temporal:axis="), "axis"), F.concat(F.lit("value="), "value")))
    return top(found.select("axis", "value", "trend", "total", "recent", "recent_fraction", "salience", "signature"), limit)
