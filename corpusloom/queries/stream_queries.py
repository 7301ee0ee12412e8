"""Incremental runs over the test tables, each as a stream that takes what there is and ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.operators.decisions import hash_embedder, with_model
from corpusloom.operators.ingest import content_hash
from corpusloom.scratch import scratch_path
from corpusloom.streaming import incremental as I


def _stream(spark, rows, name: str):
    """rows as a stream of Parquet files, and the folder they are in."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path), path


def _table(spark, stream, mode: str = "append"):
    """What a stream gives once all there is has been read."""
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


@register("str_embedded", "SELECT 'claim' AS kind, item_id::VARCHAR AS id, sha256(text)[:32] AS hash, 16 AS dim FROM benchmark UNION ALL SELECT 'claim', item_id::VARCHAR, sha256(text || '!')[:32], 16 FROM benchmark WHERE length(text) > 200")
def str_embedded(spark, sf_dir):
    """All texts, then all again of which the long ones have changed: what is new is embedded, in two runs."""
    source, store, checkpoint = (scratch_path(spark, n) for n in ("texts", "store", "checkpoint"))
    base = view(spark, sf_dir, "benchmark").select(F.lit("claim").alias("kind"), F.col("item_id").cast("string").alias("id"), "text")
    again = base.withColumn("text", F.when(F.length("text") > 200, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    for rows in (base, again):
        rows = rows.withColumn("hash", content_hash(F.col("text"))).select("kind", "id", "hash", "text")
        rows.write.mode("append").parquet(source)
        I.embed_new(spark, source, "kind string, id string, hash string, text string", store, checkpoint, lambda df: with_model(df, "text", hash_embedder(16), "embedding", "array<double>")).awaitTermination()
    return spark.read.parquet(store).select("kind", "id", "hash", F.size("embedding").alias("dim"))


@register(
    "str_debounced",
    """WITH e AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY AS gap FROM events), b AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM e)
SELECT user_id AS note_id, min(ts) AS "from", max(ts) AS saved_at, arg_max(event_id, ts) AS version FROM b GROUP BY user_id, burst""",
)
def str_debounced(spark, sf_dir):
    """The last of each burst of events, a burst being ended by a day of quiet; on the table, as the stream would give it at its end."""
    return I.debounced(view(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("ts").alias("at"), F.col("event_id").alias("version")), "1 day")


@register("str_windows", """SELECT date_trunc('day', ts)::TIMESTAMP AS "from", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def str_windows(spark, sf_dir):
    stream, _ = _stream(spark, view(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "events")
    return _table(spark, I.event_windows(stream, "1 day"), "complete").withColumn("total", F.round("total", 4))


@register("str_first_seen", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def str_first_seen(spark, sf_dir):
    """Pairs seen for the first time, with a watermark that is longer than the table."""
    stream, _ = _stream(spark, view(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"), "events")
    return _table(spark, I.first_seen(stream, ["user_id", "event_type"], "ts", "400 days")).agg(F.count("*").alias("n"))


@register("str_resumed", "SELECT p_brand AS query, p_type AS source, count(*) AS n FROM part GROUP BY ALL")
def str_resumed(spark, sf_dir):
    """Pairs of a query and a source done in two runs, the second with what the first had left."""
    parts = view(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), F.col("p_type").alias("source"), "p_partkey")
    manifest, out = scratch_path(spark, "manifest"), scratch_path(spark, "found")
    work = lambda left: parts.join(left, ["query", "source"])
    I.resume(spark, parts.where("source = 'PROMO'"), manifest, work, out)
    I.resume(spark, parts, manifest, work, out)
    if I.resume(spark, parts, manifest, work, out):
        raise AssertionError("nothing was left to do")
    return I.finished(spark, manifest, out).groupBy("query", "source").agg(F.count("*").alias("n"))


_LINKS = "e AS (SELECT DISTINCT src, dst FROM graph WHERE src <> dst), b AS (SELECT * FROM e UNION SELECT dst, src FROM e)"


@register(
    "str_snowball",
    with_views("graph") + f""", {_LINKS}, s AS (SELECT DISTINCT l_suppkey AS p FROM lineitem WHERE l_quantity = 50 AND l_discount = 0 AND l_linenumber = 1), r1 AS (SELECT DISTINCT dst AS p FROM b JOIN s ON src = s.p WHERE dst NOT IN (SELECT p FROM s)),
r2 AS (SELECT DISTINCT dst AS p FROM b JOIN r1 ON src = r1.p WHERE dst NOT IN (SELECT p FROM s) AND dst NOT IN (SELECT p FROM r1)) SELECT p AS paper_id, 1 AS round FROM r1 UNION ALL SELECT p, 2 FROM r2""",
)
def str_snowball(spark, sf_dir):
    seeds = view(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount = 0 and l_linenumber = 1").select(F.col("l_suppkey").alias("paper_id"))
    return I.snowball(seeds, view(spark, sf_dir, "graph"), seeds.limit(0), 2)


@register("str_replay", "SELECT event_id AS seq FROM events WHERE event_id > 100 ORDER BY 1 DESC LIMIT 500")
def str_replay(spark, sf_dir):
    return I.replay(view(spark, sf_dir, "events").select(F.col("event_id").alias("seq")), 100)


@register("str_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def str_latest(spark, sf_dir):
    return I.latest_by(view(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")
