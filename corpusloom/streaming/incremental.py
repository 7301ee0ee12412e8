"""Work that follows new rows: embedding what has changed, the latest of many saves, growing a corpus along its citations, resuming after an interruption.

All run on ``trigger(availableNow=True)`` unless told otherwise, so that a run does what there is and ends; what was read is in the
checkpoint, and what was written is found by its key, so a run that was killed is simply started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

from corpusloom import scratch


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if scratch.exists(spark, path) else spark.createDataFrame([], schema)


def embed_new(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, model: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Embed rows (kind, id, hash, text) that arrive as Parquet files below source, if their content has no vector yet.

    model adds ``embedding`` to rows. The store is appended to, one batch at a time; a batch that is run again finds its own vectors there
    and adds nothing, so each content is stored once.
    """
    keys, kinds = ["kind", "id", "hash"], "kind string, id string, hash string, embedding array<double>"

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.dropDuplicates(keys).join(_stored(spark, store, kinds).select(*keys), keys, "left_anti")
        made = model(fresh).select(*keys, "embedding")
        made.write.mode("append").parquet(store)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_vectors(spark: SparkSession, store: str, texts: DataFrame) -> DataFrame:
    """The stored vectors of the texts' (kind, id, hash) present content."""
    keys = ["kind", "id", "hash"]
    kinds = "kind string, id string, hash string, embedding array<double>"
    return _stored(spark, store, kinds).join(texts.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)


def debounced(saves: DataFrame, quiet: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """(note_id, from, saved_at, version): of a stream of saves (note_id, at, version), the last of each burst; a burst ends when a note is quiet for a while.

    Works on a stream, where the watermark lets saves be ``late``, and on a table alike.
    """
    rows = saves.withWatermark("at", late)
    burst = rows.groupBy("note_id", F.session_window("at", quiet).alias("burst"))
    return burst.agg(F.max(F.struct("at", "version")).alias("last")).select("note_id", F.col("burst.start").alias("from"), F.col("last.at").alias("saved_at"), F.col("last.version").alias("version"))


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose keys were not seen before, within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def event_windows(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(from, event_type, n, total) of events (ts, event_type, value): counts and sums in tumbling or sliding windows; an extension, the corpus tools have none."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("from"), "event_type", "n", "total")


def remaining(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """planned (query, source) pairs that no manifest row (query, source, status) calls done."""
    return planned.join(manifest.where("status = 'done'").select("query", "source").distinct(), ["query", "source"], "left_anti")


def resume(spark: SparkSession, planned: DataFrame, manifest: str, work: Callable[[DataFrame], DataFrame], out: str) -> int:
    """Do the planned (query, source) pairs that are not done: work makes rows with query and source from them, which are appended to out and then called done. Returns how many pairs were left.

    A run that dies between the two appends does its pairs again; readers take each pair's rows by run, so look at the pairs called done only.
    """
    kinds = "query string, source string, status string, run string"
    left = scratch.cut_lineage(remaining(planned.select("query", "source").distinct(), _stored(spark, manifest, kinds)), "planned")
    n = left.count()
    if n:
        run = scratch.scratch_path(spark, "run").rsplit("-", 1)[-1]
        work(left).withColumn("run", F.lit(run)).write.mode("append").parquet(out)
        left.select("query", "source", F.lit("done").alias("status"), F.lit(run).alias("run")).write.mode("append").parquet(manifest)
    return n


def finished(spark: SparkSession, manifest: str, out: str) -> DataFrame:
    """The rows of out that belong to runs and pairs called done."""
    done = _stored(spark, manifest, "query string, source string, status string, run string").where("status = 'done'").select("query", "source", "run").distinct()
    return spark.read.parquet(out).join(done, ["query", "source", "run"], "left_semi")


def snowball(seeds: DataFrame, cites: DataFrame, known: DataFrame, rounds: int = 2, most: int | None = None) -> DataFrame:
    """(paper_id, round): papers reached from seeds (paper_id) along citations (src, dst) either way, breadth first, that are neither seeds nor known (paper_id).

    A paper that is known is not gone on from. ``most`` bounds what a round adds, the most often linked first, ties by id: a person has to read them.
    """
    both = cites.select("src", "dst").union(cites.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    seen = seeds.select("paper_id").union(known.select("paper_id")).distinct()
    front, found = seeds.select("paper_id").distinct(), None
    for turn in range(1, rounds + 1):
        reached = both.join(front.withColumnRenamed("paper_id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("n"))
        fresh = reached.join(seen, "paper_id", "left_anti")
        if most is not None:
            fresh = fresh.orderBy(F.desc("n"), "paper_id").limit(most)
        front = scratch.cut_lineage(fresh.select("paper_id"), "front")
        seen = seen.union(front)
        here = front.withColumn("round", F.lit(turn))
        found = here if found is None else found.union(here)
        if front.isEmpty():
            break
    return found


def replay(events: DataFrame, since: int, most: int = 500) -> DataFrame:
    """What a reader that has seen event number ``since`` (seq) is sent: later events, the last ``most`` of them at most, in order."""
    return events.where(F.col("seq") > since).orderBy(F.desc("seq")).limit(most).orderBy("seq")


def latest_by(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key; of equal times the one of the greater remaining columns."""
    rest = [c for c in rows.columns if c not in [*keys, at]]
    order = Window.partitionBy(*keys).orderBy(F.desc(at), *[F.desc(c) for c in rest])
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


class Progress(StreamingQueryListener):
    """What queries report: started, a batch's input rows, ended with an error or without; the last ``most`` events stay."""

    def __init__(self, most: int = 500):
        super().__init__()
        self.most, self.events = most, []

    def _add(self, **event) -> None:
        self.events = [*self.events, event][-self.most :]

    def onQueryStarted(self, event):
        self._add(what="started", query=str(event.id))

    def onQueryProgress(self, event):
        self._add(what="batch", query=str(event.progress.id), batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event):
        self._add(what="idle", query=str(event.id))

    def onQueryTerminated(self, event):
        self._add(what="ended", query=str(event.id), error=event.exception)


def pause(query: StreamingQuery) -> None:
    """Stop after the batch in hand; started again with the same checkpoint, the query goes on where it was."""
    query.stop()


def discard(spark: SparkSession, checkpoint: str, *outputs: str) -> None:
    """Forget a run: its checkpoint and what it wrote."""
    for path in (checkpoint, *outputs):
        scratch.delete(spark, path)
