"""Streams that are stopped and started again, and what a run that died leaves."""

import time

import pytest

from corpusloom.operators.decisions import hash_embedder, with_model
from corpusloom.streaming import incremental as I

SCHEMA = "kind string, id string, hash string, text string"


def embed(rows):
    return with_model(rows, "text", hash_embedder(4), "embedding", "array<double>")


def test_each_content_is_embedded_once(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
    write([("p", "1", "a", "x y"), ("p", "1", "a", "x y"), ("p", "2", "b", "z")])
    I.embed_new(spark, source, SCHEMA, store, checkpoint, embed).awaitTermination()
    write([("p", "1", "c", "x z"), ("p", "2", "b", "z")])
    I.embed_new(spark, source, SCHEMA, store, checkpoint, embed).awaitTermination()
    I.embed_new(spark, source, SCHEMA, store, str(tmp_path / "lost checkpoint"), embed).awaitTermination()
    assert sorted((r.id, r.hash) for r in spark.read.parquet(store).collect()) == [("1", "a"), ("1", "c"), ("2", "b")]
    now = spark.createDataFrame([("p", "1", "c"), ("p", "3", "d")], "kind string, id string, hash string")
    assert [(r.id, r.hash) for r in I.latest_vectors(spark, store, now).collect()] == [("1", "c")]


def test_pairs_of_a_run_that_died_are_done_again(spark, tmp_path):
    planned = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "a")], "query string, source string")
    manifest, out = str(tmp_path / "manifest"), str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        I.resume(spark, planned, manifest, lambda left: (_ for _ in ()).throw(RuntimeError("killed")), out)
    assert I.resume(spark, planned, manifest, lambda left: left, out) == 2
    assert I.resume(spark, planned, manifest, lambda left: left, out) == 0
    left_over = spark.createDataFrame([("q", "a", "dead run")], "query string, source string, run string")
    left_over.write.mode("append").parquet(out)
    assert I.finished(spark, manifest, out).count() == 2


def test_snowball_goes_round_by_round(spark):
    cites = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (2, 9), (9, 5), (4, 4)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "paper_id long")
    got = sorted((r.paper_id, r.round) for r in I.snowball(ids(1), cites, ids(9), 3).collect())
    assert got == [(2, 1), (3, 2), (4, 3)]
    assert [(r.paper_id, r.round) for r in I.snowball(ids(2), cites, ids(9), 1, most=1).collect()] == [(1, 1)]


def test_a_query_can_be_paused_watched_and_discarded(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    listener = I.Progress()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(source)
        start = lambda: spark.readStream.schema("id long").parquet(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query = start()
        query.processAllAvailable()
        I.pause(query)
        spark.range(5, 8).write.mode("append").parquet(source)
        query = start()
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == 8
        for _ in range(100):
            if sum(e["what"] == "ended" for e in listener.events) == 2:
                break
            time.sleep(0.1)
        assert sorted(e["what"] for e in listener.events if e["what"] in ("started", "ended")) == ["ended", "ended", "started", "started"]  # they come in any order
    finally:
        spark.streams.removeListener(listener)
    I.discard(spark, checkpoint, out)
    assert not (tmp_path / "out").exists() and not (tmp_path / "check").exists()
