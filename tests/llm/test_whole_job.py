"""Each operator does its whole job where a bound of its own used to cut it."""

import gzip
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from corpusloom.llm import class_lm, quality, simhash, warc


def test_quality_sample_and_prior_come_from_all_labels(spark, monkeypatch):
    table = spark.range(4000).selectExpr("id as doc_id", "concat('line ', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    monkeypatch.setattr(quality, "fit_curve", lambda q, label: (float(len(label)), 0.0))
    curve = {}
    monkeypatch.setattr(quality, "score_documents", lambda docs, field: curve.update(n=field.curve[0], prior=field.curve[1]) or docs)
    quality.classify_quality(table, labels, sample_docs=100)
    assert 60 <= curve["n"] <= 140  # both samples of about 50
    assert curve["prior"] == pytest.approx(np.log(9), abs=0.7)


def test_warc_reads_headers_longer_than_64_kb(spark):
    rows = [(1, "u", "first"), (2, "http://x/" + "y" * 100_000, "second"), (3, "u", "third")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.warc_round_trip(table).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, 5), (2, 6), (3, 5)]


def test_warc_raises_where_a_chain_breaks(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\nhello\r\n\r\n"
    (tmp_path / "good.warc").write_bytes(record % 5 * 2)
    assert warc.read_warc(spark, str(tmp_path)).count() == 2
    (tmp_path / "bad.warc").write_bytes(record % 5 + record % 7 + record % 5)
    with pytest.raises(ValueError, match="1 archives"):
        warc.read_warc(spark, str(tmp_path))


def test_warc_reads_gzipped_archives(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 7\r\n\r\nWARC/1.\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) * 3)
    assert [(r.type, r.payload_bytes) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [("resource", 7)] * 3


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_warc_revisits_by_either_way_and_above_a_size(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", broadcast)
    rows = [(3, "u", "long enough"), (1, "u", "long enough"), (None, "u", "long enough"), (2, "u", "short"), (4, "u", "short"), (5, None, None), (6, "u", "x WARC/1.1\r\n y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(table, min_revisit_bytes=6).collect()}
    assert got == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)}


def test_quality_learns_from_bounded_lines_and_not_from_their_number_of_labels(spark):
    texts = [(i, "\n".join(["A good line of text that ends well."] * 3) if i % 4 else "%%% $$$\n### ***\n" * 2) for i in range(400)] + [(1000, "word\n" * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    scores = {}
    for n, labels in ((1, few), (10, few.union(spark.range(10**6, 10**6 + 3600).selectExpr("id", "cast(id % 4 > 0 as int)")))):
        scores[n] = {r.doc_id: r.score for r in quality.classify_quality(docs, labels, sample_docs=200 * n, sample_lines=2000).collect()}
    assert all(abs(scores[1][i] - scores[10][i]) < 0.1 for i in range(400))
    assert min(s for i, s in scores[1].items() if i < 400 and i % 4) > 0.5 > max(s for i, s in scores[1].items() if i < 400 and not i % 4)


def test_simhash_links_are_not_broadcast(spark):
    nodes = spark.range(1000).selectExpr("xxhash64(id) as fp", "id as node")
    assert "BroadcastHashJoin" not in simhash.links(nodes, 2)._jdf.queryExecution().executedPlan().toString()


def test_near_copies_broadcast_no_buckets(spark, monkeypatch):
    plans = []
    keep = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    docs = spark.range(60).selectExpr("id as doc_id", "concat('some words of text ', id % 20, ' and more of them') as text", "string(id) as key")
    assert simhash.similar_dedup(docs).count() == 60
    assert "BroadcastHashJoin" not in dict(plans)["near-members"]


def test_clustering_takes_few_logarithms_and_large_counts(monkeypatch):
    rng = np.random.default_rng(0)
    pairs = np.floor(rng.exponential(3, (120, 120)) * (rng.random((120, 120)) < 0.3))
    pairs[0, 0] = 0
    sizes, keep = [], class_lm._xlogx
    monkeypatch.setattr(class_lm, "_xlogx", lambda x: sizes.append(x.size) or keep(x))
    want = class_lm.exchange(pairs, 24)
    assert sizes.count(24 * 24) <= 2  # whole tables
    monkeypatch.setattr(class_lm, "KNOWN_LOGS", 16)
    assert (class_lm.exchange(pairs, 24) == want).all()


def test_clustering_works_in_its_own_memory():
    code = """
import resource, numpy as np
from corpusloom.llm import class_lm
rng = np.random.default_rng(0)
pairs = np.floor(rng.exponential(3, (400, 400)) * (rng.random((400, 400)) < 0.5))
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
before = faults()
class_lm.exchange(pairs, 128)
print(faults() - before)
"""
    # arrays from 64 KB on come from the system and go back to it, as they do where malloc's threshold does not adapt; smaller ones stay
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parents[2]), "OMP_NUM_THREADS": "1", "MALLOC_MMAP_THRESHOLD_": "65536", "MALLOC_TRIM_THRESHOLD_": "1048576"}
    found = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True)
    assert int(found.stdout) < 200_000  # pages; numpy takes some by itself in some runs


def test_clustering_takes_logarithms_for_few_classes(monkeypatch):
    rng = np.random.default_rng(1)
    topic = rng.integers(0, 12, 150)
    pairs = np.floor(rng.exponential(20, (150, 150)) * (1 + 30 * (topic[:, None] == (topic + 1) % 12)) * (rng.random((150, 150)) < 0.4))
    pairs[0, 0] = 0
    cells, log = [], np.log
    monkeypatch.setattr(class_lm, "KNOWN_LOGS", 0)
    monkeypatch.setattr(np, "log", lambda x, **a: cells.append(x.size) or log(x, **a))
    got, few = class_lm.exchange(pairs, 32), sum(cells)
    monkeypatch.setattr(class_lm, "CHORD", 1e9, raising=False)  # all classes
    assert (class_lm.exchange(pairs, 32) == got).all()
    assert few < 0.6 * (sum(cells) - few)
