"""Operators on small tables with results worked out by hand or by a plain re-implementation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gaps, network, phase4, reports, retrieval, vectors
from corpusloom.plans import dsl
from corpusloom.scale import pick_thresholds


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_thresholds():
    small, large = pick_thresholds(30), pick_thresholds(3000)
    assert (small.min_papers, small.orphan_ratio, small.min_row, small.top) == (2, 3, 2, 25)
    assert (large.min_papers, large.orphan_ratio, large.min_row, large.min_cluster, large.top) == (8, 15, 10, 6, 100)


def test_tokeniser_and_parser():
    assert dsl.tokenise("a>=1 AND 'x \\'y'") == [("word", "a"), ("op", ">="), ("word", "1"), ("word", "AND"), ("text", "x 'y")]
    assert dsl.tokenise("a!=b") == [("word", "a"), ("op", "!="), ("word", "b")]
    tree = dsl.parse("a:1 AND b:2 OR deep learning")
    assert tree == dsl.Node("or", (dsl.Node("and", (dsl.Clause("a", "=", "1"), dsl.Clause("b", "=", "2"))), dsl.Text("deep learning")))
    assert dsl.parse("") is None
    with pytest.raises(dsl.QueryError):
        dsl.parse("'open")
    with pytest.warns(UserWarning):
        assert dsl.parse("category:x year>=2020") == dsl.Clause("category", "=", "x")


def test_query(spark):
    papers = spark.createDataFrame([(1, "Deep 100% nets", 2020, "A"), (2, "Graphs", None, "a"), (3, None, 2021, "B")], "paper_id long, title string, year int, venue string")
    categories = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "paper_id long, category string")
    fields = spark.createDataFrame([(1, "size", "12abc"), (2, "size", "abc"), (3, "size", "3")], "paper_id long, field_name string, field_value string")
    tables = {"papers": papers, "categories": categories, "fields": fields}
    find = lambda q: [r.paper_id for r in dsl.run(q, tables).collect()]
    assert find("") == [3, 1, 2]
    assert find("category:x AND category:Y") == [1]
    assert find("venue=a") == [1, 2]
    assert find("'100%'") == [1]
    assert find("size>=3") == [3, 1]
    assert find("size<1") == [2]
    assert find("year!=2020") == [3]
    with pytest.raises(dsl.QueryError):
        find("year>now")


def test_evidence_gap(spark):
    r = spark.createDataFrame([(1, "f1", None, 0.5), (2, "f1", None, 0.9), (1, "f1", "d", 0.5), (2, "f1", "d", 0.51), (3, "acc", "d", 1.0), (4, "acc", "d", -1.0)], "paper_id long, metric string, dataset string, value double")
    assert rows(gaps.evidence_gap(r), "metric", "cv") == [("acc", 0.0), ("f1", pytest.approx(0.2 / 0.7))]
    assert rows(phase4.evidence(r), "metric") == []


def test_knowledge_gap_against_neighbours(spark):
    rng = random.Random(1)
    cells = [(i, rng.choice("abc"), rng.choice("xy"), rng.choice("pqr")) for i in range(12)]
    got = {(r.a, r.b, r.c): (r.mean_neighbours, r.dense_neighbours) for r in gaps.knowledge_gap(spark.createDataFrame(cells, "paper_id long, a string, b string, c string"), ["a", "b", "c"], 0).collect()}
    axes = [sorted({c[i] for c in cells}) for i in (1, 2, 3)]
    full = {c[1:] for c in cells}
    count = lambda k: sum(c[1:] == k for c in cells)
    for cell in itertools.product(*axes):
        if cell not in full:
            near = [k for k in itertools.product(*axes) if sum(x != y for x, y in zip(cell, k)) == 1]
            assert got[cell] == (pytest.approx(sum(map(count, near)) / len(near)), sum(count(k) > 0 for k in near))


def test_pagerank(spark):
    edges = [(1, 2), (1, 2), (2, 3), (3, 1), (4, 3), (4, 5)]
    got = {r.node: r["rank"] for r in network.pagerank(spark.createDataFrame(edges, "src long, dst long")).collect()}
    rank = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(30):
        out = {n: [d for s, d in edges if s == n] for n in rank}
        lost = sum(r for n, r in rank.items() if not out[n])
        rank = {n: 0.03 + 0.85 * (lost / 5 + sum(rank[s] / len(out[s]) for s, d in edges if d == n)) for n in rank}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(rank, abs=1e-5)


def test_main_path(spark):
    edges = spark.createDataFrame([(5, 4), (5, 3), (4, 2), (3, 2), (2, 1), (1, 5)], "src long, dst long")
    years = spark.createDataFrame([(n, 2000 + n) for n in range(1, 6)], "node long, year int")
    assert [(r.src, r.dst, r.spc) for r in network.main_path(edges, years).collect()] == [(5, 3, 1.0), (3, 2, 1.0), (2, 1, 2.0)]


def test_minhash_family():
    a, b = retrieval.coefficients(4)
    assert all(0 < int(x) < 2**32 for x in a)
    plain = []
    for s in ("", "a", "the cat é"):
        h = 2166136261
        for u in s.encode("utf-16-le")[::2]:
            h = ((h ^ u) * 16777619) & 0xFFFFFFFF
        plain.append(h)
    assert retrieval.fnv1a(["", "a", "the cat é"]).tolist() == plain


def test_minhash_pairs(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, "something else entirely here"), (4, ""), (5, None), (6, base)], "doc_id long, text string")
    got = rows(retrieval.minhash_pairs(retrieval.minhash(docs)), "a", "b")
    assert (1, 6) in got and (1, 2) in got and all(a < b and {a, b} <= {1, 2, 6} for a, b in got)


def test_text_functions(spark):
    one = spark.createDataFrame([("The BERT-base v2.1, -edge- a/b and U.S. x",)], "s string").select(T.tokens(F.col("s")).alias("t"), T.normalise_entity(F.lit("Foo-Net (v2.1)")).alias("e"), T.normalise_entity(F.lit("CIFAR-10 v1")).alias("n")).first()
    assert one.t == ["bert-base", "v2.1", "edge", "a/b", "u.s"] and one.n == "cifar-10"
    doi = spark.range(1).select(T.normalise_doi(F.lit("https://doi.org/10.1/AbC")).alias("d"), T.arxiv_id(F.lit("http://arxiv.org/abs/2101.00001v2")).alias("a")).first()
    assert (doi.d, doi.a) == ("10.1/abc", "2101.00001")


def test_quantiles(spark):
    for values, floor, upper, mid in (([1.0], 1.0, 1.0, 1.0), ([1.0, 3.0], 3.0, 3.0, 2.0), ([1.0, 2.0, 3.0, 4.0], 3.0, 3.0, 2.5)):
        r = reports.quantiles(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "v", "g", 0.5).first()
        assert (r.floor_index, r.upper_median, r.interpolated) == (floor, upper, mid)


def test_communities_and_lof(spark):
    points = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(4)] + [(20, [-1.0, -1.0]), (21, [0.0, 0.0])]
    table = spark.createDataFrame(points, "id long, embedding array<double>")
    found = vectors.communities(vectors.paraphrases(table, 5, 0.9), table.select("id"), 3)
    assert rows(found, "community", "id") == [(0, i) for i in range(5)] + [(1, 10 + i) for i in range(4)]
    lof = {r.id: r.lof for r in vectors.local_outlier_factor(table, 3).collect()}
    assert max(lof, key=lof.get) in (20, 21)
