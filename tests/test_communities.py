"""vec_communities takes all pairs above its threshold, however many neighbours a row has."""

import numpy as np

from corpusloom.operators import vectors
from corpusloom.queries import vector_queries


def test_rows_of_many_neighbours_keep_all_members(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(i, (np.eye(8)[0 if i < 30 else 1] + rng.normal(size=8) / 50).tolist()) for i in range(50)]
    rows = spark.createDataFrame(data, "id long, embedding array<double>")
    monkeypatch.setattr(vector_queries, "_rows", lambda spark, sf_dir: rows)
    got = [(r.community, r["size"], r.id) for r in vector_queries.vec_communities(spark, "").orderBy("community", "id").collect()]
    assert got == [(0, 30, i) for i in range(30)] + [(1, 20, i) for i in range(30, 50)]


def test_pairs_above_matches_brute_force_over_blocks(spark):
    v = np.random.default_rng(1).normal(size=(60, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if round(float(u[a] @ u[b]), 6) >= 0.35}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = [(r.a, r.b) for r in vectors.pairs_above(rows, 0.35, block=16).collect()]
    assert len(got) == len(want) and set(got) == want


def test_communities_in_rounds_are_those_of_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = {(i, i + 1) for i in range(60)} | {(int(a), int(b)) for a, b in np.sort(rng.integers(0, 60, (40, 2))) if a < b}
    pairs, ids = spark.createDataFrame(sorted(edges), "a long, b long"), spark.range(64)
    near = {i: {i} | {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(64)}
    taken, want = set(), []
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if len(near[i]) >= 2 and len(fresh := near[i] - taken) >= 2:
            want.append(sorted(fresh))
            taken |= fresh
    want = [(n, len(c), i) for n, c in enumerate(sorted(want, key=lambda c: (-len(c), c[0]))) for i in c]
    tables = []
    keep = vectors.cut_lineage
    monkeypatch.setattr(vectors, "cut_lineage", lambda df, name: tables.append(name) or keep(df, name))
    for driver_edges in (1000, 120):
        got = vectors.communities(pairs, ids, 2, driver_edges).collect()
        assert sorted((r.community, r["size"], r.id) for r in got) == want
    assert tables.count("taken") <= 3
    assert vectors.communities(pairs.where("a < 6"), spark.range(8), 2, 3).count() == vectors.communities(pairs.where("a < 6"), spark.range(8), 2).count()
