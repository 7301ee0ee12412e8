"""Communities, training and order statistics against plain Python."""

import random

import numpy as np
import pytest

from corpusloom.operators import discovery as D
from corpusloom.operators import reports
from corpusloom.operators import vectors as V


def blobs(spark, seed=0, n=40, dim=6):
    rng = np.random.default_rng(seed)
    data = [(i, (np.eye(dim)[i % 3] * (i % 4) / 2 + rng.normal(size=dim) / 3).tolist()) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, embedding array<double>")


def greedy(pairs, ids, least):
    near = {i: {i} for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    taken, out = set(), []
    for i in sorted((i for i in ids if len(near[i]) >= least), key=lambda i: (-len(near[i]), i)):
        fresh = near[i] - taken
        if len(fresh) >= least:
            out.append(sorted(fresh))
            taken |= fresh
    return sorted(out, key=lambda c: (-len(c), c[0]))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_communities_in_rounds_and_on_the_driver(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    want = greedy(pairs, range(40), 3)
    rows, ids = spark.createDataFrame(pairs, "a long, b long"), spark.range(40)
    for edges in (10**6, 0):
        got: dict[int, list[int]] = {}
        for r in V.communities(rows, ids, 3, driver_edges=edges).collect():
            got.setdefault(r.community, []).append(r.id)
            assert r["size"] == len(want[r.community])
        assert [sorted(got[k]) for k in sorted(got)] == want


def test_tuned_is_the_upper_median_of_third_neighbours(spark):
    data, rows = blobs(spark)
    v = np.array([x for _, x in data])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(v @ v.T, 6)
    np.fill_diagonal(cos, -9)
    third = np.sort(np.sort(cos, axis=1)[:, -3])
    threshold, least = D.tuned(rows)
    assert threshold == pytest.approx(min(0.92, max(0.55, third[len(third) // 2]))) and least == 8
    assert D.tuned(rows.limit(2)) == (0.75, 2)


def test_places(spark):
    rng = random.Random(7)
    values = [("g", rng.choice([1.5, rng.gauss(0, 1), rng.expovariate(1) ** 4])) for _ in range(300)] + [("one", 4.0)] * 5 + [("none", None)]
    rows = spark.createDataFrame(values, "g string, x double")
    places = spark.createDataFrame([("g", k) for k in range(0, 300, 7)] + [("one", 0), ("one", 4), ("one", 5), ("none", 0)], "g string, place long")
    got = {(r.g, r.place): r.x for r in reports.at_places(rows, "x", "g", places, 16).collect()}
    ordered = sorted(x for g, x in values if g == "g")
    assert got == {("g", k): ordered[k] for k in range(0, 300, 7)} | {("one", 0): 4.0, ("one", 4): 4.0}


def test_a_step_passes_answers_on_and_unlocks(spark):
    _, rows = blobs(spark)
    labels = spark.createDataFrame([(i, ["include", "exclude", ""][i % 3] if i < 27 else "") for i in range(40)], "id long, label string")
    batch = spark.createDataFrame([(1, 30, 30), (1, 30, 31), (1, 30, 0)], "nth int, centre long, id long")
    answers = spark.createDataFrame([(30, "exclude"), (33, "perhaps")], "id long, label string")
    scores = spark.createDataFrame([(35, 0.9, 0.1), (36, 0.5, 0.5), (31, 0.9, 0.1)], "id long, include double, exclude double")
    got = {r.id: (r.label, r.how) for r in D.training_step(labels, answers, batch, scores).collect()}
    assert got[30] == ("exclude", "decided") and got[31] == ("exclude", "passed on") and got[0] == ("include", "before")
    assert got[35] == ("include", "proposed") and not got[36][0] and not got[33][0]
    few = labels.withColumn("label", labels["label"].substr(1, 0))
    assert all(r.how != "proposed" for r in D.training_step(few, answers, batch, scores).collect())


def test_batches_take_each_row_once(spark):
    _, rows = blobs(spark)
    members = spark.createDataFrame([(0, 5, i) for i in range(5)] + [(1, 4, i) for i in range(10, 14)], "community int, size int, id long")
    pending = spark.createDataFrame([(i,) for i in (1, 2, 3, 11, 20, 21, 22)], "id long")
    got = [(r.nth, r.centre, r.id) for r in D.training_batch(rows, members, pending, 4, -1.0, most=2).orderBy("nth", "id").collect()]
    assert got == [(1, 1, 1), (1, 1, 2), (2, 11, 11), (3, 3, 3), (4, 20, 20)]


def test_profile_is_the_same_each_time(spark):
    _, rows = blobs(spark)
    one, two = ([tuple(r) for r in D.cosine_profile(rows, 50).orderBy("a", "b").collect()] for _ in range(2))
    assert one == two and 0 < len(one) <= 50 and all(a < b for a, b, _ in one)


def test_few_rows_stand_for_themselves(spark):
    _, rows = blobs(spark, n=5)
    assert sorted(r.id for r in D.sub_prototypes(rows).collect()) == list(range(5))


def test_binary_and_softmax(spark):
    v = [0.5, -1.0, 0.0, 2.0, 1.0, -1.0, -1.0, 1.0, 3.0]
    row = spark.createDataFrame([(v,)], "v array<double>").select(V.binary("v").alias("b"), V.softmax("v").alias("s"), V.truncated("v", 2).alias("t")).first()
    assert row.b == [int("10011001", 2), 128]
    assert row.s == pytest.approx(np.exp(v) / np.exp(v).sum()) and row.t == pytest.approx([0.5 / 1.25**0.5, -1 / 1.25**0.5])
