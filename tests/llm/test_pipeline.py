"""The pipeline's duplicate stages keep exactly the rows that their operators keep."""

import collections
import itertools
import random

import corpus_pipeline
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def test_exact_stage_keeps_null_and_repeated_ids(spark):
    rows = [(None, "only here"), (None, "twice"), (None, "twice"), (1, "a b"), (1, "a  b"), (1, "other text"), (2, "other text"), (3, "a b"), (0, "other text"), (4, None)]
    got = collections.Counter((r.doc_id, " ".join((r.text or "").split())) for r in corpus_pipeline.stage_exact(spark, table(spark, rows), "").collect())
    assert got == collections.Counter([(None, "only here"), (None, "twice"), (1, "a b"), (0, "other text"), (4, "")])


def test_near_stage_keeps_null_and_repeated_ids(spark):
    far = ["one two three four five six", "seven eight nine ten eleven twelve", "p q r s t u v"]
    rows = [(None, far[0]), (None, far[1]), (5, far[2]), (5, far[2].upper()), (5, far[2]), (6, far[0].upper())]
    got = collections.Counter((r.doc_id, r.text.lower()) for r in corpus_pipeline.stage_simhash(spark, table(spark, rows), "").collect())
    assert got == collections.Counter([(6, far[0]), (None, far[1]), (5, far[2])])


def test_near_stage_drops_copies_of_similarity_080(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [str(rng.randint(0, 10**6)) for _ in range(200)]
        for edits in (0, 2, 3, 4, 8, 12):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = "new" + str(rng.random())
            rows.append((len(rows), " ".join(copy)))
    grams = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if r == hi else r for r in root]
    got = sorted(r.doc_id for r in corpus_pipeline.stage_simhash(spark, table(spark, rows), "").collect())
    assert got == sorted(set(root)) and len(got) < len(rows)


def test_all_stages_on_odd_rows_and_on_an_empty_table(spark, tmp_path):
    rng = random.Random(12)
    english, german = ("the of and to in is that for it with".split(), "der die und das ist nicht ein auf mit zu".split())
    rows = []
    for i in range(60):
        pool, lang = (english, "en") if i % 2 else (german, "de")
        rows.append((i, " ".join(rng.choice(pool) + rng.choice("abc") for _ in range(40)), lang, rng.choice(["a", "b", None]), None))
    rows += [(100, rows[0][1], "de", "a", 3), (None, rows[1][1] + " \n", "en", "b", 3), (101, None, None, None, None), (102, "", "en", "a", 0), (103, "12 34", "en", "a", 0), (1, rows[2][1], None, "b", 1)]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.decoded_ok and r.n_tokens == len(r.ids) > 0 for r in out)
    ids = {r.doc_id for r in out}
    assert not ids & {101, 102, 103} and 100 not in ids  # no letters, or a copy of a smaller id
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
