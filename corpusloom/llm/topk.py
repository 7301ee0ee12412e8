"""Exact top-k search over sparse integer vectors, term at a time.

Queries and corpus are cut into blocks of bounded size. A task gets one block
of each, builds the corpus block's inverted index (term -> postings of row and
weight), and for each term scatters query weight times posting weights into a
dense score array; a partition selection keeps each query's k best of the
block, and a merge over blocks keeps the k best of all. Nothing is broadcast:
blocks of the stated queries meet blocks of the corpus through an equi-join on
the pair of block numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import give_back, materialize

#: Query rows whose dense score arrays a task holds at once.
QUERY_TILE = 128


def sparse_rows(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, nth, terms, weights): floor(scale * x) of each component, zeros left out.

    Rows with a null id, a null vector or a null or non-finite component are left
    out. Rows that repeat an id are rows of their own, told apart by nth, from 1, in the order of their
    vectors. A component beyond the range of a long raises an error.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("v"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("v")))
    whole = F.transform("v", lambda v: F.when(F.abs(v) * scale >= 2.0**63, F.raise_error(F.lit("a component is beyond the range of a long")).cast("long")).otherwise(F.floor(v * scale).cast("long")))
    pairs = F.filter(F.transform(whole, lambda w, i: F.struct(i.alias("t"), w.alias("w"))), lambda p: p["w"] != 0)
    return rows.select("id", "nth", pairs.alias("p")).select("id", "nth", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def _flat(table: pa.Table):
    """ids and nths, and (row, term, weight) of every entry."""
    terms, weights = table["terms"].combine_chunks(), table["weights"].combine_chunks()
    lengths = np.diff(terms.offsets.to_numpy()) if len(terms) else np.zeros(0, np.int64)
    return table["id"].to_numpy(), table["nth"].to_numpy(), np.repeat(np.arange(len(terms)), lengths), np.asarray(terms.flatten()).astype(np.int64), np.asarray(weights.flatten()).astype(np.int64)


def _most(weights: np.ndarray) -> int:
    return max(abs(int(weights.min(initial=0))), abs(int(weights.max(initial=0))))


def _search(queries: pa.Table, corpus: pa.Table, k: int) -> pa.Table:
    order = [("id", "ascending"), ("nth", "ascending")]
    qid, qnth, qrow, qterm, qweight = _flat(queries.sort_by(order))
    did, dnth, drow, dterm, dweight = _flat(corpus.sort_by(order))
    longest = int(np.bincount(qrow).max(initial=0)) if len(qrow) else 0
    # where a sum could pass 64 bits, Python's integers take over; a score beyond a long is then an error
    kind = np.int64 if _most(qweight) * _most(dweight) * longest < 2**63 else object
    by_term = np.argsort(dterm, kind="stable")
    drow, dterm, dweight = drow[by_term], dterm[by_term], dweight[by_term].astype(kind)
    out: list[tuple] = []
    for lo in range(0, len(qid), QUERY_TILE):
        tile = (qrow >= lo) & (qrow < lo + QUERY_TILE)
        n = min(QUERY_TILE, len(qid) - lo)
        rows, terms, weights = qrow[tile] - lo, qterm[tile], qweight[tile].astype(kind)
        scores = np.zeros((n, len(did)), kind)
        for term in np.unique(terms):
            a, b = np.searchsorted(dterm, [term, term + 1])
            if a < b:
                who = terms == term
                scores[np.ix_(rows[who], drow[a:b])] += np.multiply.outer(weights[who], dweight[a:b])
        for i in range(n):
            allowed = np.flatnonzero((did != qid[lo + i]) | (dnth != qnth[lo + i]))
            score = scores[i, allowed]
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.r_[np.flatnonzero(score > least), np.flatnonzero(score == least)]  # ids ascend within each
                keep = keep[:k]
            else:
                keep = np.arange(len(score))
            at = allowed[keep]
            out.append((np.full(len(keep), qid[lo + i]), np.full(len(keep), qnth[lo + i]), did[at], dnth[at], score[keep]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    give_back()
    return pa.table({n: pa.array(c.tolist() if c.dtype == object else c.astype(np.int64), pa.int64()) for n, c in zip(("query_id", "query_nth", "vec_id", "vec_nth", "score"), cols)})


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, query_block: int = 2048, corpus_block: int = 8192) -> DataFrame:
    """Each query's k corpus rows of highest inner product, never the query's own row.

    queries and corpus have (id, nth, terms, weights), as :func:`sparse_rows` makes
    them. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, then to the smaller nth; fewer than k where the corpus has fewer other rows. Empty vectors
    score 0 with everything. Queries that repeat an id are ranked each by itself. A score beyond the range of a long raises an error.
    """
    corpus, queries = materialize(corpus, "topk-corpus"), materialize(queries, "topk-queries")
    cut = lambda n, size: max(1, -(-n // size))
    n_q, n_c = cut(queries.count(), query_block), cut(corpus.count(), corpus_block)
    of = lambda n: F.pmod(F.xxhash64("id", "nth"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("*", of(n_q).alias("qb")).select("*", all_of(n_c).alias("cb"))
    c = corpus.select("*", of(n_c).alias("cb")).select("*", all_of(n_q).alias("qb"))

    columns = ["id", "nth", "terms", "weights"]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left.select(columns), right.select(columns), k)

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, query_nth long, vec_id long, vec_nth long, score long")
    best = Window.partitionBy("query_id", "query_nth").orderBy(F.desc("score"), "vec_id", "vec_nth")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
