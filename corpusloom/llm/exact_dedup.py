"""Exact duplicates by counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints
of its normalised texts. A fingerprint is cut into a quotient (high bits) and a
remainder; since both are kept whole, filters merge without loss, by merging
sorted remainders and adding counts. Filters travel in segments of consecutive
quotients, so each merging task holds one segment of all partitions' filters.
Fingerprints whose merged count is above one route their rows to byte
verification, where equal means equal text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import SPACE, give_back, materialize, thrifty

#: Duplicate fingerprints up to this many (16 MB) are broadcast; beyond, texts are shuffled by fingerprint once.
BROADCAST_FINGERPRINTS = 2_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class CountingQuotientFilter:
    """Sorted runs of remainders with counts, one run for each quotient that occurs.

    ``quotients`` holds the quotients (high bits) that have a run, ascending; ``lengths`` the slots of each run;
    ``remainders`` (low bits) and ``counts`` the slots, run after run, ascending within each.
    """

    def __init__(self, bits: int, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.quotients, self.lengths, self.remainders, self.counts = bits, quotients, lengths, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int):
        """From unsigned 64-bit fingerprints, repeats included; ``bits`` of them are the quotient."""
        slots, counts = np.unique(fingerprints, return_counts=True)
        shift = np.uint64(64 - bits)
        quotients, lengths = np.unique(slots >> shift, return_counts=True)
        return cls(bits, quotients.astype(np.uint64), lengths, slots & ((np.uint64(1) << shift) - np.uint64(1)), counts.astype(np.int64))

    def slots(self) -> np.ndarray:
        """The quotient of each slot."""
        return np.repeat(self.quotients, self.lengths)

    def segments(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(segment, packed filter) for each range of quotients that has runs: ``bits`` high bits of the quotient."""
        at = (self.quotients >> np.uint64(self.bits - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(self.lengths)]
        for lo, hi in zip(cuts.tolist(), np.r_[cuts[1:], len(at)].tolist()):
            a, b = int(ends[lo]), int(ends[hi])
            yield int(at[lo]), CountingQuotientFilter(self.bits, self.quotients[lo:hi], self.lengths[lo:hi], self.remainders[a:b], self.counts[a:b]).pack()

    def pack(self) -> bytes:
        """Quotients, run lengths and counts in four bytes each, remainders in as many as they need."""
        width = -(-(64 - self.bits) // 8)
        parts = [np.array([len(self.quotients), len(self.remainders)], "<u4"), self.quotients.astype("<u4"), self.lengths.astype("<u4"), self.counts.astype("<u4")]
        return b"".join(p.tobytes() for p in parts) + np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()

    @classmethod
    def unpack(cls, data: bytes, bits: int):
        runs, n = np.frombuffer(data, "<u4", 2).tolist()
        quotients, lengths, counts = (np.frombuffer(data, "<u4", size, 4 * at) for size, at in ((runs, 2), (runs, 2 + runs), (n, 2 + 2 * runs)))
        width = -(-(64 - bits) // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, 4 * (2 + 2 * runs + n)).reshape(n, width)
        return cls(bits, quotients.astype(np.uint64), lengths.astype(np.int64), wide.view("<u8").ravel().astype(np.uint64), counts.astype(np.int64))

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both as one: runs of a quotient that both have are merged by their sorted remainders, and counts of equal slots added. Nothing is lost."""
        shift = np.uint64(64 - self.bits)
        # runs are in the order of quotients and sorted within, so (quotient, remainder) ascends over all slots of either
        mine, theirs = (self.slots() << shift) | self.remainders, (other.slots() << shift) | other.remainders
        place = np.searchsorted(mine, theirs)
        equal = np.zeros(len(theirs), bool)
        inside = place < len(mine)
        equal[inside] = mine[place[inside]] == theirs[inside]
        counts = self.counts.copy()
        counts[place[equal]] += other.counts[equal]
        new = ~equal
        slots = np.insert(mine, place[new], theirs[new])
        counts = np.insert(counts, place[new], other.counts[new])
        quotients, lengths = np.unique(slots >> shift, return_counts=True)
        return CountingQuotientFilter(self.bits, quotients, lengths, slots & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter from several, two by two, so each slot is moved a logarithmic number of times."""
        while len(filters) > 1:
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2])] + (filters[-1:] if len(filters) % 2 else [])
        return filters[0]

    def fingerprints(self) -> np.ndarray:
        return (self.slots() << np.uint64(64 - self.bits)) | self.remainders


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int, quotient_bits: int = 24) -> DataFrame:
    """fp (long) of every fingerprint that occurs more than once in column fp."""
    bits = max(4, int(np.ceil(np.log2(max(1, n_rows) / 500_000 + 1))))  # about half a million slots a segment
    flush = 4_000_000

    def build(batches):
        held: list[np.ndarray] = []

        def out():
            rows = list(CountingQuotientFilter.build(np.concatenate(held), quotient_bits).segments(bits)) if held else []
            return pa.RecordBatch.from_pydict({"segment": pa.array([r[0] for r in rows], pa.int64()), "filter": pa.array([r[1] for r in rows], pa.binary())})

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= flush:
                yield out()
                held = []
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(f, quotient_bits) for f in table["filter"].to_pylist()])
        out = pa.table({"fp": pa.array(whole.fingerprints()[whole.counts > 1].view(np.int64), pa.int64())})
        give_back()
        return out

    filters = fingerprints.select("fp").mapInArrow(thrifty(build), "segment long, filter binary")
    return filters.groupBy("segment").applyInArrow(merge, "fp long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Group documents whose texts are equal after each white-space run became one space.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. A null text counts as empty. Null doc_ids sort last: keep_id is
    null only if the whole group's are. Of repeated rows with the group's
    smallest doc_id (or of rows without any), exactly one is kept. An empty table gives
    an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = materialize(texts.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "exact")
    repeated = materialize(repeated_fingerprints(rows, rows.count()), "exact-fp")
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    routed = texts.withColumn("fp", F.xxhash64("norm")).join(F.broadcast(repeated) if few else repeated, "fp", "left_semi")
    verified = (
        routed.groupBy("norm")  # the bytes themselves; copies collapse before the shuffle
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("found"))
    )
    one = Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0))
    return (
        rows.drop("fp")
        .withColumn("nth", F.row_number().over(one))
        .join(verified, "text_sha256", "left")
        .select(
            "doc_id",
            F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("found").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))).alias("kept"),
            "text_sha256",
        )
    )
