"""Shingle sets, MinHash bands and the exact Jaccard test, for near-duplicates of a given similarity.

A text's shingle set is kept as 64-bit hashes. Texts that agree in all rows of a
band of their MinHash signatures share a bucket. Each bucket's members are compared with
the one of them that has the fullest buckets, mostly the original of a group of copies, which settles large
groups with one comparison a member and bucket. What is left are buckets of several components, mostly texts that share a passage or
are less alike. There pairs meet once, in the first bucket they share, and go on if a sketch of SKETCH bits lets them be as
similar as asked. Every link is decided by the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, thrifty

#: A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^5)^25 = 0.00005.
BANDS, BAND_ROWS = 25, 5
#: Elements of a signature's working table held at once; words whose hashes a task remembers.
TILE, MEMO = 2048, 500_000
#: Bits of a sketch, one for each of as many MinHash values, and the deviations by which a pair at the threshold may miss it: 4.5, by chance 3 in a million.
SKETCH, DEVIATIONS = 2048, 4.5
#: Longs of a sketch that are looked at first.
QUICK = 4
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2)
SKETCH_FACTORS = _RNG.integers(0, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH_OFFSETS = _RNG.integers(0, 2**63, SKETCH, np.uint64) * np.uint64(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_set(text: str | None, shingle: int, word_hash: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z in lower case; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.full(n, min(len(h), shingle), np.uint64)
    for i in range(min(len(h), shingle)):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each band, as signed longs."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), TILE):
        least = np.minimum(least, (FACTORS[:, None] * hashes[None, lo : lo + TILE] + OFFSETS[:, None]).min(axis=1))
    rows, out = least.reshape(BANDS, BAND_ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def simhash_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo : lo + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, node (hash of the shingle set), fp (its SimHash) and bands of each row (doc_id, text, key)."""

    def run(batches):
        word_hash = _WordHash()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t, shingle, word_hash) for t in part.column(1).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                fps = np.array([simhash_of(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0), "key": part.column(2), "node": pa.array(nodes), "fp": pa.array(fps), "bands": pa.array([bands_of(s) for s in sets], pa.list_(pa.int64()))}
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "key").mapInArrow(thrifty(run), "doc_id long, key string, node long, fp long, bands array<long>")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches):
        word_hash = _WordHash()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, shingle, word_hash).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(thrifty(run), "node long, hashes binary")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH MinHash values, as signed longs."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), TILE // 8):
        least = np.minimum(least, (SKETCH_FACTORS[:, None] * hashes[None, lo : lo + TILE // 8] + SKETCH_OFFSETS[:, None]).min(axis=1))
    return np.packbits((_mix(least) & np.uint64(1)).astype(bool)).view(np.int64)


def sketched(sets: DataFrame) -> DataFrame:
    """(node, sketch array<long>) of sets (node, hashes)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(np.frombuffer(x.as_py(), np.uint64)) for x in part.column(1)], pa.list_(pa.int64()))], ["node", "sketch"])

    return sets.select("node", "hashes").mapInArrow(thrifty(run), "node long, sketch array<long>")


def most_apart(threshold: float, bits: int = SKETCH) -> int:
    """Of so many bits of their sketches, those in which a pair of that similarity may differ, but for DEVIATIONS."""
    share = (1 - threshold) / 2
    return int(bits * (share + DEVIATIONS * (share * (1 - share) / bits) ** 0.5))


def open_pairs(members: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different roots (node, root) that share a bucket (band, bucket, node) and whose sketches allow the threshold; each once.

    nodes (node, bands). In a bucket the members of its largest component are met by the others only, so a large group of copies is not met by itself.
    """
    placed = members.join(roots, "node", "left").select("band", "bucket", "node", F.coalesce("root", "node").alias("root"))
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("major")).where("roots > 1").select("bucket", "major")
    placed = placed.join(mixed, "bucket")
    asked = placed.select("node").distinct()
    wide = sketched(sets.join(asked, "node", "left_semi")).join(nodes.join(asked, "node", "left_semi"), "node")
    rows = materialize(placed.join(wide.select("node", "sketch", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(QUICK)]).hint("merge"), "node"), "near-open")  # sketches are more than Spark takes them for
    x, y = rows.where("root <> major").alias("x"), rows.alias("y")
    differ = lambda u, v: F.bit_count(u.bitwiseXOR(v))
    quick = sum((differ(F.col(f"x.s{i}"), F.col(f"y.s{i}")) for i in range(1, QUICK)), differ(F.col("x.s0"), F.col("y.s0")))  # part of the sketch, in compiled code
    apart = F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda u, v: differ(u, v)), F.lit(0), lambda s, n: s + n)
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda u, v: u == v), True) - 1
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & once & (quick <= most_apart(threshold, 64 * QUICK)) & (first == F.col("x.band")) & (apart <= most_apart(threshold))
    return x.join(y.hint("merge"), meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have a Jaccard similarity of threshold and more."""

    def run(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                hit.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    near = F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y")) - 1e-9
    met = pairs.join(left, "a").join(right, "b").where(near)
    return met.select("a", "b", "x", "y").mapInArrow(thrifty(run), "a long, b long")
