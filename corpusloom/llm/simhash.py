"""Near-duplicates by SimHash and anchor-point covering.

Fingerprints are 64 bits. Anchors are the points of a covering code over the
leading bits: the direct sum of two copies of the perfect [23,12] Golay code,
covering radius 3 each. A fingerprint's home is its nearest anchor. It is
replicated to every anchor within covering radius plus threshold that can be
the home of a fingerprint at most ``threshold`` bits away: about 68 of the 2^24
anchors. So for any two linked fingerprints each visits the other's home, and
comparing homes with visitors, anchor by anchor, finds every link.

:func:`similar_dedup` is the form for a Jaccard similarity: a pair of similarity 0.8
differs in some ten of 64 bits, out of reach of any affordable covering, so pairs that
share a MinHash band are candidates, too, and whole shingle sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LAST_ID, connected_components, discard, materialize, thrifty
from corpusloom.llm.near_dedup import open_pairs, sets_of, similar, sketches

BITS = 64
BLOCK = 23
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = word.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


def anchor_offsets(threshold: int) -> list[list[np.ndarray]]:
    """[flips][syndrome]: what to xor to a word to reach the homes that need that many flipped bits."""
    single = np.array([1 << i for i in range(BLOCK)], np.int64)
    patterns = [np.zeros(1, np.int64)]
    for size in range(1, 4):
        known = {0} if size == 1 else set(patterns[size - 1].tolist())
        grown = {int(p) ^ int(s) for p in known for s in single if not int(p) & int(s)}
        patterns.append(np.array(sorted(grown), np.int64))
    leader = np.zeros(2048, np.int64)
    for pattern in reversed(patterns):  # perfect code: each syndrome has one pattern of at most 3 bits
        leader[_syndrome(pattern)] = pattern
    out: list[list[np.ndarray]] = []
    reached = [set() for _ in range(2048)]
    for flips in range(threshold + 1):
        turn = _syndrome(patterns[flips])
        level = []
        for syndrome in range(2048):
            found = {int(o) for o in patterns[flips] ^ leader[syndrome ^ turn]} - reached[syndrome]
            reached[syndrome] |= found
            level.append(np.array(sorted(found), np.int64))
        out.append(level)
    return out


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """SimHash of one text: lower-cased A-Z, word shingles with repeats, majority of XXH64 bits; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: len(words) - shingle] + 1]
    counts = np.zeros(BITS, np.int64)
    spans = list(zip(starts.tolist(), ends[shingle - 1 :].tolist()))
    for at in range(0, len(spans), 65536):  # bounded memory for very long texts
        part = spans[at : at + 65536]
        h = np.fromiter((digest(joined[s:e], seed) for s, e in part), ">u8", len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                fps = [fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(thrifty(run), "doc_id long, fp long")


def anchors(nodes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, node, home): a row for each anchor that a fingerprint is dealt to; home marks its own."""
    mask = (1 << BLOCK) - 1
    padded = []  # [flips]: a row for each syndrome, filled up with -1
    for level in anchor_offsets(threshold):
        table = np.full((2048, max(map(len, level))), -1, np.int64)
        for syndrome, found in enumerate(level):
            table[syndrome, : len(found)] = found
        padded.append(table)

    def deal(whole):
        left, right = (whole >> 41) & mask, (whole >> 18) & mask
        ls, rs = _syndrome(left), _syndrome(right)
        rows, keys, homes = [], [], []
        for fl in range(threshold + 1):
            lo = padded[fl][ls]
            lk = np.where(lo < 0, -1, (left[:, None] ^ lo) >> 11 << 12)
            for fr in range(threshold + 1 - fl):
                ro = padded[fr][rs]
                rk = np.where(ro < 0, -1, (right[:, None] ^ ro) >> 11)
                i, j, k = np.nonzero((lk >= 0)[:, :, None] & (rk >= 0)[:, None, :])
                rows.append(i)
                keys.append(lk[i, j] | rk[i, k])
                homes.append(np.full(len(i), fl + fr == 0))
        return np.concatenate(rows), np.concatenate(keys).astype(np.int32), np.concatenate(homes)

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(fps), 4096):
                whole, node = fps[lo : lo + 4096], ids[lo : lo + 4096]
                at, keys, homes = deal(whole)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(keys), "fp": pa.array(whole[at]), "node": pa.array(node[at]), "home": pa.array(homes)})

    return nodes.select("fp", "node").mapInArrow(thrifty(run), "anchor int, fp long, node long, home boolean")


def links(nodes: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (fp, node) of at most threshold differing bits.

    In each anchor visitors meet homes; each link is seen once, at the home of its
    smaller fingerprint. Spark takes the visitors for as many bytes as their fingerprints, a fraction of what they are, and
    would broadcast them; so it is told to merge.
    """
    dealt = anchors(nodes, threshold)
    home = dealt.where("home").select("anchor", F.col("fp").alias("hfp"), F.col("node").alias("a"))
    visitor = dealt.select("anchor", F.col("fp").alias("vfp"), F.col("node").alias("b"))
    met = home.join(visitor.hint("merge"), "anchor").where((F.col("hfp") < F.col("vfp")) & (F.bit_count(F.col("hfp").bitwiseXOR(F.col("vfp"))) <= threshold))
    return met.select("a", "b")


def simhash_dedup(docs: DataFrame, shingle: int = 3, threshold: int = 2, seed: int = 42) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``threshold`` bits.

    Returns one row per input row: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable), members (rows in the component).
    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows share a component. Rows with a null doc_id take part, but do
    not name a component: where no member has an id, component_id is null. Works
    on empty tables; other columns are ignored.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    rows = materialize(fingerprints(docs, shingle, seed), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-fp")
    named = nodes.select("fp", F.col("fp").alias("node"))
    found = connected_components(links(named, threshold))
    comp = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    comp = materialize(comp, "simhash-cc")
    roots = comp.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    by_fp = comp.join(roots, "root").select("fp", "component_id", "members")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "members")


def similar_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """Components of rows (doc_id, text, key) linked by a Jaccard similarity of ``similarity`` and more of their word shingles.

    Candidates are pairs whose SimHash fingerprints differ in at most ``threshold`` bits, by anchors, and
    pairs that share a band of MinHash values; whole shingle sets decide. Returns one row per input row: doc_id,
    key, root, kept. A component's row of the smallest doc_id (nulls last, then by key) is kept, and with it any
    row of the same key. Texts of fewer words than a shingle are one shingle; null and wordless texts are
    alike. Works on empty tables; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "key")
    rows = materialize(sketches(docs, shingle), "near")
    nodes = rows.select("node", "fp", "bands").dropDuplicates(["node"])  # equal sets have equal sketches
    close = rows.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    same_fp = rows.select("node", "fp").distinct().join(close.where("least < most"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    anchored = links(close.select("fp", F.col("least").alias("node")), threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowds = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(dealt.join(crowds.hint("merge"), "bucket"), "near-members")  # 25 rows a node, which Spark's estimates leave out
    fullest = members.groupBy("node").agg(F.sum("n").alias("pull"))
    hubs = members.join(fullest, "node").groupBy("bucket").agg(F.max_by("node", F.struct("pull", "node")).alias("hub"))
    starred = members.join(hubs, "bucket").where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    tried = materialize(starred.union(anchored).union(same_fp.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "near-tried")
    # the sets of those in question are made again from their texts, one row for each
    asked = members.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    one = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    sets = materialize(sets_of(docs.join(one, "key").select("node", "text"), shingle).dropDuplicates(["node"]), "near-sets")
    found = materialize(similar(tried, sets, similarity), "near-links")
    comp = materialize(connected_components(found), "near-cc")
    roots = comp.select("node", F.col("component").alias("root"))
    rest = materialize(open_pairs(members, nodes.select("node", "bands"), sets, roots, similarity).join(tried, ["a", "b"], "left_anti"), "near-rest")
    whole = materialize(connected_components(found.union(materialize(similar(rest, sets, similarity), "near-links"))), "near-cc")
    placed = rows.select("doc_id", "key", "node").join(whole, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "key")).alias("first"))
    out = materialize(placed.join(first, "root").select("doc_id", "key", "root", (F.col("key") == F.col("first.key")).alias("kept")), "near-out")
    for used in (rows, members, tried, sets, found, comp, rest, whole):
        discard(used)
    return out
