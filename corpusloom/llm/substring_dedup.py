"""Exact removal of repeated word windows, with suffix automata of reference shards.

A window is ``window`` consecutive words; a window whose words also start earlier
in the corpus is removed. Each window has a seed, the ``seed_words`` words in it
with the least hash, so equal windows have equal seeds. Consecutive windows
of one seed form a piece.

1. Tasks reduce each text to its pieces' hashes; repeats that a task sees itself
   are removed at once. Grouped by seed, a seed that occurs once needs nothing,
   and a piece equal to an earlier one is removed as a whole.
2. Pieces left are the first of their content, and share their seed with other
   contents. Their words form the reference shards, dealt by seed. In a shard,
   pieces are streamed in corpus order through the suffix automaton of the
   pieces before them; where the matching statistic reaches ``window``, the window
   ends that also starts earlier. Then the automaton takes in the piece.
3. Seeds with very many contents would make one automaton too large; their
   windows are grouped by their words, pre-aggregated, and the earliest stays.

The automata go to the tasks that own their seeds rather than to every task:
broadcasting each shard's automaton to stream the whole corpus through it would
take work in proportion to shards times documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import LAST_ID, materialize, thrifty

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Seeds with more contents than this go by windows.
HOT_CONTENTS = 256
#: Pieces of a reference shard, about.
SHARD_PIECES = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(h: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)])


class Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, MULTIPLIER, np.uint64), dtype=np.uint64)])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, INVERSE, np.uint64), dtype=np.uint64)])


def pieces(words: list[bytes], window: int, seed_words: int, powers: Powers):
    """(seed, content, first window, seed's offset from it, windows) of a text's pieces, as arrays; None if it has no window."""
    n = len(words)
    if n < window:
        return None
    powers.upto(n + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    prefix = _prefix(h, powers.up)
    gram = _mix((prefix[seed_words:] - prefix[:-seed_words]) * powers.down[: n - seed_words + 1])
    at = np.lib.stride_tricks.sliding_window_view(gram, window - seed_words + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    other = _prefix(_mix(h), powers.up)
    end = first + count - 1 + window
    content = _mix((other[end] - other[first]) * powers.down[first] + (end - first).astype(np.uint64))
    return gram[at[first]], content, first, at[first] - first, count


class SuffixAutomaton:
    """Online suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def longest_matches(self, words: list[bytes]) -> list[int]:
        """Matching statistics: for each position the longest match that ends there."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            out.append(size)
        return out

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, w)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Of rows sorted by columns, which differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _pieces_of(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(kind, seed, content, dk, th, loc): kind 0 is a piece, kind 1 one that a task has seen before; loc packs first window, offset and windows."""

    def run(batches):
        powers = Powers()
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                cols: list[list[np.ndarray]] = [[] for _ in range(5)]
                for dk, th, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    found = pieces(text.encode("utf-8", "surrogatepass").split(), window, seed_words, powers) if text else None
                    if found is None:
                        continue
                    seed, content, first, off, count = found
                    loc = first.astype(np.int64) << 24 | off << 12 | count
                    for c, v in zip(cols, (seed.view(np.int64), content.view(np.int64), np.full(len(first), dk, np.int64), np.full(len(first), th, np.int64), loc)):
                        c.append(v)
                if not cols[0]:
                    continue
                seed, content, dk, th, loc = (np.concatenate(c) for c in cols)
                order = np.lexsort((loc, th, dk, content, seed))
                seed, content, dk, th, loc = (c[order] for c in (seed, content, dk, th, loc))
                once = _first_of(seed, content, dk, th, loc)
                seed, content, dk, th, loc = (c[once] for c in (seed, content, dk, th, loc))
                new = _first_of(seed, content)
                kind = (~new).astype(np.int8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(kind),
                        "seed": pa.array(np.where(new, seed, dk * 31 + (loc >> 30))),  # removed ones need no group: spread them
                        "content": pa.array(np.where(new, content, 0)),
                        "dk": pa.array(dk),
                        "th": pa.array(th),
                        "loc": pa.array(loc),
                    }
                )

    return docs.select("dk", "th", "text").mapInArrow(thrifty(run), "kind byte, seed long, content long, dk long, th long, loc long")


def _words_of_pieces(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(seed, dk, th, loc, hot, words) for rows (seed, dk, th, loc, hot)."""
    lists = wanted.groupBy("dk", "th").agg(F.collect_list(F.struct("seed", "loc", "hot")).alias("at"))  # a text's own pieces

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                rows = []
                for r in b.slice(lo, 512).to_pylist():
                    words = (r["text"] or "").encode("utf-8", "surrogatepass").split()
                    for x in r["at"]:
                        first = x["loc"] >> 24
                        rows.append((x["seed"], r["dk"], r["th"], x["loc"], x["hot"], b" ".join(words[first : first + (x["loc"] & 4095) - 1 + window])))
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["seed", "dk", "th", "loc", "hot", "words"])

    return docs.join(lists, ["dk", "th"]).select("dk", "th", "text", "at").mapInArrow(thrifty(run), "seed long, dk long, th long, loc long, hot boolean, words binary")


def _through_automata(placed: DataFrame, n_shards: int, window: int) -> DataFrame:
    """(dk, th, start, n): the windows of pieces that also start earlier."""

    def shard(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("seed", "dk", "th", "loc", "words"))), key=lambda r: (r[0], r[1], r[2], (r[3] >> 24) + (r[3] >> 12 & 4095)))
        out: list[tuple] = []
        automaton, before = SuffixAutomaton(), (None,)
        for seed, dk, th, loc, blob in rows:
            if seed != before[0]:
                automaton = SuffixAutomaton()
            elif (dk, th, loc) == before[1:]:
                continue  # a repeated row of the same document
            before = (seed, dk, th, loc)
            words = blob.split(b" ")
            first = loc >> 24
            out += [(dk, th, first + i - window + 1, 1) for i, size in enumerate(automaton.longest_matches(words)) if size >= window]
            automaton.add(words)
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("dk", "th", "start", "n"), cols)})

    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInArrow(shard, "dk long, th long, start long, n long")


def _first_windows(placed: DataFrame, window: int) -> DataFrame:
    """(dk, th, start): the earliest start of each window of pieces, by its words."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                rows = []
                for r in b.slice(lo, 4096).to_pylist():
                    words, first = r["words"].split(b" "), r["loc"] >> 24
                    rows += [(b" ".join(words[i : i + window]), r["dk"], r["th"], first + i) for i in range(len(words) - window + 1)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), *[pa.int64()] * 3))], ["words", "dk", "th", "start"])

    each = placed.select("words", "dk", "th", "loc").mapInArrow(thrifty(run), "words binary, dk long, th long, start long")
    return each.groupBy("words").agg(F.min(F.struct("dk", "th", "start")).alias("m")).select("m.*")


def repeated_spans(docs: DataFrame, window: int = 20, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """(dk, th, kind, start, n) of docs (dk, th, text): kind 0, n windows from start are removed; 1, so they are but for those of kind 2."""
    if not 1 <= window <= 4000:
        raise ValueError("window must be 1 to 4000 words")
    seed_words = max(1, 2 * window // 5)
    rows = _pieces_of(docs, window, seed_words).repartition("seed", "kind")
    same = Window.partitionBy("seed", "kind", "content").orderBy("dk", "th", "loc")
    seed = Window.partitionBy("seed", "kind")
    judged = (
        rows.withColumn("first", F.rank().over(same) == 1)
        .withColumn("rows", F.count("*").over(seed))
        .withColumn("contents", F.sum(F.col("first").cast("int")).over(seed))
        .where("kind = 1 or rows > 1")
        .where("kind = 1 or not first or contents > 1")
    )
    judged = materialize(judged.select("dk", "th", "loc", ((F.col("kind") == 1) | ~F.col("first")).alias("gone"), "seed", (F.col("contents") > hot_contents).alias("hot")), "substring-judged")
    piece = [F.shiftright("loc", 24).alias("start"), F.col("loc").bitwiseAND(4095).alias("n")]
    gone = judged.where("gone").select("dk", "th", F.lit(0).alias("kind"), *piece)
    open_ = judged.where("not gone")
    placed = materialize(_words_of_pieces(open_.select("seed", "dk", "th", "loc", "hot"), docs, window), "substring-pieces")
    n_shards = max(16, placed.where("not hot").count() // SHARD_PIECES)
    matched = _through_automata(placed.where("not hot"), n_shards, window).select("dk", "th", F.lit(0).alias("kind"), "start", "n")
    hot = open_.where("hot").select("dk", "th", F.lit(1).alias("kind"), *piece)
    stay = _first_windows(placed.where("hot"), window).select("dk", "th", F.lit(2).alias("kind"), "start", F.lit(1).cast("long").alias("n"))
    return gone.union(matched).union(hot).union(stay)


def substring_dedup(docs: DataFrame, window: int = 20, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """Remove every word that a window covers whose words also start earlier.

    Earlier is a smaller doc_id, or in the same document an earlier start; windows are
    judged on the input. Returns a row for each input row: doc_id, n_words,
    n_removed, kept_text (words joined by one space). A null text has no words.
    Null doc_ids come last. Rows that repeat both doc_id and text are one
    document, with equal results; rows that share an id only are in the order of a
    hash of their text. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = base.agg(F.count("*").alias("n"), F.count("doc_id").alias("set")).first()
    unique = ids["n"] == ids["set"] and base.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = base.withColumn("dk", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("th", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    spans = repeated_spans(keyed, window, hot_contents).groupBy("dk", "th").agg(F.collect_list(F.struct("kind", "start", "n")).alias("spans"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                ids_, sizes, removed, kept = [], [], [], []
                for r in b.slice(lo, 1024).to_pylist():
                    words = (r["text"] or "").encode("utf-8", "surrogatepass").split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if r["spans"]:
                        at = np.array([(s["kind"], s["start"], s["n"]) for s in r["spans"]], np.int64)
                        starts = np.zeros(len(words) + 1, np.int64)
                        for kind in (0, 1):
                            np.add.at(starts, at[at[:, 0] == kind, 1], 1)
                            np.add.at(starts, (at[:, 1] + at[:, 2])[at[:, 0] == kind], -1)
                            starts_on = np.cumsum(starts) > 0
                            if kind == 0:
                                always = starts_on.copy()
                        starts_on[at[at[:, 0] == 2, 1]] = False
                        first = np.flatnonzero(starts_on | always)
                        np.add.at(gone, first, 1)
                        np.add.at(gone, np.minimum(first + window, len(words)), -1)
                    stays = np.cumsum(gone)[: len(words)] == 0
                    left = words if stays.all() else [words[i] for i in np.flatnonzero(stays)]
                    ids_.append(r["doc_id"])
                    sizes.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids_, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return keyed.join(spans, ["dk", "th"], "left").select("doc_id", "text", "spans").mapInArrow(thrifty(run), "doc_id long, n_words long, n_removed long, kept_text string")
