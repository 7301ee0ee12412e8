"""Document quality by a linear-chain conditional random field over lines.

The field labels every line good or bad from features of the line and of its
neighbours. It is trained on lines that take their document's label; lines of
bad documents that the first field finds good are then relabelled, and it is
trained again. Forward-backward gives each line's probability of being good, and
a document's quality is their mean by length, put on a probability scale by a
logistic curve fitted on the training documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import crc_mod, materialize, small_batches, thrifty

#: Own features of a line; the field also sees the previous and the next line's.
FEATURES = ("bias", "log_words", "symbols", "digits", "upper", "pipes", "repeats", "variety", "long_words", "short_words", "end_mark", "odd_ends", "same_as_previous", "capital_words", "mean_length")
UPPER, DIGIT, LETTER, SPACE, HIGH, PIPE, PLAIN = 1, 2, 4, 8, 16, 32, 64


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        if c >= 128:
            kind[c] = HIGH
        elif ch.isalpha():
            kind[c] = LETTER | (UPPER if ch.isupper() else 0)
        elif ch.isdigit():
            kind[c] = DIGIT
        elif ch in " \t\n\v\f\r":
            kind[c] = SPACE
        elif ch in ".,;:'\"-?()":
            kind[c] = PLAIN
        elif ch == "|":
            kind[c] = PIPE
    return kind


KINDS = _classes()


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each line; empty lines are all zero but for the bias."""
    out = np.zeros((len(lines), len(FEATURES)))
    out[:, 0] = 1
    previous: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        if not words:
            previous = set()
            continue
        n = len(words)
        different = set(words)
        kind = KINDS[np.frombuffer(line, np.uint8)]
        size = max(1, len(line) - np.count_nonzero(kind & SPACE))
        letters = np.count_nonzero(kind & (LETTER | HIGH))
        adjacent = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
        lengths = np.fromiter(map(len, words), np.int64, n)
        last = KINDS[np.fromiter((w[-1] for w in words), np.uint8, n)]
        first = KINDS[np.fromiter((w[0] for w in words), np.uint8, n)]
        out[i, 1:] = (
            np.log1p(n) / 5,
            np.count_nonzero(kind == 0) / size,
            np.count_nonzero(kind & DIGIT) / size,
            np.count_nonzero(kind & UPPER) / max(1, letters),
            np.count_nonzero(kind & PIPE) / n,
            adjacent,
            len(different) / n,
            np.count_nonzero(lengths > 20) / n,
            np.count_nonzero(lengths < 4) / n,
            float(line.rstrip()[-1:] in (b".", b"!", b"?")),
            np.count_nonzero(last == 0) / n,
            len(different & previous) / len(different),
            np.count_nonzero(first & UPPER) / n,
            lengths.mean() / 10,
        )
        previous = different
    return out


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features with neighbours, length in bytes) of each line of a whole text; a null or empty text is one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    own = line_features(lines)
    pad = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad])]), np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))


class LineField:
    """Two-state chain: emission weights for good against bad, and transition scores."""

    def __init__(self, n_features: int):
        self.weights, self.transitions, self.curve = np.zeros(n_features), np.zeros((2, 2)), (4.0, 0.0)

    def marginals(self, emission: np.ndarray, sizes: np.ndarray):
        """Probability that each line is good, the pairs' marginals, and log-partition, for chains of ``sizes`` lines.

        emission: score of good (bad is 0) of all lines, chain after chain. All
        chains advance together, longest first, one line at a time.
        """
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(np.r_[0, sizes[:-1]])[order]
        lengths = sizes[order]
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        forward = np.zeros((len(emission), 2))
        backward = np.zeros((len(emission), 2))
        t = self.transitions
        scores = np.stack([np.zeros(len(emission)), emission], axis=1)
        for i in range(longest):
            at = starts[: alive[i]] + i
            if i == 0:
                forward[at] = scores[at]
            else:
                before = forward[at - 1]
                forward[at] = scores[at] + np.logaddexp(before[:, :1] + t[0], before[:, 1:] + t[1])
        for i in range(longest - 2, -1, -1):
            at = starts[: alive[i + 1]] + i
            after = backward[at + 1] + scores[at + 1]
            backward[at] = np.logaddexp(after[:, :1] + t[:, 0], after[:, 1:] + t[:, 1])
        both = forward + backward
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - log_z)
        return good, forward, backward, scores, log_z

    def fit(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weight: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the conditional likelihood; weight: of each line's chain."""
        first = np.cumsum(np.r_[0, sizes[:-1]])
        inner = np.ones(len(y), bool)
        inner[first] = False
        nxt = np.flatnonzero(inner)
        m = v = np.zeros(len(self.weights) + 4)
        param = np.r_[self.weights, self.transitions.ravel()]
        n = weight.sum()
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[nxt - 1], y[nxt]), weight[nxt])
        for step in range(1, rounds + 1):
            self.weights, self.transitions = param[:-4], param[-4:].reshape(2, 2)
            good, forward, backward, scores, log_z = self.marginals(x @ self.weights, sizes)
            pair = np.exp(forward[nxt - 1][:, :, None] + self.transitions[None] + (scores[nxt] + backward[nxt])[:, None, :] - log_z[nxt][:, None, None])
            slope = np.r_[x.T @ (weight * (y - good)), (seen - (pair * weight[nxt, None, None]).sum(axis=0)).ravel()] / n - penalty * param
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            param = param + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.transitions = param[:-4], param[-4:].reshape(2, 2)

    def quality(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each chain's lines."""
        good = self.marginals(x @ self.weights, sizes)[0]
        at = np.cumsum(np.r_[0, sizes[:-1]])
        return np.add.reduceat(good * lengths, at) / np.add.reduceat(lengths, at)

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def fit_curve(quality: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve on the log-odds of quality, by Newton's method with a small penalty."""
    q = np.clip(quality, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(q / (1 - q)), np.ones(len(q))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (label - p) - 0.1 * (beta - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(max(beta[0], 0.01)), float(beta[1])


def train(labelled: DataFrame, sizes: dict[int, int], sample_lines: int = 200_000) -> LineField:
    """A field from rows (doc_id, text, quality) of a sample of the labels; whole texts.

    sizes: of each label 0 and 1 in all. Of the sample, whole documents count as long as their lines do not
    pass ``sample_lines``, the shortest first, so that what the driver gets is bounded. The curve
    weights documents back to the labels' shares in all. With no rows, or one label only, the
    field knows nothing and scores are the share of good labels (1 if there are none).
    """
    field = LineField(3 * len(FEATURES))
    if len(sizes) < 2:
        field.curve = (0.01, 9.0 if 0 not in sizes else -9.0)
        return field

    def run(batches):
        for b in batches:
            found = [document_features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"quality": b.column("quality"), "x": pa.array([f[0].astype(np.float32).tobytes() for f in found], pa.binary()), "lengths": pa.array([f[1].tobytes() for f in found], pa.binary()), "doc_id": b.column("doc_id")}
            )

    rows = labelled.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(thrifty(run), "quality int, x binary, lengths binary, doc_id long")
    found = materialize(rows.withColumn("n_lines", F.octet_length("lengths") / 8).withColumn("h", F.xxhash64("doc_id", "x")), "quality-sample")  # sample_docs rows
    upto = found.select("h", F.sum("n_lines").over(Window.orderBy("n_lines", "h")).alias("upto")).where(F.col("upto") <= sample_lines).select("h").distinct()
    got = found.join(F.broadcast(upto), "h", "left_semi").orderBy("doc_id", "x").collect()  # at most sample_lines lines
    drawn = {k: sum(r["quality"] == k for r in got) for k in sizes}
    if len({r["quality"] for r in got}) < 2:
        field.curve = (0.01, float(np.log((sizes[1] + 1) / (sizes[0] + 1))))
        return field
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, 3 * len(FEATURES)).astype(float) for r in got]
    x, n_lines = np.vstack(xs), np.array([len(a) for a in xs])
    lengths = np.concatenate([np.frombuffer(r["lengths"], np.int64) for r in got]).astype(float)
    label = np.array([r["quality"] for r in got])
    y = np.repeat(label, n_lines)
    weight = np.repeat(1 / np.sqrt(n_lines), n_lines)
    field.fit(x, y, n_lines, weight)
    good = field.marginals(x @ field.weights, n_lines)[0]
    at = np.cumsum(np.r_[0, n_lines[:-1]])
    worst = np.repeat(np.minimum.reduceat(good, at), n_lines)
    y2 = np.where((np.repeat(label, n_lines) == 0) & (good > 0.5) & (good > worst + 0.2), 1, y)
    field.fit(x, y2, n_lines, weight, rounds=100)
    field.curve = fit_curve(field.quality(x, lengths, n_lines), label)
    field.curve = (field.curve[0], field.curve[1] + float(np.log((drawn[0] / sizes[0]) / (drawn[1] / sizes[1]))))
    return field


def score_documents(docs: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """Input columns but text, with score (0 to 1) and predicted; whole texts, null as empty."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    weights = (field.weights, field.transitions, field.curve)  # a few dozen numbers

    def run(batches):
        model = LineField(0)
        model.weights, model.transitions, model.curve = weights
        for b in batches:
            scores = []
            texts = b.column("text")
            for lo in range(0, len(texts), 256):
                found = [document_features(t) for t in texts.slice(lo, 256).to_pylist()]
                q = model.quality(np.vstack([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(float), np.array([len(f[1]) for f in found]))
                scores.append(model.score(q))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*[f.name for f in keep], "score", "predicted"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "score double", "predicted int"])
    return docs.mapInArrow(thrifty(run), ddl)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_docs: int = 4000, sample_lines: int = 200_000) -> DataFrame:
    """Learn from labelled rows outside one fold of ids and score every document.

    Returns a row for each input row: doc_id, held_out, score, predicted. Empty and
    null texts are scored as one empty line. Null doc_ids are scored, not learned
    from and not held out. Of repeated labels of an id the smallest counts; null
    labels do not count, nor do those other than 0 and 1. Learns from about ``sample_docs``
    labels, half of each where there are enough, by a hash of the id, and at most ``sample_lines`` lines of them, the documents of
    the most lines left out first.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = crc_mod(F.col("doc_id"), folds)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").where(fold != held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where("quality in (0, 1)")
    sizes = _sizes(marks)
    labelled = rows.join(F.broadcast(_bounded(marks, sizes, sample_docs)), "doc_id").select("doc_id", "text", "quality")
    field = train(labelled, sizes, sample_lines)
    return score_documents(rows.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text"), field)


def _sizes(marks: DataFrame) -> dict[int, int]:
    return {int(r["quality"]): r["count"] for r in marks.groupBy("quality").count().collect()}  # a row for each label


def _bounded(marks: DataFrame, sizes: dict[int, int], sample_docs: int) -> DataFrame:
    """Labels of the sample only, about half of sample_docs of each: a side that stays small at any size of the corpus."""
    share = F.lit(0)
    for k, n in sizes.items():
        share = F.when(F.col("quality") == k, int(min(1.0, sample_docs / 2 / n) * (1 << 30))).otherwise(share)
    return marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
