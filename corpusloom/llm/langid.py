"""Language identification by language-bitmask n-gram filters.

Each learned language has a Bloom filter of its characteristic character
n-grams. The filters are stored bit-sliced: slot s of the table holds a bitmask
with one bit for each language, so one look-up of an n-gram's slots, and-ed,
returns all languages that contain it. A text's n-grams are counted for each
language; the counts are corrected for the filter's false-positive rate, and the
highest decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import crc_mod, materialize, small_batches, thrifty

UNDETERMINED = "und"
SLOTS = 1 << 20
#: Odd multipliers of the filters' multiply-shift hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Characters whose n-grams are held at once.
TILE = 1 << 18
#: An n-gram is its code points packed in 21 bits each, so at most three.
ORDERS = (2, 3)


@functools.cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str, orders: tuple[int, ...]):
    """Packed n-grams of the whole text in lower case, a tile at a time; None if it has no letter.

    Whatever is not a letter counts as a space; an n-gram may have a space at its
    start or its end, and at least one letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.uint64)
    is_letter = np.concatenate([[False], is_letter, [False]])

    def tiles():
        for lo in range(0, len(points), TILE):
            for n in orders:
                c, ok = points[lo : lo + TILE + n - 1], is_letter[lo : lo + TILE + n - 1]
                m = len(c) - n + 1
                if m <= 0:
                    continue
                key, inner = c[:m].copy(), ok[1 : m + 1].copy() if n > 2 else ok[:m] | ok[1 : m + 1]
                for i in range(1, n):
                    key = key << np.uint64(21) | c[i : m + i]
                    if 1 < i < n - 1:
                        inner &= ok[i : m + i]
                yield key[inner]

    return tiles()


class BitSlicedFilters:
    """One Bloom filter for each language, in one table of bitmasks: planes of 8 languages."""

    def __init__(self, languages: list[str], orders: tuple[int, ...], n_slots: int = SLOTS):
        self.languages, self.orders, self.bits = languages, orders, n_slots.bit_length() - 1
        self.planes = [np.zeros(n_slots, np.uint8) for _ in range(-(-len(languages) // 8))]
        self.false_positive = np.zeros(len(languages))

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        return [((grams * np.uint64(m)) >> np.uint64(64 - self.bits)).astype(np.int64) for m in MULTIPLIERS]

    def add(self, language: int, grams: np.ndarray) -> None:
        plane, bit = divmod(language, 8)
        for at in self.slots(grams):
            self.planes[plane][at] |= np.uint8(1 << bit)
        fill = np.count_nonzero(self.planes[plane] & np.uint8(1 << bit)) / (1 << self.bits)
        self.false_positive[language] = fill ** len(MULTIPLIERS)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each plane the bitmask of the languages that have each n-gram, but for false positives."""
        at = self.slots(grams)
        return [p[at[0]] & p[at[1]] & p[at[2]] for p in self.planes]

    def counts(self, text: str) -> np.ndarray | None:
        """n-grams of a text that each language has, then their number; None without a letter."""
        parts = ngrams(text, self.orders)
        if parts is None:
            return None
        out = np.zeros(len(self.languages) + 1)
        for grams in parts:
            out[-1] += len(grams)
            for i, mask in enumerate(self.masks(grams)):
                seen = np.bincount(mask, minlength=256)
                for bit in range(min(8, len(self.languages) - 8 * i)):
                    out[8 * i + bit] += seen[np.arange(256) >> bit & 1 == 1].sum()
        return out

    def decide(self, counts: np.ndarray) -> tuple[str, float]:
        """Highest corrected popcount, and its share of all languages'."""
        true = np.maximum(0, (counts[:-1] - counts[-1] * self.false_positive) / (1 - self.false_positive))
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def train(docs: DataFrame, sample_docs: int = 1500, grams_per_language: int = 20000, orders: tuple[int, ...] = ORDERS, share: float = 0.35) -> BitSlicedFilters:
    """Filters from rows (doc_id, text, lang); null texts and langs are left out.

    Learns from a bounded sample: about ``sample_docs`` documents of each language,
    by a hash of the id, whole texts. A language's filter gets the n-grams whose
    frequency in it is at least ``share`` of their highest in any language, the
    most frequent ``grams_per_language`` of them. Languages are in order of
    their number of documents, so ties go to the more frequent.
    """
    rows = docs.where("text is not null and lang is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    languages = [r["lang"] for r in sizes]
    filters = BitSlicedFilters(languages, orders)
    if not languages:
        return filters
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, sample_docs / r["count"]) * (1 << 30))))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part[F.col("lang")])
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        for b in batches:
            seen: dict[int, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in ngrams(text, orders) or ():
                    seen.setdefault(number[lang], []).append(np.unique(part, return_counts=True))
            for lang, parts in seen.items():
                keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(keys), lang, np.int32)), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    counts = sample.select("text", "lang").mapInArrow(thrifty(count), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-grams")
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(of_lang), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row for each language
    top = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("rate") >= share * F.col("most")) & (F.col("n") > 1))
    kept = top.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).where(F.col("nth") <= grams_per_language)
    grams: dict[int, list[int]] = {}
    for r in kept.select("lang", "gram").toLocalIterator():  # grams_per_language rows for each language
        grams.setdefault(r["lang"], []).append(r["gram"])
    for lang, found in grams.items():
        filters.add(lang, np.array(found, np.uint64))
    return filters


def predict(docs: DataFrame, filters: BitSlicedFilters, keep_text: bool = False) -> DataFrame:
    """The input's columns, text only if keep_text, plus lang_pred and score, from whole texts."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)  # SLOTS bitmasks, whatever the corpus' size
    keep = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        model = shared.value
        for whole in batches:
            for b in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                langs, scores = [], []
                for text in b.column("text").to_pylist():
                    seen = model.counts(text) if text and model.languages else None
                    lang, score = (UNDETERMINED, 0.0) if seen is None else model.decide(seen)
                    langs.append(lang)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*[f.name for f in keep], "lang_pred", "score"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "lang_pred string", "score double"])
    return docs.mapInArrow(thrifty(run), ddl)


def identify_languages(docs: DataFrame, folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Learn from the rows outside one fold of ids and predict all.

    Returns a row for each input row: doc_id, held_out, lang_pred, score. A null or
    letterless text gives ``und`` and score 0. A text with letters that no filter
    has gets the most frequent language and score 0. Rows with a null doc_id are
    never learned from and not held out. If nothing can be learned every text
    is ``und``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = crc_mod(F.col("doc_id"), folds)
    filters = train(rows.where(fold != held_out), **options)
    return predict(rows.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text"), filters)
