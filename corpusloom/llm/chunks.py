"""Dictionary-coded chunks of a corpus, and joins between distinct words and positions.

A chunk is a run of whole documents with its own dictionary: the chunk's distinct
words, and for every position the number of its word. What depends on a
word is worked out once for each distinct word of the corpus, in the bucket of its
hash, and goes back to the chunks that have the word, where positions look it up.
So shuffles carry each chunk's distinct words, and not its positions; both travel
compressed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from corpusloom.llm.common import give_back, thrifty

CHUNK_WORDS = 1 << 19
#: A chunk's text in characters, which bounds dictionaries of very long words.
CHUNK_CHARS = 1 << 23
PACKED = "chunk long, doc_ids array<long>, learn array<boolean>, ends binary, codes binary, words binary, counts binary"


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n

    def codes(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))

    def listed(self) -> list[bytes]:
        return list(self)


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data if isinstance(data, bytes) else data.tobytes())


def unsqueeze(data: bytes, dtype=None):
    out = zstandard.ZstdDecompressor().decompress(data)
    return out if dtype is None else np.frombuffer(out, dtype)


def squeeze_codes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, a plane of bytes after the other; the planes of small numbers vanish."""
    return squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze_codes(data: bytes) -> np.ndarray:
    planes = unsqueeze(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def dump_words(words: list[bytes]) -> bytes:
    return squeeze(np.array([len(words), *map(len, words)], np.uint32).tobytes() + b"".join(words))


def load_words(data: bytes) -> list[bytes]:
    raw = unsqueeze(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.r_[4 * (n + 1), ends[:-1]] if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def pack(docs: DataFrame, code: Callable[[str, Numbers], np.ndarray], numbers: type[Numbers] = Numbers, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows of PACKED from docs (doc_id long, text, learn boolean); null text is empty.

    ``code`` gives the numbers of a text's words, and enters new ones in the chunk's dictionary.
    A chunk closes at the first document that brings it to ``chunk_words`` words or CHUNK_CHARS characters.
    Its name is a hash of its content and place, so that two evaluations of docs agree on
    names exactly where they agree on chunks, and no two chunks share one.
    ``ends`` holds each document's end among ``codes``; ``counts`` how often each
    word is in documents to learn from.
    """

    def run(batches):
        place, made = TaskContext.get().partitionId() << 32, 0
        number = numbers()
        ids, learn, parts, total, chars = [], [], [], 0, 0

        def out():
            nonlocal made
            sizes = np.array([len(p) for p in parts], np.int64)
            codes = np.concatenate(parts)
            order = np.argsort(-np.bincount(codes, minlength=len(number)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            codes = rank[codes]
            counts = np.bincount(codes[np.repeat(np.array(learn, bool), sizes)], minlength=len(number))
            listed = number.listed()
            words, packed = dump_words([listed[i] for i in order.tolist()]), squeeze_codes(codes)
            chunk = xxhash.xxh64_intdigest(words + packed, (place + made) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
            made += 1
            row = (chunk, ids, learn, squeeze(np.cumsum(sizes)), packed, words, squeeze(counts.astype(np.int32)))
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["chunk", "doc_ids", "learn", "ends", "codes", "words", "counts"])

        for b in batches:
            for lo in range(0, b.num_rows, 256):  # few texts at a time as Python strings
                part = b.slice(lo, 256)
                for doc_id, text, use in zip(*(part.column(i).to_pylist() for i in range(3))):
                    ids.append(doc_id)
                    learn.append(bool(use))
                    parts.append(code(text, number) if text else np.zeros(0, np.uint32))
                    total += len(parts[-1])
                    chars += len(text or "")
                    if total >= chunk_words or chars >= CHUNK_CHARS:
                        yield out()
                        number.clear()
                        ids, learn, parts, total, chars = [], [], [], 0, 0
        if ids:
            yield out()

    return docs.select("doc_id", "text", "learn").mapInArrow(thrifty(run), PACKED)


def buckets_of(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket, and the words' order by bucket."""
    bucket = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def number_of_buckets(n_chunks: int) -> int:
    return max(128, n_chunks // 32)


def to_buckets(packed: DataFrame, n: int) -> DataFrame:
    """(bucket, chunk, words, counts): each chunk's distinct words, dealt by hash."""

    def run(batches):
        for b in batches:
            for chunk, blob, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "counts"))):
                words, counts = load_words(blob), unsqueeze(counts, np.int32)
                bucket, order = buckets_of(words, n)
                sorted_ = bucket[order]
                cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(words) else np.zeros(1, np.int64)
                rows = [(int(sorted_[a]), order[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([k for k, _ in rows], pa.int32()),
                        "chunk": pa.array([chunk] * len(rows), pa.int64()),
                        "words": pa.array([dump_words([words[i] for i in at]) for _, at in rows], pa.binary()),
                        "counts": pa.array([squeeze(counts[at]) for _, at in rows], pa.binary()),
                    }
                )

    # all columns, so that a shuffle of packed by chunk can serve both this and at_chunks
    return packed.mapInArrow(thrifty(run), "bucket int, chunk long, words binary, counts binary")


def at_chunks(packed: DataFrame, answers: DataFrame, finish: Callable[[dict, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """finish(chunk's row, {bucket: answer}) for every chunk; answers: (chunk, bucket, answer)."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right["bucket"].to_pylist(), right["answer"].to_pylist()))
        out = pa.concat_tables([finish(row, found) for row in left.to_pylist()])
        give_back()
        return out

    return packed.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "answer").groupBy("chunk")).applyInArrow(meet, schema)
