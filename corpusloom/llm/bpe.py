"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words where the tokenizer's byte-level pre-tokenizer is sure to
cut them, too; each distinct word of the corpus is encoded once, by the
tokenizer itself, and its ids go back to the positions that hold it. Decoding
joins ids with the vocabulary's pieces, once a distinct word, and the
decoded words go back by position alike.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.chunks import Numbers, at_chunks, buckets_of, dump_words, load_words, number_of_buckets, pack, squeeze_codes, to_buckets, unsqueeze, unsqueeze_codes
from corpusloom.llm.common import small_batches, thrifty

#: Words of a chunk; few chunks mean few repeats of a word in what is shuffled.
CHUNK_WORDS = 1 << 20
#: Words encoded at once, and words whose ids a task remembers at most.
SLICE, MEMO = 4096, 1_000_000


def read_tokenizer(path: str) -> str:
    """A tokenizer file without truncation and padding; it must be byte-level BPE without a normaliser or prefix space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} is not plain byte-level BPE")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        raise ValueError(f"{path} has added tokens that take in their neighbours")
    return json.dumps(spec | {"truncation": None, "padding": None})


@functools.cache
def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def pieces(spec: str) -> dict[int, bytes]:
    """The bytes of each id; an added token's are its text."""
    parsed, alphabet = json.loads(spec), byte_of_char()
    out = {i: bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p, i in parsed["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}


#: Stands before a part that no space precedes; a lone surrogate is in no text.
MARK = "\udc80"


class Words(Numbers):
    """Numbers the words of texts; see :func:`code_words` for what a key stands for.

    ``flags`` tells of each part whether it starts with white space or nothing (1), ends so (2), ends with
    anything but a letter or a digit (4), and whether it starts with MARK (8).
    """

    def __init__(self):
        self.flags = bytearray()

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        marked = part[:1] == MARK
        first = part[1:2] if marked or part[:1] == "\n" else part[:1]
        last = part[-2:-1] if part[-1:] == " " else part[-1:]
        bare = not last or last.isspace()
        self.flags.append((not first or first.isspace()) | bare << 1 | (bare or not last.isalnum() or last > "\u024f") << 2 | marked << 3)
        return n

    def clear(self) -> None:
        super().clear()
        self.flags.clear()

    def listed(self) -> list[bytes]:
        return [(k[:-1] if k[-1:] == " " else _read(k)).encode() for k in self]


def _read(part: str) -> str:
    return part if part[:1] == "\n" else part[1:] if part[:1] == MARK else " " + part


def code_words(text: str, number: Words) -> np.ndarray:
    """Numbers of a text's words.

    A word starts at each space and line feed that stands between two characters other than white space,
    and at each comma and full stop after a letter or digit: there every match of the pre-tokenizer's pattern
    ends, whatever surrounds it. A part p, without spaces, stands for the space before it and p, or for p
    if it starts with a line feed, or for what follows MARK; a key that ends with a space stands for what is before that space.
    """
    parts = text.replace("\n", " \n").replace(",", f" {MARK},").replace(".", f" {MARK}.").split(" ")
    parts[0] += " "
    codes = number.codes(parts)
    flags = np.frombuffer(number.flags, np.uint8)[codes]
    joined = (flags[1:] & 1) | (flags[:-1] >> 1 & 1) | (flags[1:] >> 3 & flags[:-1] >> 2 & 1)
    if not joined.any():
        return codes
    starts = np.flatnonzero(np.r_[True, joined == 0])
    ends = np.r_[starts[1:], len(parts)]
    out = codes[starts]
    for i in np.flatnonzero(ends - starts > 1).tolist():
        a, b = int(starts[i]), int(ends[i])
        whole = (parts[0][:-1] if a == 0 else _read(parts[a])) + "".join(map(_read, parts[a + 1 : b]))
        out[i] = number[whole + " "]
    return out


def encode_words(buckets: DataFrame, shared) -> DataFrame:
    """(chunk, bucket, answer): the ids of each word, each distinct word encoded once, and what they decode to.

    A bucket's words all come to one task, one bucket after the other; the task remembers the
    ids of the bucket's words. Decoding joins ids with the column of pieces, which is dense in ids: a
    take by id. Words mostly decode to themselves; the answer lists those that do not.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec = shared.value
        tokenizer = Tokenizer.from_str(spec)
        known: dict[bytes, bytes] = {}
        other: dict[bytes, bytes] = {}
        of_id = pieces(spec)
        column = pa.array([of_id.get(i, b"") for i in range(max(of_id, default=-1) + 1)], pa.binary())
        del of_id

        def learn(new: list[bytes]) -> None:
            ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(ends[-1]))
            joined = column.take(pa.array(flat))
            stops = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[ends].tolist()
            data = joined.buffers()[2].to_pybytes() if len(joined) else b""
            a = at = 0
            for w, b, stop in zip(new, ends.tolist(), stops):
                known[w] = flat[a:b].tobytes()
                if data[at:stop] != w:
                    other[w] = data[at:stop]
                a, at = b, stop

        last = None
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, answers = b.slice(lo, 64), []
                for bucket, blob in zip(part.column("bucket").to_pylist(), part.column("words")):
                    words = load_words(blob.as_py())
                    if bucket != last or len(known) > MEMO:
                        known.clear()
                        other.clear()
                        last = bucket
                    new = [w for w in words if w not in known]
                    for at in range(0, len(new), SLICE):
                        learn(new[at : at + SLICE])
                    ids = [known[w] for w in words]
                    odd = [i for i, w in enumerate(words) if w in other] if other else []
                    sizes = [len(x) // 4 for x in ids]
                    numbers = squeeze_codes(np.concatenate([np.array([len(ids), len(odd), *sizes, *odd], np.uint32), np.frombuffer(b"".join(ids), np.uint32)]))
                    answers.append(len(numbers).to_bytes(4, "little") + numbers + (dump_words([other[words[i]] for i in odd]) if odd else b""))
                yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("bucket"), pa.array(answers, pa.binary())], ["chunk", "bucket", "answer"])

    n = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = buckets.select("bucket", "chunk", "words").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(thrifty(run), "chunk long, bucket int, answer binary")


class WordIds:
    """What is known of a chunk's words: of word i, ids[start[i]:start[i] + size[i]], and the bytes these decode to."""

    def __init__(self, words: list[bytes], answers: dict[int, bytes], n_buckets: int):
        self.words = self.decoded = words
        _, order = buckets_of(words, n_buckets)
        sizes, ids, at = [], [], 0
        for k in sorted(answers):
            cut = 4 + int.from_bytes(answers[k][:4], "little")
            raw = unsqueeze_codes(answers[k][4:cut])  # words, words listed, lengths, places of those listed, ids
            n, odd = int(raw[0]), int(raw[1])
            sizes.append(raw[2 : n + 2].astype(np.int64))
            ids.append(raw[n + odd + 2 :].astype(np.int32))
            if odd:
                if self.decoded is words:
                    self.decoded = list(words)
                for i, back in zip(raw[n + 2 : n + odd + 2].tolist(), load_words(answers[k][cut:])):
                    self.decoded[int(order[at + i])] = back
            at += n
        if at != len(words):
            raise RuntimeError("the texts or their partitions changed between two reads; write them as a table first")
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.size, self.start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.size[order], self.start[order] = sizes, np.cumsum(sizes) - sizes

    def of_word(self, i: int) -> np.ndarray:
        return self.ids[self.start[i] : self.start[i] + self.size[i]]

    def of_text(self, codes: np.ndarray) -> np.ndarray:
        """The ids of a run of words."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, tokenizer_path: str, finish, schema: str) -> DataFrame:
    """Encode whole texts; finish(doc_ids, codes of each document, what is known of the words) makes each chunk's rows.

    tokenizer_path is read on the driver; executors get its content.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    spec = read_tokenizer(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("learn"))
    # the shuffle by chunk feeds both sides: texts are split once, and positions are on disk once
    packed = pack(rows, code_words, Words, CHUNK_WORDS).repartition("chunk")
    n = number_of_buckets(rows.count() // 4096)
    answers = encode_words(to_buckets(packed, n), spark.sparkContext.broadcast(spec))  # a vocabulary file, whatever the corpus' size

    def one(row: dict, found: dict[int, bytes]) -> pa.Table:
        codes, ends = unsqueeze_codes(row["codes"]), unsqueeze(row["ends"], np.int64)
        texts = [codes[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())] if len(ends) else []
        return finish(row["doc_ids"], texts, WordIds(load_words(row["words"]), found, n))

    return at_chunks(packed, answers, one, schema)


def encode_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each input row; null and empty texts have no ids."""

    def finish(doc_ids, texts, ids):
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([ids.of_text(t) for t in texts], pa.list_(pa.int32()))})

    return encode(docs, tokenizer_path, finish, "doc_id long, ids array<int>")


def encode_checked(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_ok) for each input row; decoded_ok: the ids' pieces make the text again."""

    def finish(doc_ids, texts, ids):
        out, same = [], []
        for t in texts:
            out.append(ids.of_text(t))
            same.append(ids.decoded is ids.words or all(ids.decoded[c] == ids.words[c] for c in t.tolist()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) for x in out], pa.int64()), "ids": pa.array(out, pa.list_(pa.int32())), "decoded_ok": pa.array(same, pa.bool_())})

    return encode(docs, tokenizer_path, finish, "doc_id long, n_tokens long, ids array<int>, decoded_ok boolean")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` through a join with the vocabulary's pieces; unknown ids give nothing.

    The rows' other columns stay; bytes that are no UTF-8 become U+FFFD. The
    vocabulary is a broadcast table of a fixed size.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame(sorted(pieces(read_tokenizer(tokenizer_path)).items()), "id int, piece binary")
    rows = encoded.withColumn("row_", F.monotonically_increasing_id())
    placed = rows.select("row_", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    joined = placed.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    data = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["piece"]))
    texts = joined.select("row_", F.make_valid_utf8(data.cast("string")).alias("text"))
    return rows.drop("text").join(texts, "row_", "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("row_")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode each text, join its ids with their pieces, and digest both.

    Returns a row for each input row: doc_id, n_tokens, ids_sha256 (of the decimal
    ids, joined by commas), decoded_sha256 (of the decoded text). Null and empty
    texts have no tokens. Repeated rows give repeated results; other columns are
    ignored.
    """

    def finish(doc_ids, texts, ids):
        shown = [",".join(map(str, ids.of_word(i).tolist())) for i in range(len(ids.words))]
        counts, first, second = [], [], []
        for t in texts:
            at = t.tolist()
            counts.append(int(ids.size[t].sum()) if at else 0)
            first.append(hashlib.sha256(",".join(map(shown.__getitem__, at)).encode()).hexdigest())
            second.append(hashlib.sha256(b"".join(map(ids.decoded.__getitem__, at)).decode("utf-8", "replace").encode()).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})

    return encode(docs, tokenizer_path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
