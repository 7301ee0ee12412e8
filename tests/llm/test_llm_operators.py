"""Each operator against brute force, and on tables with nulls, empty texts, repeats, clashing names and no rows."""

import base64
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusloom.llm import bpe, class_lm, exact_dedup, langid, mixing, quality, simhash, substring_dedup, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, rank string, words string, kind string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_rows():
    rng = random.Random(7)
    vocabulary = ["one", "two", "Three", "four", "été", "fünf", "<|endoftext|>", "漢字"]
    texts = [None, "", " \t\n", "x", "x", "a  b\tc", "a b c", "a b\nc", "A B C", "!!! 123", "\x85 \xa0", "word " * 60]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2", "s0"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "a b c", "en", "s1"), (None, None, None, None), (3, "another text of an id that repeats", "fr", "s2"), (99, "long " * 30000, "en", "s1")]
    return [(*r, len(r[1]) if r[1] else None, "q", "q", "q", "q", "q") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash_matches_brute_force(spark, docs):
    def print_of(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.simhash_dedup(docs).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    prints = [(r[0], print_of(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    group = {p: {p} for _, p in prints}
    for a, b in itertools.combinations(list(group), 2):
        if bin(a ^ b).count("1") <= 2:
            merged = group[a] | group[b]
            for p in merged:
                group[p] = merged
    least = {p: min((i for i, q in prints if q in group[p] and i is not None), default=None) for p in group}
    assert all(r.component_id == least[int(r.fingerprint, 16)] for r in got)


def test_every_close_pair_shares_an_anchor(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    close = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2))) for x in base]
    values = np.array(base + close + [rng.getrandbits(64) for _ in range(200)], np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v, v) for v in values], "fp long, node long")
    found = {frozenset((r.a, r.b)) for r in simhash.links(nodes, 2).collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert found == want


def test_exact_dedup(docs):
    import re

    got = exact_dedup.exact_dedup(docs).collect()
    norm = collections.defaultdict(list)
    for r in odd_rows():
        norm[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(odd_rows())
    for r in got:
        ids = norm[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(norm, 1)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**63, 500).astype(np.uint64) % 997 * np.uint64(2**54 + 1) for _ in range(5)] + [np.zeros(0, np.uint64)]
    filters = [exact_dedup.CountingQuotientFilter.build(p, 12) for p in parts]
    again = [exact_dedup.CountingQuotientFilter.unpack(f.pack(), 12) for f in filters]
    merged = exact_dedup.CountingQuotientFilter.merge(again)
    want = collections.Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == want and (np.diff(merged.fingerprints().astype(object)) > 0).all()
    pieces = [p for f in filters for p in f.segments(3)]
    assert {s for s, _ in pieces} <= set(range(8))
    by = {s: exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.unpack(p, 12) for t, p in pieces if t == s]) for s, _ in pieces}
    assert sum((collections.Counter(dict(zip(f.fingerprints().tolist(), f.counts.tolist()))) for f in by.values()), collections.Counter()) == want


def test_exact_dedup_without_a_broadcast_gives_the_same(docs, monkeypatch):
    few = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_FINGERPRINTS", 0)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == few


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [round(float(x), 2) for x in rng.normal(size=6)], "z", 1) for i in range(120)]
    vectors += [(200, None, "z", 1), (201, [1.0, None], "z", 1), (202, [float("nan")] * 6, "z", 1), (300, [0.0] * 6, "z", 1), (5, vectors[5][1], "z", 1), (None, [1.0] * 6, "z", 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string, rank int")
    rows = topk.sparse_rows(table, "vec_id", "embedding")
    got = topk.exact_topk(rows.where("id % 20 = 0"), rows, 10, query_block=4, corpus_block=32).collect()
    known = [(v[0], [math.floor(1024 * float(np.float32(x))) for x in v[1]]) for v in vectors if v[0] not in (200, 201, 202, None)]  # 5 is there twice
    for at, (q, own) in enumerate(known):
        if q % 20 == 0:
            want = sorted(((sum(a * b for a, b in zip(own, v)), -i) for k, (i, v) in enumerate(known) if k != at), reverse=True)[:10]
            assert [(r.score, -r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_topk_of_rows_that_repeat_an_id_and_of_large_components(spark):
    table = spark.createDataFrame([(100, [2.9e6]), (100, [2.0]), (7, [2.9e6]), (8, [-2.9e6])], "vec_id long, embedding array<double>")
    rows = topk.sparse_rows(table, "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(rows.where("id = 100"), rows, 2).collect())
    big = 2969600000
    assert got == [(100, 1, 7, 2048 * big), (100, 1, 7, big * big), (100, 2, 100, 2048 * big), (100, 2, 100, 2048 * big)]
    rows = topk.sparse_rows(table.select("vec_id", table["embedding"].alias("embedding")).selectExpr("vec_id", "transform(embedding, x -> x * 1000) as embedding"), "vec_id", "embedding")
    with pytest.raises(Exception, match="(?i)too (big|large)|overflow|out of bounds|int"):
        topk.exact_topk(rows.where("id = 7"), rows, 2).collect()


def test_mixing(docs):
    got = mixing.mix_sources(docs, n_shards=3, block_words=16).collect()
    assert len(got) == len(odd_rows())
    again = mixing.mix_sources(docs, n_shards=3, block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(s.words for s in r.shards or ())
        by[r.source].append(r)
    total = sum(r.size for r in got)
    left = {s: (w, v[0].source_size) for w, (s, v) in zip(itertools.cycle((1, 2, 3)), sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")))}
    target, free, rest = {}, dict(left), total
    while True:
        share = rest / sum(w for w, _ in free.values()) if free else 0
        over = [s for s, (w, n) in free.items() if share * w > 3 * n]
        if not over:
            break
        for s in over:
            target[s] = 3 * free[s][1]
            rest -= target[s]
            del free[s]
    target |= {s: share * w for s, (w, _) in free.items()}
    for s, v in by.items():
        assert v[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in v) - target[s]) <= 0.5
    mixed = mixing.mixed_documents(docs, n_shards=3, block_words=16).collect()
    assert sum(len([w for w in r.text.replace("\x0b", " ").split(" ") if w.strip(" \t\n\r\f")]) for r in mixed) > 0


def test_hypergeometric_draws(spark):
    sql = mixing.hypergeometric("30L", "70L", "20L", "id")
    x = np.array([r[0] for r in spark.range(3000).selectExpr(f"{sql} as x").collect()])
    assert abs(x.mean() - 6) < 0.15 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.35 and x.min() >= 0 and x.max() <= 20


def test_language_id(spark, docs):
    rng = random.Random(2)
    words = {"en": "the of and house water".split(), "fr": "le des maison été eau".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(200) for k in [["en", "fr"][i % 2]]]
    table = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "漢字", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(table).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in ("en", "fr")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert langid.identify_languages(docs).count() == len(odd_rows())


def _removed(rows, window):
    first, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in first:
                gone[a : a + window] = [True] * window
            first.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_substring_dedup(spark, hot):
    rng = random.Random(11)
    base = [rng.choice("abcd") for _ in range(300)]
    rows = []
    for i in range(50):
        k = rng.randint(0, 250)
        rows.append((i, " ".join(rng.choice("abcde") if rng.random() < 0.05 else x for x in base[k : k + rng.randint(0, 80)])))
    rows += [(50, "q " * 90), (51, None), (52, "")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 6, hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == _removed(rows, 6)


def test_substring_dedup_odd_rows(docs):
    got = substring_dedup.substring_dedup(docs, 3).collect()
    assert len(got) == len(odd_rows())
    assert len({(r.n_removed, r.kept_text) for r in got if r.doc_id == 6}) == 1  # repeated rows are one document


def test_warc_rejects_magic_inside_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "aé"), (2, None, "x\r\n\r\n" + fake), (3, "a b\r\nWARC/1.1", "aé"), (4, "u", None), (5, "u", ""), (None, "q", "zz"), (6, "u", "y" * 5000 + fake * 3 + "WARC/1.")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.warc_round_trip(table).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert (got[3].record_type, got[3].refers_to, got[5].refers_to) == ("revisit", 1, 4) and got[1].record_type == got[4].record_type == "response"


def test_quality(spark, docs):
    rng = random.Random(4)
    good, bad = "The water of the house is old and the road to it was long.", "WIN!! CASH!! ### $$$ ||| 777 ###"
    rows = [(i, "\n".join([good, good[: rng.randint(20, 50)]] if i % 2 else [good, bad, bad * rng.randint(1, 3)])) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(table, labels).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    odd = quality.classify_quality(docs, labels).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(6)
    field = quality.LineField(0)
    field.transitions = rng.normal(size=(2, 2))
    sizes = np.array([1, 4, 3])
    e = rng.normal(size=sizes.sum())
    got = field.marginals(e, sizes)[0]
    at = 0
    for n in sizes:
        part = e[at : at + n]
        z, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(x for x, y in zip(part, labels) if y) + sum(field.transitions[a, b] for a, b in zip(labels, labels[1:])))
            z += p
            good += p * np.array(labels)
        assert got[at : at + n] == pytest.approx(good / z)
        at += n


def test_bpe_matches_the_library(docs):
    tokenizer = Tokenizer.from_file(PATH)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect())
    want = []
    for r in odd_rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_splits_like_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    number = bpe.Words()
    rng = random.Random(9)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "²", "é", "\xa0", "　", "\x85", "\x1c", "漢", "!", ",", ".", ", ", ".\n", "3.14", "<|endoftext|>", "<|", "​", "᠎"]
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))
        codes = bpe.code_words(x, number)
        words = [w.decode() for w in number.listed()]
        cut = [words[c] for c in codes.tolist()]
        assert "".join(cut) == x
        assert [i for w in cut for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(x, add_special_tokens=False).ids
        if len(number) > 300:
            number.clear()


def test_bpe_decodes_through_a_join(docs):
    back = bpe.decode_ids(bpe.encode_ids(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH), PATH).collect()
    want = {r[0]: {x[1] or "" for x in odd_rows() if x[0] == r[0]} for r in odd_rows()}
    assert all(r.text in want[r.doc_id] for r in back)


def test_class_model(spark, docs):
    got = class_lm.score_documents(docs).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    counts = collections.Counter()
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10:
            counts.update([*class_lm.tokens(r[1] or ""), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r in rows for t in [[*class_lm.tokens(r[1] or ""), None]])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 5, (class_lm.ITEMS, class_lm.ITEMS)).astype(float) * (rng.random((class_lm.ITEMS, class_lm.ITEMS)) < 0.002)
    cls = class_lm.exchange(pairs, 8)
    assert cls[0] == 0 and (cls[1:] > 0).all()
    words = rng.integers(1, 50, 40)
    items = rng.integers(1, class_lm.ITEMS, 40)
    member = np.eye(8)[cls]
    model = class_lm.ClassModel({}, cls, member.T @ pairs @ member, np.bincount(cls[items], minlength=8), np.bincount(cls[items], weights=words, minlength=8), int(words.sum()), 40, 1)
    for before in range(8):
        p = model.transition[before, 0]
        for c in range(1, 8):
            here = cls[items] == c
            p += model.transition[before, c] * (model.emission(words[here], np.full(here.sum(), c)).sum() + model.emission(np.zeros(1), np.array([c]))[0])
        assert p == pytest.approx(1)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = topk.sparse_rows(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    found = [
        simhash.simhash_dedup(none), topk.exact_topk(vectors, vectors), mixing.mix_sources(none), langid.identify_languages(none), substring_dedup.substring_dedup(none),
        warc.warc_round_trip(pages), quality.classify_quality(none, labels), exact_dedup.exact_dedup(none), bpe.round_trip(none, PATH), class_lm.score_documents(none),
    ]
    assert [df.count() for df in found] == [0] * len(found)


def test_words_outside_the_core_are_classed_by_their_neighbours(spark, monkeypatch):
    rng = random.Random(11)
    nouns, verbs = ([f"{rng.randrange(10**9)}{k}{rng.randrange(10**6)}" for _ in range(1200)] for k in "nv")
    texts = [" ".join(w for _ in range(30) for w in ("the", rng.choice(nouns), "so", rng.choice(verbs))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    real = class_lm.materialize
    monkeypatch.setattr(class_lm, "materialize", lambda df, name: seen.append(real(df, name)) or seen[-1])
    monkeypatch.setattr(class_lm, "discard", lambda df: None)
    got = class_lm.score_documents(docs, n_classes=6).collect()
    final = next(df for df in seen if "bigrams" in df.columns).select("classes", "chunk").collect()
    words = {r.chunk: class_lm.load_words(r.words) for r in seen[0].select("chunk", "words").collect()}
    classes = {w: c for r in final for w, c in zip(words[r.chunk], class_lm.unsqueeze(r["classes"], np.uint8).tolist())}
    of = [collections.Counter(classes[w.encode()] for w in kind if w.encode() in classes) for kind in (nouns, verbs)]
    mixed = sum(min(of[0][c], of[1][c]) for c in range(6))
    assert mixed < 0.02 * sum(of[0].values())  # by endings alone it would be near a half of those outside the core
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_the_largest_id_names_a_component_and_none_does_not(spark):
    rows = [(2**63 - 1, "some words here"), (None, "others stand there now"), (None, "others stand there now")]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.members) for r in got} == {(2**63 - 1, 2**63 - 1, 1), (None, None, 2)}
