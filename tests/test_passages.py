"""Sentences, citation windows, trees and spans against plain Python."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import passages as P


def ends_sentence(text, i):
    if text[i] not in ".!?":
        return False
    if not text[i + 1 :].strip():
        return i + 1 >= len(text) or text[i + 1].isspace()
    if not text[i + 1].isspace() or re.match(r"[a-z]", text[i + 1 :].lstrip()):
        return False
    before = text[:i].lower()
    return not any(before.endswith(a) and not re.search(r"[a-z]\Z", before[: len(before) - len(a)]) for a in P.ABBREVIATIONS)


def sentence(text, offset):
    start = next((i + 1 for i in range(offset - 1, 0, -1) if ends_sentence(text, i)), 0)
    end = next((i + 1 for i in range(offset, len(text)) if ends_sentence(text, i)), len(text))
    return text[start:end].strip()


def test_sentence_at(spark):
    rng = random.Random(5)
    pool = ["See Fig.", "et al.", "Results hold.", "no.", "Dr. Ng", "e.g.", "x", "Done!", "why?", "Casino.", "3", "p.", "(Then", "end."]
    rows = []
    for _ in range(60):
        text = "A" + "".join(rng.choice([" ", "  ", "\n"]) + rng.choice(pool) for _ in range(rng.randint(1, 9)))
        rows += [(text, k) for k in range(len(text)) if not text[k].isspace()]
    got = spark.createDataFrame(rows, "t string, k int").select("t", "k", P.sentence_at(F.col("t"), F.col("k")).alias("s")).collect()
    assert [(r.t, r.k, r.s) for r in got if r.s != sentence(r.t, r.k)] == []
    odd = spark.createDataFrame([("", 0), ("ab", 2), ("ab", -1), (None, 0)], "t string, k int").select(P.sentence_at(F.col("t"), F.col("k")).alias("s"))
    assert [r.s for r in odd.collect()] == [None] * 4


def window(chunks, i, at, size, width):
    """Text around a match in chunk i, running on into neighbours of the same page, references excluded."""
    text, page = chunks[i][3], chunks[i][1]
    left, right = "", ""
    need = width - at
    for _, p, section, t in reversed(chunks[:i]):
        if need <= 0 or section == "references" or p != page:
            break
        left, need = t[max(0, len(t) - need) :] + " " + left, need - min(need, len(t))
    need = width - (len(text) - at - size)
    for _, p, section, t in chunks[i + 1 :]:
        if need <= 0 or section == "references" or p != page:
            break
        right, need = right + " " + t[:need], need - min(need, len(t))
    return (left + text[max(0, at - width) : at + size + width] + right).strip()


def test_citation_contexts(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for paper in range(25):
        chunks = []
        for i in range(rng.randint(1, 7)):
            words = [rng.choice(["lorem", "ipsum", "Ng et al.", "Ng (2001)", "x"]) for _ in range(rng.randint(1, 12))]
            chunks.append((i, i // 2, rng.choice(["body", "body", "references"]), " ".join(words)))
        rows += [(paper, *c) for c in chunks]
        for anchor in ("Ng (2001)", "Ng et al."):
            hit = next((c for c in chunks if c[2] != "references" and anchor.lower() in c[3].lower()), None)
            if hit:
                want[paper] = (anchor, hit[0], window(chunks, hit[0], hit[3].lower().index(anchor.lower()), len(anchor), 20))
                break
    chunks = spark.createDataFrame(rows, "paper_id long, chunk_idx int, page int, section string, text string")
    links = chunks.select(F.col("paper_id").alias("src"), F.lit(1).alias("dst"), F.array(F.lit("Ng (2001)"), F.lit("Ng et al.")).alias("anchors")).distinct()
    got = {r.src: (r.anchor, r.chunk_idx, r.context) for r in P.citation_contexts(links, chunks, 20).collect()}
    assert got == want


def test_clipped_context(spark):
    text = "One. Two is here and the Span stands in it. Three (and more) follows."
    at = text.index("Span")
    row = spark.createDataFrame([(text,)], "t string").select(P.clipped_context(F.col("t"), F.lit(at), F.lit(at + 4), 60).alias("c"), P.clipped_context(F.col("t"), F.lit(at), F.lit(at + 4), 5).alias("d")).first()
    assert row.c == "Two is here and the Span stands in it." and row.d == "the Span stan"


def test_spans():
    found = {(s, tuple(f)) for s, _, _, f in P.spans_of("We use the Apache Spark framework, GPT-4 and BERT-base by John of Gaunt (JOG). THE end: called 'Foo'.")}
    assert ("GPT-4", ("acronym", "hyphenated", "versioned")) in found and ("JOG", ("acronym",)) in found
    assert any(s == "Apache Spark" and "pattern:library" in f for s, f in found) and any(s == "Foo" for s, _ in found)
    assert not any(s in ("THE", "We") for s, _ in found)
    text = "Deep Nets by Ng"
    assert all(text[a:b] == s for s, a, b, f in P.spans_of(text) if not f[0].startswith("pattern"))
    assert P.spans_of("") == []


def test_markers_that_are_not_found_have_no_context(spark):
    marks = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit("t").alias("target")) for s in ("[1]", "", "[7]", "[1]")])
    rows = spark.createDataFrame([(1, "A [1] b. C [1] d.")], "paragraph_id long, text string").withColumn("marks", marks)
    assert [(r.marker_idx, r.context) for r in P.citation_markers(rows).orderBy("marker_idx").collect()] == [(0, "A [1] b."), (1, None), (2, None), (3, "C [1] d.")]


def test_numbered_lines_count_where_no_brackets_are(spark):
    docs = spark.createDataFrame([(1, "1. First entry, long enough.\n goes on\n2) Second entry, long enough."), (2, "nothing")], "doc_id long, text string")
    got = {(r.doc_id, r.n): r.text for r in P.numbered_references(docs).collect()}
    assert got == {(1, 1): "First entry, long enough. goes on", (1, 2): "Second entry, long enough."}


def test_quotes_of_which_the_head_is_there(spark):
    quote = "word " * 20 + "and an end that is not there"
    quotes = spark.createDataFrame([(1, 1, quote), (1, 2, "short"), (1, 3, "“ﬁne” quo­tes here")], "paper_id long, quote_id long, quote string")
    passages = spark.createDataFrame([(1, 0, "x"), (1, 1, "Word " * 40), (1, 2, 'A "fine"  quotes here.'), (2, 0, quote)], "paper_id long, passage_idx int, text string")
    assert {(r.quote_id, r.passage_idx, r.by) for r in P.validated_quotes(quotes, passages).collect()} == {(1, 1, "head"), (3, 2, "whole")}
