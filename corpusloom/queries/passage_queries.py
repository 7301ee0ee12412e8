"""Sections, sentences, citations, spans and results in texts of the test tables, or in texts made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.functions import text as T
from corpusloom.operators import passages as P
from corpusloom.operators import retrieval as R
from corpusloom.queries.text_queries import _BM25
from corpusloom.scratch import cut_lineage, scratch_path

_HEADING = "CASE (turn + conv_id) % 5 WHEN 0 THEN '2. Methods' WHEN 1 THEN 'Cache Priming' WHEN 2 THEN 'Results' WHEN 3 THEN 'III. Discussion' ELSE 'Odd Name' END"


@register(
    "txt_section_tree",
    """WITH RECURSIVE s AS (SELECT conv_id AS d, turn AS i, 1 + (turn * 7 + conv_id) % 4 AS level, CASE (turn + conv_id) % 5 WHEN 0 THEN 'methods' WHEN 2 THEN 'results' WHEN 3 THEN 'discussion' ELSE 'other' END AS own FROM conversations),
p AS (SELECT s.*, (SELECT max(q.i) FROM s q WHERE q.d = s.d AND q.i < s.i AND q.level < s.level) AS parent FROM s),
up(d, i, above, kind) AS (SELECT d, i, parent, own FROM p UNION ALL SELECT up.d, up.i, p.parent, p.own FROM up JOIN p ON p.d = up.d AND p.i = up.above WHERE up.kind = 'other')
SELECT p.d AS doc_id, p.i AS section_idx, p.level, p.parent AS parent_idx, coalesce((SELECT max(kind) FROM up WHERE up.d = p.d AND up.i = p.i AND kind <> 'other'), 'other') AS section_type FROM p""",
)
def txt_section_tree(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_idx"), F.expr("1 + (turn * 7 + conv_id) % 4").alias("level"), F.expr(_HEADING).alias("heading"))
    return P.section_tree(rows)


@register(
    "txt_slug_sections",
    "SELECT o_orderpriority AS p, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'introduction' WHEN '2-HIGH' THEN 'related_work' WHEN '3-MEDIUM' THEN 'methods' WHEN '5-LOW' THEN 'limitations' END AS label FROM orders GROUP BY ALL",
)
def txt_slug_sections(spark, sf_dir):
    slug = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '1_Introduction' WHEN '2-HIGH' THEN 'prior_work' WHEN '3-MEDIUM' THEN '3_2_proposed_scheme' WHEN '5-LOW' THEN 'threats_to_validity' ELSE 'cache' END")
    return view(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), P.section_of_slug(slug).alias("label")).agg(F.count("*").alias("n"))


@register(
    "txt_sentence_at",
    """SELECT p_partkey AS doc_id, 'See Fig. ' || p_size || ' of Ng et al. In part.' AS first, 'Then ' || p_name || ' holds, e.g. ' || p_brand || '!' AS second, 'ends? no' AS last FROM part""",
)
def txt_sentence_at(spark, sf_dir):
    first = F.concat(F.lit("See Fig. "), F.col("p_size").cast("string"), F.lit(" of Ng et al. In part."))
    second = F.concat(F.lit("Then "), F.col("p_name"), F.lit(" holds, e.g. "), F.col("p_brand"), F.lit("!"))
    text = F.concat(first, F.lit("  "), second, F.lit(" ends? no"))
    rows = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), first.alias("a"), second.alias("b"), text.alias("text"))
    tail = F.regexp_extract(P.sentence_at(F.col("text"), F.length("text") - 1), r"(ends\? no)$", 1)
    return rows.select("doc_id", P.sentence_at(F.col("text"), F.lit(4)).alias("first"), F.substring_index(P.sentence_at(F.col("text"), F.length("a") + 5), " ends", 1).alias("second"), tail.alias("last"))


@register(
    "txt_citation_markers",
    """WITH p AS (SELECT p_partkey AS paragraph_id, p_name AS n FROM part) SELECT paragraph_id, 0 AS marker_idx, 'a' AS target, 'As ' || n || ' [1] shows, it holds.' AS context FROM p UNION ALL SELECT paragraph_id, 1, 'a', 'But [1] and [2] differ.' FROM p
UNION ALL SELECT paragraph_id, 2, 'b', 'But [1] and [2] differ.' FROM p UNION ALL SELECT paragraph_id, 3, NULL, NULL FROM p""",
)
def txt_citation_markers(spark, sf_dir):
    marks = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(t).cast("string").alias("target")) for s, t in (("[1]", "a"), ("[1]", "a"), ("[2]", "b"), ("[9]", None))])
    text = F.concat(F.lit("As "), F.col("p_name"), F.lit(" [1] shows, it holds. But [1] and [2] differ. End."))
    return P.citation_markers(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("paragraph_id"), text.alias("text"), marks.alias("marks"))).select("paragraph_id", "marker_idx", "target", "context")


@register("txt_citation_anchors", "SELECT c_custkey, 'Mehta et al. (' || 1990 + c_nationkey || ')' AS longest, 11 AS n FROM customer")
def txt_citation_anchors(spark, sf_dir):
    anchors = P.citation_anchors(F.array(F.lit("Ravi Mehta"), F.lit("Osei, Ama"), F.lit("Li")), F.col("c_nationkey") + 1990)
    return view(spark, sf_dir, "customer").select("c_custkey", F.element_at(anchors, 1).alias("longest"), (F.size(anchors) - 1).alias("n"))


@register("txt_citation_contexts")
def txt_citation_contexts(spark, sf_dir):
    chunks = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_idx"), F.expr("turn div 2").alias("page"), F.when(F.col("role") == "system", "references").otherwise("body").alias("section"), "text")
    links = chunks.select(F.col("paper_id").alias("src"), F.lit(0).alias("dst"), F.array(F.lit("the "), F.lit("que "), F.lit("der ")).alias("anchors")).distinct()
    return P.citation_contexts(links, chunks)


@register(
    "txt_numbered_references",
    "SELECT p_partkey AS doc_id, 1 AS n, 'Ng and Osei. On the ' || p_name || ', in full.' AS text FROM part UNION ALL SELECT p_partkey, 12, 'Mehta. A second entry of ' || p_brand || '.' FROM part",
)
def txt_numbered_references(spark, sf_dir):
    body = F.concat(F.lit("Body text.\n\nReferences\n[1] Ng and Osei. On the\n"), F.col("p_name"), F.lit(", in full.\n[12] Mehta. A second entry of "), F.col("p_brand"), F.lit(".\n[1] Ng again, but later on."))
    return P.numbered_references(P.sections_text(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("text"))))


_LABEL = "CASE role WHEN 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'intro' ELSE 'methods' END WHEN 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'other' ELSE 'results' END ELSE NULL END"
_ROUTED = f"""c AS (SELECT conv_id AS paper_id, turn AS chunk_idx, {_LABEL} AS label, text FROM conversations),
t AS (SELECT *, CASE WHEN coalesce(label, 'other') = 'methods' THEN 0 WHEN label = 'other' THEN 1 ELSE 2 END AS tier FROM c), b AS (SELECT *, min(tier) OVER (PARTITION BY paper_id) AS best FROM t),
k AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n FROM b WHERE tier <= best OR best = 2),
z AS (SELECT *, n > 1 AND chunk_idx = 0 AND (text = '' OR regexp_matches(substr(text, 1, 1200), '(?i)\\bpage\\s+\\d+\\s*/\\s*\\d+\\b|\\bcorresponding\\s+author\\b|\\bemail:\\s*[^\\s@]+@[^\\s@]+')
    OR (NOT regexp_matches(substr(text, 1, 200), '[.!?]\\s+[A-Z]') AND len(regexp_extract_all(substr(text, 1, 200), '[A-Z]')) > 12)) AS front FROM k),
r AS (SELECT *, ['sections', 'sections+other', 'whole_paper'][best + 1] AS tier_name, row_number() OVER (PARTITION BY paper_id ORDER BY front, chunk_idx) AS nth FROM z)"""


def _chunks(spark, sf_dir):
    return view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_idx"), F.expr(_LABEL).alias("label"), "text")


@register("txt_routed_chunks", f"WITH {_ROUTED} SELECT paper_id, chunk_idx, tier_name AS tier, nth FROM r")
def txt_routed_chunks(spark, sf_dir):
    return P.routed_chunks(_chunks(spark, sf_dir), ["methods"]).select("paper_id", "chunk_idx", "tier", "nth")


@register(
    "txt_budgeted_text",
    f"""WITH {_ROUTED}, u AS (SELECT *, sum(length(text)) OVER (PARTITION BY paper_id ORDER BY nth) - length(text) AS before, row_number() OVER (PARTITION BY paper_id ORDER BY nth) AS k FROM r WHERE trim(text) <> '')
SELECT paper_id, md5(string_agg(substr(text, 1, (1500 - before)::BIGINT), chr(10) || chr(10) ORDER BY k)) AS digest, count(*) AS n FROM u WHERE before < 1500 AND k <= 4 GROUP BY 1""",
)
def txt_budgeted_text(spark, sf_dir):
    found = P.budgeted_text(P.routed_chunks(_chunks(spark, sf_dir), ["methods"]))
    return found.select("paper_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("chunks").cast("long").alias("n"))


@register("txt_spans")
def txt_spans(spark, sf_dir):
    found = P.proposed_spans(view(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("chunk_id"), "text"))
    return found.withColumn("families", F.array_join("families", ","))


@register(
    "txt_named_spans",
    "SELECT p_partkey AS chunk_id, 'ACME-' || p_size AS span, 4 AS start, 'acronym,hyphenated,versioned' AS families FROM part WHERE p_size > 9",
)
def txt_named_spans(spark, sf_dir):
    text = F.concat(F.lit("the ACME-"), F.col("p_size").cast("string"), F.lit(" is fine"))
    found = P.proposed_spans(view(spark, sf_dir, "part").where("p_size > 9").select(F.col("p_partkey").alias("chunk_id"), text.alias("text")))
    return found.select("chunk_id", "span", "start", F.array_join("families", ",").alias("families"))


_REPORT = "paper_id, sentence_idx, nth, metric, value, dataset, split"


@register(
    "txt_mined_results",
    with_views("reports") + """SELECT paper_id, sentence_idx, 0 AS nth, CASE l_linestatus WHEN 'F' THEN 'f1' ELSE 'accuracy' END AS metric, l_quantity + 0.5 AS value, d.dataset, CASE l_returnflag WHEN 'A' THEN 'test' WHEN 'N' THEN 'val' ELSE 'train' END AS split
FROM reports JOIN (SELECT a.paper_id, a.sentence_idx, arg_min(b.name, b.sentence_idx) AS dataset FROM reports a JOIN reports b ON a.paper_id = b.paper_id AND contains(a.name, b.name) GROUP BY ALL) d USING (paper_id, sentence_idx)""",
)
def txt_mined_results(spark, sf_dir):
    reports = view(spark, sf_dir, "reports")
    datasets = reports.select("paper_id", F.col("sentence_idx").alias("ord"), F.col("name").alias("canonical"), F.upper("name").alias("raw"))
    return P.mined_results(reports.select("paper_id", "sentence_idx", "sentence"), {"f1": ["F1 score", "F score"], "accuracy": ["acc"]}, datasets)


@register(
    "txt_validated_quotes",
    r"""WITH q AS (SELECT conv_id, turn, lower(trim(regexp_replace(substr(text, 5, 100), '\s+', ' ', 'g'))) AS q FROM conversations), p AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations)
SELECT q.conv_id AS paper_id, q.turn AS quote_id, min(p.turn) AS passage_idx, 'whole' AS by FROM q JOIN p ON p.conv_id = q.conv_id AND contains(p.t, q.q) WHERE length(q.q) >= 12 GROUP BY ALL""",
)
def txt_validated_quotes(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations")
    quotes = rows.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("quote_id"), F.substring("text", 5, 100).alias("quote"))
    return P.validated_quotes(quotes, rows.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("passage_idx"), "text"))


@register(
    "txt_grouped_contexts",
    "WITH g AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_partkey AS marker_id, p_brand || '/' || p_name || '/' || n AS answer FROM part JOIN g USING (p_brand, p_name)",
)
def txt_grouped_contexts(spark, sf_dir):
    parts = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("marker_id"), F.col("p_brand").alias("reference_id"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("context"))
    groups = P.grouped_contexts(parts)
    answers = groups.select("reference_id", "context", F.concat_ws("/", "reference_id", "context", F.size("markers").cast("string")).alias("answer"))
    return P.spread_answers(groups, answers)


@register("txt_boilerplate", "SELECT p_size % 5 AS k, p_size % 5 IN (0, 1, 2) AS boilerplate, p_size % 5 IN (0, 2, 3) AS real, count(*) AS n FROM part GROUP BY ALL")
def txt_boilerplate(spark, sf_dir):
    s = F.expr(
        """CASE p_size % 5 WHEN 0 THEN 'Section 3 describes the method that was used for all of the ' || p_name || ' experiments.' WHEN 1 THEN '2.1 Methods' WHEN 2 THEN 'We note that the rest of this paper looks at the ' || p_name || ' in much more detail than before.'
        WHEN 3 THEN 'We find that the ' || p_name || ' works well under every condition that we have tried.' ELSE 'and of the ' || p_name || ' in a fragment.' END"""
    )
    return view(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("k"), T.is_boilerplate(s).alias("boilerplate"), T.is_real_sentence(s).alias("real")).groupBy("k", "boilerplate", "real").agg(F.count("*").alias("n"))


@register("txt_split_kind", "SELECT p_size % 4 AS k, CASE p_size % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'train' END AS split, count(*) AS n FROM part GROUP BY ALL")
def txt_split_kind(spark, sf_dir):
    s = F.expr("CASE p_size % 4 WHEN 0 THEN 'On the Test and training sets' WHEN 1 THEN 'the dev set' WHEN 2 THEN 'for Training' ELSE 'held-out attestation' END")
    return view(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).alias("k"), T.split_kind(s).alias("split")).agg(F.count("*").alias("n"))


@register(
    "txt_identifiers",
    "SELECT o_orderkey, '10.1000/x' || o_orderkey AS doi, '2101.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS arxiv, 'W' || o_orderkey AS openalex, 1000.5 + o_orderkey AS number, sha256(o_orderkey::VARCHAR)[:32] AS hash FROM orders",
)
def txt_identifiers(spark, sf_dir):
    from corpusloom.operators.ingest import content_hash
    from corpusloom.sources.works import openalex_id

    key = F.col("o_orderkey").cast("string")
    doi = F.concat(F.element_at(F.array(F.lit("https://doi.org/10.1000/X"), F.lit(" doi: 10.1000/X"), F.lit("10.1000/x")), (F.col("o_orderkey") % 3 + 1).cast("int")), key)
    arxiv = F.concat(F.lit("https://arXiv.org/abs/2101."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit("v3"))
    return view(spark, sf_dir, "orders").select(
        "o_orderkey", T.normalise_doi(doi).alias("doi"), T.arxiv_id(arxiv).alias("arxiv"), openalex_id(F.concat(F.lit("https://openalex.org/W"), key)).alias("openalex"),
        T.number(F.concat((F.col("o_orderkey") + 1000).cast("string"), F.lit(".5"))).alias("number"), content_hash(key).alias("hash"),
    )


@register("txt_plain_pdf", "SELECT p_partkey, 'effi' || 'cient ' || p_name || ' \"work\" - co-op' AS text FROM part")
def txt_plain_pdf(spark, sf_dir):
    raw = F.concat(F.lit("eﬃcient  "), F.col("p_name"), F.lit("\n “wo­rk” – co‐op".replace("‐", "-")))
    return view(spark, sf_dir, "part").select("p_partkey", T.normalise_pdf(raw).alias("text"))


@register(
    "txt_coverage",
    "SELECT o_orderkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS n FROM orders",
)
def txt_coverage(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    mark = lambda tail: F.concat(F.lit("as [paper_"), F.col("paper_id").cast("string"), F.lit(tail))
    text = F.when(F.col("o_orderstatus") == "F", F.concat(mark("] "), mark(", p. 3]"))).when(F.col("o_orderstatus") == "O", mark("]")).otherwise("none [paper_]")
    return R.coverage_of_mentions(orders, orders.select(text.alias("text")))


@register(
    "txt_hybrid",
    f"""WITH {_BM25}, l AS (SELECT query_id, doc_id, rank FROM b WHERE rank <= 50), y AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM h),
u AS (SELECT * FROM l UNION ALL SELECT * FROM y WHERE rank <= 50), g AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM u GROUP BY ALL)
SELECT query_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
)
def txt_hybrid(spark, sf_dir):
    """A lexical ranking, fused with one of the newest hits in the place of a dense one."""
    found = cut_lineage(R.bm25_scores(view(spark, sf_dir, "documents").select("doc_id", "text"), view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")), "hybrid")
    newest = R.top_k(found.withColumn("score", F.col("doc_id").cast("double")), 100)
    return R.hybrid_search(R.top_k(found, 100), newest).select("query_id", "rank", "score")


@register("txt_bm25_saved", f"WITH {_BM25} SELECT query_id, rank, score FROM b WHERE rank <= 10")
def txt_bm25_saved(spark, sf_dir):
    """The search over a saved index: half of the documents added first, all of that half removed, then everything added."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = R.Bm25Index(spark, scratch_path(spark, "index"), 16)
    some = docs.where("lang = 'en'").select("doc_id", "text")
    index.add(some)
    index.remove(some)
    index.add(docs.select("doc_id", "text"))
    return index.search(view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", "rank", "score")
