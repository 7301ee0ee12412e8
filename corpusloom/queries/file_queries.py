"""Files written and read back: CSV, logs, vectors, notes, documents, records of services, projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.scratch import scratch_path
from corpusloom.sources import documents, notes, project, tables, vectors, works


@register("src_csv_round_trip", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role || ',\"x\"' AS role, md5(replace(text, chr(13), '')) AS digest FROM conversations")
def src_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(',"x"')).alias("role"), "text", F.lit(None).cast("string").alias("none"))
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path).where("none = ''").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("src_search_log", "SELECT count(*) AS n_searches, sum((props->>'k')::BIGINT)::BIGINT AS n_found FROM events WHERE event_type <> 'error'")
def src_search_log(spark, sf_dir):
    """A log of the events, in which those of errors are malformed lines."""
    path = scratch_path(spark, "log")
    record = F.to_json(F.struct(F.col("event_type").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("result_count")))
    line = F.when(F.col("event_type") == "error", F.substring(record, 1, 20)).otherwise(record)
    view(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return tables.search_totals(tables.read_json_lines(spark, path, "source string, result_count long"))


@register("src_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def src_log_tail(spark, sf_dir):
    return tables.tail(view(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@register("src_vectors_round_trip", "SELECT vec_id::VARCHAR AS id, unnest(range(len(embedding)))::INT AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def src_vectors_round_trip(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("h").alias("hash"), "embedding")
    return vectors.round_trip(rows, "stand-in").select("id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@register("src_vector_arrays", "SELECT 'c' || vec_id AS id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def src_vector_arrays(spark, sf_dir):
    """Arrays of one dimension, and one short row that is left out."""
    path = scratch_path(spark, "arrays")
    rows = view(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"), "label", "embedding")
    short = spark.createDataFrame([("bad", 0, [1.0])], "id string, label int, embedding array<float>")
    vectors.write_vector_arrays(rows.withColumn("label", F.col("label").cast("int")).unionByName(short), path)
    back = vectors.read_vector_arrays(spark, path, "label int")
    return back.select("id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@register("src_stale_vectors", "SELECT 'claim' AS kind, vec_id::VARCHAR AS id, label::VARCHAR AS hash FROM embeddings WHERE label >= 5")
def src_stale_vectors(spark, sf_dir):
    """Rows whose label has changed since their vectors were stored."""
    rows = view(spark, sf_dir, "embeddings").select(F.lit("claim").alias("kind"), F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("hash"))
    stored = rows.withColumn("hash", F.when(F.col("hash").cast("int") < 5, F.col("hash")).otherwise("old"))
    return vectors.stale(rows, stored)


_NOTE = """concat('---\npaper_id: "', o_orderkey, '"\ntitle: ', IF(o_orderpriority = '1-URGENT', '', 'Of orders: a title'), '\nauthors: [', IF(o_orderstatus = 'P', '', 'A One, "B, Two"'), ']\nyear: ', IF(o_orderpriority = '5-LOW', 1900, year(o_orderdate)),
    '\ndoi: 10.1/', o_orderkey, '\npdf_path: x.pdf\nread_date: 2024-01-01\ncategory:\n  - ', o_orderstatus, '\n  - second\nmethod:\n  family: ', IF(o_orderpriority = '2-HIGH', '', 'survey'),
    '\nrelevance:\n  relevance_to_topic: ', IF(o_orderstatus = 'O', 'core', 'nearby'), '\n  must_cite: ', IF(o_orderstatus = 'F', 'true', 'false'), '\nclaims:\n  novelty_strength: ', IF(o_orderstatus = 'F', 'strong', ''),
    '\nground_truth:\n  external: true\nevaluation:\n  baseline_compared: true\nquality_flags:\n  hobby_project_scale: true\nextracted:\n  sample_size:\n    value: 3\n', IF(o_orderstatus = 'F', '', '    provenance:\n      mechanism: regex\n'),
    '---\n\n## Problem statement\n\nWhy ', o_orderpriority, '?\n\n## Method summary\nHow.\n')"""
_NOTE_ERRORS = """array_to_string(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'empty: title' END, CASE WHEN o_orderstatus = 'P' THEN 'empty: authors' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'year out of range: 1900' END,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'empty: method.family' END, CASE WHEN o_orderstatus <> 'O' THEN 'relevance.relevance_to_topic must be core/adjacent/peripheral' END, CASE WHEN o_orderstatus = 'F' THEN 'extracted.sample_size: missing provenance' END], lambda x: x IS NOT NULL), '; ')"""


def _notes(spark, sf_dir):
    view(spark, sf_dir, "orders")
    return notes.parse_notes(spark.sql(f"SELECT cast(o_orderkey as string) AS path, {_NOTE} AS markdown FROM orders"))


@register("src_notes", f"SELECT o_orderkey::VARCHAR AS paper_id, {_NOTE_ERRORS} AS errors, 'Why ' || o_orderpriority || '?' AS problem, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS n_authors FROM orders")
def src_notes(spark, sf_dir):
    found = notes.with_errors(_notes(spark, sf_dir))
    return found.select("paper_id", F.array_join("errors", "; ").alias("errors"), F.col("problem_statement").alias("problem"), F.size("authors").alias("n_authors"))


@register(
    "src_note_defaults",
    "SELECT o_orderkey::VARCHAR AS paper_id, CASE WHEN o_custkey % 2 = 0 THEN 'V' ELSE 'arXiv' END AS venue, CASE WHEN o_orderstatus = 'F' THEN 'strong' ELSE 'moderate' END AS novelty, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS n_authors FROM orders",
)
def src_note_defaults(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("paper_id"), F.lit("C Three").alias("authors"), F.lit("2000").alias("year"), F.when(F.col("o_custkey") % 2 == 0, "V").alias("venue"),
        F.lit("").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit("").alias("url"), F.lit("arXiv, openalex").alias("source_database"),
    )
    return notes.with_defaults(_notes(spark, sf_dir), rows).select("paper_id", "venue", "novelty", F.size("authors").alias("n_authors"))


@register("src_note_status", f"SELECT o_orderkey::VARCHAR AS paper_id, CASE WHEN o_orderstatus = 'F' THEN 'include' ELSE 'maybe' END AS triage_label, CASE WHEN o_custkey % 2 = 0 THEN 'none' WHEN {_NOTE_ERRORS} = '' THEN 'valid' ELSE 'draft' END AS note_status FROM orders WHERE o_orderstatus <> 'P'")
def src_note_status(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    rows = view(spark, sf_dir, "papers").select(F.col("paper_id").cast("string").alias("paper_id"), "triage_label")
    odd = orders.where("o_custkey % 2 <> 0").select(F.col("o_orderkey").cast("string").alias("paper_id"))
    return notes.eligible_notes(rows, rows, _notes(spark, sf_dir).join(odd, "paper_id", "left_semi"))


@register(
    "src_notes_aggregate",
    """WITH o AS (SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'other' ELSE 'survey' END AS m FROM orders), e AS (
SELECT 'category' AS kind, unnest([o_orderstatus, 'second']) AS key FROM o UNION ALL SELECT 'cell', unnest([o_orderstatus || '|' || m, 'second|' || m]) FROM o UNION ALL SELECT 'method', m FROM o
UNION ALL SELECT 'relevance', CASE WHEN o_orderstatus = 'O' THEN 'core' ELSE 'nearby' END FROM o UNION ALL SELECT 'novelty', CASE WHEN o_orderstatus = 'F' THEN 'strong' ELSE 'unknown' END FROM o
UNION ALL SELECT 'flag', 'hobby_project_scale' FROM o UNION ALL SELECT 'total', 'papers' FROM o UNION ALL SELECT 'total', 'external_ground_truth' FROM o UNION ALL SELECT 'total', 'must_cite' FROM o WHERE o_orderstatus = 'F') SELECT kind, key, count(*) AS n FROM e GROUP BY ALL""",
)
def src_notes_aggregate(spark, sf_dir):
    return notes.aggregate(_notes(spark, sf_dir))


@register("src_note_summaries", "SELECT o_orderkey::VARCHAR AS id, 'hobby_project_scale' AS flags, '' AS contrib, '' AS gaps FROM orders")
def src_note_summaries(spark, sf_dir):
    return notes.summaries(_notes(spark, sf_dir)).withColumn("flags", F.array_join("flags", ","))


@register("src_reference_list", "SELECT c_custkey AS id, '- [paper_' || c_custkey || '] ' || c_name || ', X *(untitled)*. ' || c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN ' n.d.' ELSE ' ' || (1990 + c_nationkey) END || ' <https://doi.org/10.1/' || c_custkey || '>' AS line FROM customer")
def src_reference_list(spark, sf_dir):
    papers = view(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array("c_name", F.lit("X")).alias("authors"), F.lit("").alias("title"), F.col("c_mktsegment").alias("venue"), F.when(F.col("c_nationkey") % 2 == 1, F.col("c_nationkey") + 1990).alias("year"),
        F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"), F.lit("").alias("arxiv_id"), F.lit("u").alias("url"),
    )
    return notes.reference_list(papers)


@register("src_inverted_abstracts", r"SELECT item_id, md5(array_to_string([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> ''], ' ')) AS digest FROM benchmark")
def src_inverted_abstracts(spark, sf_dir):
    words = view(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("at", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("at").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("item_id", F.md5(works.restored_abstract(F.col("index")).cast("binary")).alias("digest"))


_WORK = """concat('{"results": [{"id": "https://openalex.org/W', c_custkey, '", "title": "', c_name, '", "doi": "https://doi.org/10.1/', c_custkey, '", "publication_year": ', 1990 + c_nationkey, ', "abstract_inverted_index": {"b": [1], "a": [0, 2]},
    "authorships": [{"author": {"display_name": "Ng"}}, {"author": {"display_name": null}}, {"author": {"display_name": "Osei"}}], "primary_location": {"landing_page_url": "http://l/', c_custkey, '"}, "ids": {"arxiv": "https://arxiv.org/abs/2101.1"},
    "locations": [{"source": {"display_name": "', c_mktsegment, '"}}, {"pdf_url": ', IF(c_nationkey % 2 = 0, 'null', '"http://p"'), '}]}]}')"""


@register(
    "src_openalex_works",
    """SELECT c_name AS title, 'Ng, Osei' AS authors, (1990 + c_nationkey)::VARCHAR AS year, c_mktsegment AS venue, 'a b a' AS abstract, '10.1/' || c_custkey AS doi, '2101.1' AS arxiv_id, 'https://openalex.org/W' || c_custkey AS url,
CASE WHEN c_nationkey % 2 = 0 THEN 'http://l/' || c_custkey ELSE 'http://p' END AS pdf_url, 'openalex' AS source_database, 'q' AS source_query FROM customer""",
)
def src_openalex_works(spark, sf_dir):
    view(spark, sf_dir, "customer")
    return works.works_to_candidates(works.openalex_works(spark.sql(f"SELECT {_WORK} AS body FROM customer")), "q")


@register("src_scholar_items", "SELECT s_name AS title, 'Ng' AS authors, '2001' AS year, '' AS venue, '10.2/' || s_suppkey AS doi, 'http://o' AS pdf_url FROM supplier")
def src_scholar_items(spark, sf_dir):
    view(spark, sf_dir, "supplier")
    body = spark.sql("""SELECT concat('{"data": [{"title": "', s_name, '", "year": 2001, "authors": [{"name": "Ng"}], "externalIds": {"DOI": "10.2/', s_suppkey, '"}, "openAccessPdf": {"url": "http://o"}}]}') AS body FROM supplier""")
    return works.scholar_to_candidates(works.scholar_items(body), "q").select("title", "authors", "year", "venue", "doi", "pdf_url")


@register("src_feed_entries", "SELECT s_name AS title, 'Ng, Osei' AS authors, '2021' AS year, '2101.' || s_suppkey AS arxiv_id, 'https://arxiv.org/pdf/2101.' || s_suppkey || '.pdf' AS pdf_url FROM supplier")
def src_feed_entries(spark, sf_dir):
    view(spark, sf_dir, "supplier")
    feeds = spark.sql(
        """SELECT concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.', s_suppkey, 'v2</id><published>2021-01-02T00:00:00Z</published><title> ', s_name,
        '\n</title><summary>s</summary><author><name>Ng</name></author><author><name>Osei</name></author></entry></feed>') AS xml FROM supplier UNION ALL SELECT 'broken <'"""
    )
    return works.feed_to_candidates(feeds, "q").select("title", "authors", "year", "arxiv_id", "pdf_url")


@register(
    "src_download_candidates",
    "WITH c AS (SELECT c_custkey AS paper_id, [CASE WHEN c_nationkey % 2 = 0 THEN ['http://p', 'primary pdf_url'] END, CASE WHEN c_nationkey % 3 = 0 THEN ['https://arxiv.org/pdf/1.2.pdf', 'arxiv direct'] END, ['http://o', 'unpaywall']] AS a FROM customer), f AS (SELECT paper_id, [x FOR x IN a IF x IS NOT NULL] AS a FROM c) SELECT paper_id, unnest(range(len(a)))::INT AS nth, unnest(a)[1] AS url, unnest(a)[2] AS source FROM f",
)
def src_download_candidates(spark, sf_dir):
    rows = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.when(F.col("c_nationkey") % 2 == 0, "http://p").otherwise("").alias("pdf_url"), F.when(F.col("c_nationkey") % 3 == 0, " 1.2").alias("arxiv_id"), F.lit("http://o").alias("open_access_url"))
    return works.download_candidates(rows)


@register("src_checked_files", "SELECT p_partkey::VARCHAR AS path, CASE p_size % 3 WHEN 0 THEN 'too small (10 bytes)' WHEN 1 THEN 'not a PDF (wrong magic bytes)' END AS reason, p_size % 3 = 2 AS ok FROM part")
def src_checked_files(spark, sf_dir):
    content = F.when(F.col("p_size") % 3 == 2, "%PDF-1.7 and so on").otherwise("<html>").cast("binary")
    files = view(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") % 3 == 0, 10).otherwise(200_000).cast("long").alias("length"), content.alias("content"))
    return works.checked_files(files).select("path", "reason", "ok")


@register("src_snowball_edges", "SELECT DISTINCT 'p' || l_suppkey AS src, 'p' || l_partkey AS dst, 'snowball' AS source FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT 'p' || l_partkey, 'p' || l_suppkey, 'snowball' FROM lineitem WHERE l_returnflag = 'N' UNION SELECT DISTINCT 'p' || l_suppkey, 'p' || l_partkey, 'api' FROM lineitem WHERE l_returnflag = 'R'")
def src_snowball_edges(spark, sf_dir):
    view(spark, sf_dir, "lineitem")
    states = spark.sql(
        """SELECT CASE l_returnflag WHEN 'R' THEN concat('{"edges": [{"from": "p', l_suppkey, '", "to": "p', l_partkey, '", "source": "api"}, {"from": "x"}]}')
        ELSE concat('{"expansions": {"p', l_suppkey, '": {"', IF(l_returnflag = 'A', 'references', 'cited_by'), '": ["p', l_partkey, '"]}}}') END AS json FROM lineitem"""
    )
    return works.snowball_edges(states)


@register("src_new_edges", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS source FROM lineitem EXCEPT SELECT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END FROM lineitem WHERE l_linestatus = 'F'")
def src_new_edges(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("source"), "l_linestatus")
    return works.add_edges(rows.where("l_linestatus = 'F'"), rows)


@register("src_in_corpus", "SELECT s_suppkey, s_suppkey % 2 = 0 OR s_name IN (SELECT s_name FROM supplier WHERE s_nationkey < 5) AS known FROM supplier")
def src_in_corpus(spark, sf_dir):
    base = view(spark, sf_dir, "supplier")
    doi = F.concat(F.lit("10.1/"), F.col("s_suppkey").cast("string"))
    external = base.select("s_suppkey", F.concat(F.lit("https://doi.org/"), doi).alias("doi"), F.lit("").alias("arxiv_id"), F.upper("s_name").alias("title"))
    corpus = base.select(F.when(F.col("s_suppkey") % 2 == 0, doi).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.when(F.col("s_nationkey") < 5, F.col("s_name")).alias("title"))
    return works.in_corpus(external, corpus).select("s_suppkey", "known")


@register("src_html_blocks", "SELECT page_id AS doc_id, ((length(html) - length(replace(html, '<h1', ''))) // 3)::BIGINT AS heads, 1::BIGINT AS titles FROM pages")
def src_html_blocks(spark, sf_dir):
    found = documents.blocks(view(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("body")))
    return found.groupBy("doc_id").agg(F.count_if((F.col("kind") == "head") & (F.col("level") == 1)).alias("heads"), F.count_if(F.col("kind") == "title").alias("titles"))


@register(
    "src_tei_blocks",
    """SELECT s_suppkey AS doc_id, unnest(range(9))::INT AS block_idx, unnest(['title', 'author', 'abstract', 'head', 'p', 'ref', 'head', 'p', 'bibl']) AS kind, unnest([0, 0, 0, 1, 1, 1, 2, 2, 0])::INT AS level,
unnest([s_name, 'Ng', 'In short.', 'Methods', 'As [1] shows.', '[1]', 'Inner', 'More.', 'A book']) AS text, unnest([NULL, NULL, NULL, NULL, NULL, 'b0', NULL, NULL, 'b0']) AS target FROM supplier""",
)
def src_tei_blocks(spark, sf_dir):
    view(spark, sf_dir, "supplier")
    docs = spark.sql(
        """SELECT s_suppkey AS doc_id, concat('<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:xml="http://www.w3.org/XML/1998/namespace"><teiHeader><fileDesc><titleStmt><title>', s_name, '</title></titleStmt><sourceDesc><author>Ng</author></sourceDesc></fileDesc><profileDesc><abstract><p>In short.</p></abstract></profileDesc></teiHeader>',
        '<text><body><div><head>Methods</head><p>As <ref type="bibr" target="#b0">[1]</ref> shows.</p><div><head>Inner</head><p>More.</p></div></div></body><back><listBibl><biblStruct xml:id="b0"><title>A book</title></biblStruct></listBibl></back></text></TEI>') AS body FROM supplier
        UNION ALL SELECT -1, 'no <xml'"""
    )
    return documents.blocks(docs, "tei")


@register("src_page_lines", "SELECT p_partkey AS doc_id, 1 AS page, unnest([0, 1])::BIGINT AS line_idx, unnest([p_name || ' ' || p_brand, 'end']) AS text FROM part")
def src_page_lines(spark, sf_dir):
    pieces = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(1).alias("page"), F.lit(i).alias("idx"), F.lit(float(y)).alias("y"), t.alias("text")) for i, y, t in ((0, 700, F.col("p_name")), (1, 698, F.concat(F.lit(" "), F.col("p_brand"))), (2, 690, F.lit(" ")), (3, 680, F.lit("end")))])).alias("x")).select("doc_id", "x.*")
    return documents.page_lines(pieces)


@register("src_project", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1 UNION ALL SELECT 'new', 1")
def src_project(spark, sf_dir):
    """A project written, exported, imported elsewhere; one paper's rows replaced, another's removed."""
    rows = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("paper_id"), "n_name")
    first = project.Project(spark, scratch_path(spark, "project"))
    first.write(facts=rows.where("paper_id = 'ASIA'"), credentials=rows)
    first.write(facts=rows)
    exported = scratch_path(spark, "export")
    first.export(exported)
    second = project.Project(spark, scratch_path(spark, "project"))
    if second.import_(exported) != ["facts"]:
        raise AssertionError("credentials are not exported")
    second.replace_papers("facts", spark.createDataFrame([("new", "x")], "paper_id string, n_name string"), spark.createDataFrame([("none",)], "paper_id string"))
    second.remove_papers(spark.createDataFrame([("ASIA",)], "paper_id string"), ["facts"])
    return second.read("facts").groupBy(F.col("paper_id").alias("r_name")).agg(F.count("*").alias("n"))
