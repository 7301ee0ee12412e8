"""The detectors as a registry, and the workflow around a corpus: ingest, edits, texts to embed, reports of what to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import ORACLE_SQL, register
from corpusloom.fixtures import view, with_views
from corpusloom.operators import gaps, ingest, network, phase4, registry, reports
from corpusloom.operators.common import papers_list
from corpusloom.queries.gap_queries import rounded

_PHASE4 = {
    "evidence": "'evidence:dataset=' || dataset || '|metric=' || metric",
    "knowledge": "'knowledge:method_cluster_id=' || method_cluster_id || '|paper_cluster_id=' || paper_cluster_id",
    "methodological": "'methodological:method_cluster_id=' || method_cluster_id || '|paper_cluster_id=' || paper_cluster_id",
    "empirical": "'empirical:cluster_id=' || cluster_id",
    "theoretical": "'theoretical:topic=' || topic",
    "population": "'population:label=' || label || '|topic=' || topic",
    "practical": "'practical:cluster_id=' || cluster_id",
}
_P4_ALL = " UNION ALL ".join(f"SELECT '{t}' AS type, {s} AS signature, salience::DOUBLE AS salience FROM ({ORACLE_SQL['p4_' + t]})" for t, s in _PHASE4.items())


def _phase4(spark, sf_dir):
    tables = {v: view(spark, sf_dir, v) for v in ("clustered", "claims", "results")}
    tables["topics"] = tables["clustered"].select("paper_id", F.col("paper_cluster_id").alias("topic"))
    tables["mentions"] = view(spark, sf_dir, "grid").select("paper_id", F.col("method").alias("label"))
    found = {
        "evidence": registry.Detector("gap", ("results",), phase4.evidence),
        "knowledge": registry.Detector("gap", ("clustered",), phase4.knowledge),
        "methodological": registry.Detector("gap", ("clustered",), phase4.methodological),
        "empirical": registry.Detector("gap", ("claims",), phase4.empirical),
        "theoretical": registry.Detector("gap", ("claims",), phase4.theoretical, {"max_ratio": 0.6}),
        "population": registry.Detector("gap", ("mentions", "topics"), phase4.population, {"pattern": "#[1-3]"}),
        "practical": registry.Detector("gap", ("claims",), phase4.practical),
    }
    return found, tables


@register("p4_run_all", f"SELECT * FROM ({_P4_ALL}) ORDER BY salience DESC, signature LIMIT 100")
def p4_run_all(spark, sf_dir):
    found, tables = _phase4(spark, sf_dir)
    return registry.run_all(spark, found, tables)[0].select("type", "signature", "salience")


@register("p4_run_dismissed", f"SELECT * FROM ({_P4_ALL}) WHERE NOT (type = 'methodological' AND salience > 0.5) ORDER BY salience DESC, signature LIMIT 100")
def p4_run_dismissed(spark, sf_dir):
    """All detectors but what was dismissed: the methodological candidates above 0.5."""
    found, tables = _phase4(spark, sf_dir)
    old = registry.run_one("methodological", found["methodological"], tables).where("salience > 0.5").select("type", "signature")
    return registry.run_all(spark, found, tables, old)[0].select("type", "signature", "salience")


_GAPS = {
    "evidence": ("gap_evidence", "'evidence:dataset=' || dataset || '|metric=' || metric", "salience"),
    "knowledge": ("gap_knowledge", "'knowledge:brand=' || brand || '|category=' || category || '|domain=' || domain", "salience"),
    "methodological": ("gap_methodological", "'methodological:category=' || category || '|method=' || method", "salience"),
    "population": ("gap_population", "'population:category=' || category || '|sample=' || sample", "salience"),
    "empirical": ("gap_empirical", "'empirical:cluster_id=' || cluster_id", "salience"),
    "practical": ("gap_practical", "'practical:cluster_id=' || cluster_id", "salience"),
    "theoretical": ("gap_theoretical", "'theoretical:name=' || name || '|reason=' || reason", "salience"),
}
_GAP_ALL = " UNION ALL ".join(f"SELECT '{t}' AS type, {s} AS signature, round({x}, 6)::DOUBLE AS salience FROM ({ORACLE_SQL[q]})" for t, (q, s, x) in _GAPS.items())


def _gaps(spark, sf_dir):
    tables = {v: view(spark, sf_dir, v) for v in ("results", "grid", "claims", "categories")}
    tables["eligible"] = view(spark, sf_dir, "papers").where("triage_label in ('include', 'maybe')")
    tables["anchors"] = view(spark, sf_dir, "usage").where("kind = 'PROMO'").select("paper_id", "canonical")
    tables["challenges"] = view(spark, sf_dir, "fields").where("field_name = 'challenges_existing'").select("paper_id", F.col("field_value").alias("verdict"))
    many = {"limit": 1_000_000}
    D = registry.Detector
    found = {
        "evidence": D("gap", ("results",), gaps.evidence_gap, {"min_papers": 8} | many),
        "knowledge": D("gap", ("grid",), gaps.knowledge_gap, {"axes": ["category", "brand", "domain"], "min_neighbours": 0.05} | many),
        "methodological": D("gap", ("grid",), gaps.methodological_gap, {"row_axis": "category", "column_axis": "method"} | many),
        "population": D("gap", ("grid",), gaps.population_gap, {"axes": ["category", "sample"], "min_neighbours": 0.5} | many),
        "empirical": D("gap", ("claims",), gaps.empirical_gap, many),
        "practical": D("gap", ("claims",), gaps.practical_gap, many),
        "theoretical": D("gap", ("eligible", "categories", "anchors", "challenges"), gaps.theoretical_gap, {"orphan_ratio": 15} | many),
    }
    return found, tables


@register("gap_run_all", f"SELECT * FROM ({_GAP_ALL}) ORDER BY salience DESC, signature LIMIT 100")
def gap_run_all(spark, sf_dir):
    found, tables = _gaps(spark, sf_dir)
    return rounded(registry.run_all(spark, found, tables)[0], "salience").select("type", "signature", "salience")


@register("reg_errors", "SELECT * FROM (VALUES ('evidence', 'no table results'), ('empirical', 'no table claims'), ('practical', 'no table claims')) t(type, error)")
def reg_errors(spark, sf_dir):
    """What is named when tables are not there; the other detectors run."""
    found, tables = _gaps(spark, sf_dir)
    errors = registry.run_all(spark, found, {k: v for k, v in tables.items() if k not in ("results", "claims")})[1]
    return spark.createDataFrame(sorted(errors.items()), "type string, error string")


def _counts(spark, sf_dir, **other):
    t = {"papers": view(spark, sf_dir, "papers"), "fields": view(spark, sf_dir, "fields"), "results": view(spark, sf_dir, "results"), "claims": view(spark, sf_dir, "claims"), "citations": view(spark, sf_dir, "cites")}
    return registry.corpus_counts(**(t | other))


@register(
    "reg_corpus_counts",
    with_views("papers", "fields", "results", "claims", "cites") + """SELECT (SELECT count(*) FROM papers WHERE triage_label IN ('include', 'maybe')) AS corpus, (SELECT count(*) FROM fields) AS fields, (SELECT count(*) FROM results) AS results,
(SELECT count(*) FROM claims) AS claims, (SELECT count(stance) FROM claims) AS stanced, (SELECT count(*) FROM cites) AS citations""",
)
def reg_corpus_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@register(
    "reg_preconditions",
    "SELECT * FROM (VALUES ('bibliographic_coupling', 'citations'), ('citation_centrality', 'citations'), ('co_citation', 'citations'), ('empirical', 'claims,stanced'), ('main_path', 'citations'), ('practical', 'claims')) t(type, missing)",
)
def reg_preconditions(spark, sf_dir):
    """A corpus without claims and citations."""
    none = {"claims": view(spark, sf_dir, "claims").where("false"), "citations": view(spark, sf_dir, "cites").where("false")}
    return registry.preconditions(_counts(spark, sf_dir, **none)).withColumn("missing", F.array_join("missing", ","))


@register(
    "reg_missing_inputs",
    "SELECT * FROM (VALUES ('empirical', 'claims', 'empty'), ('practical', 'claims', 'empty'), ('theoretical', 'anchors', 'kinds: ECONOMY, LARGE, MEDIUM, PROMO, SMALL, STANDARD'), ('knowledge', 'system_domain', 'known for 0% of papers'), ('population', 'system_domain', 'known for 0% of papers')) t(type, input, told)",
)
def reg_missing_inputs(spark, sf_dir):
    """A corpus whose domains are not known, and that has no claims."""
    coverage = reports.field_coverage(view(spark, sf_dir, "papers"), view(spark, sf_dir, "fields").where("field_name <> 'system_domain'"))
    sizes = reports.snapshot({"categories": view(spark, sf_dir, "categories"), "results": view(spark, sf_dir, "results"), "claims": view(spark, sf_dir, "claims").where("false")})
    kinds = view(spark, sf_dir, "usage").groupBy("kind").agg(F.count("*").alias("n"))
    return registry.missing_inputs(coverage, sizes, kinds)


@register(
    "reg_dismissals",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS a, max(event_id) AS e FROM events GROUP BY 1) SELECT 'evidence' AS type, 's' || user_id AS signature, e AS "at" FROM l WHERE a IN ('click', 'purchase')""",
)
def reg_dismissals(spark, sf_dir):
    action = F.when(F.col("event_type").isin("click", "purchase"), "dismiss").otherwise("restore")
    return registry.dismissals(view(spark, sf_dir, "events").select(F.lit("evidence").alias("type"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("signature"), action.alias("action"), F.col("event_id").alias("at")))


@register(
    "reg_coherence",
    """WITH c AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'citation_centrality' WHEN 1 THEN 'lof_novelty' WHEN 2 THEN 'theoretical' ELSE 'evidence' END AS type, l_suppkey, max(l_quantity * 1000 + l_suppkey % 1000) AS salience FROM lineitem GROUP BY ALL),
b AS (SELECT *, 's' || lpad(l_suppkey::VARCHAR, 9, '0') AS signature FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY salience DESC, signature) <= 60), p AS (SELECT l_suppkey::VARCHAR AS paper_id, list_sort(list(DISTINCT type)) AS t FROM b GROUP BY 1)
SELECT paper_id, 'central_and_novel' AS kind, array_to_string(t, ',') AS types FROM p WHERE list_contains(t, 'citation_centrality') AND list_contains(t, 'lof_novelty') UNION ALL SELECT paper_id, 'signal_stack', array_to_string(t, ',') FROM p WHERE len(t) >= 3
UNION ALL SELECT paper_id, 'orphan_and_central', array_to_string(t, ',') FROM p WHERE list_contains(t, 'citation_centrality') AND list_contains(t, 'theoretical')""",
)
def reg_coherence(spark, sf_dir):
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'citation_centrality' WHEN 1 THEN 'lof_novelty' WHEN 2 THEN 'theoretical' ELSE 'evidence' END")
    best = view(spark, sf_dir, "lineitem").groupBy(kind.alias("type"), "l_suppkey").agg(F.max(F.col("l_quantity") * 1000 + F.col("l_suppkey") % 1000).alias("salience"))
    name = F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.when(F.col("type") == "theoretical", "|reason=orphan").otherwise(""))
    return registry.coherence_conflicts(best.select("type", name.alias("signature"), "salience", F.array(F.col("l_suppkey").cast("string")).alias("papers")), 60)


@register("reg_merged", "SELECT 'x' AS type, p_brand AS signature, max(p_retailprice) AS salience, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS papers FROM part GROUP BY p_brand")
def reg_merged(spark, sf_dir):
    rows = view(spark, sf_dir, "part").select(F.lit("x").alias("type"), F.col("p_brand").alias("signature"), F.col("p_retailprice").alias("salience"), F.array("p_name").alias("papers"))
    return registry.merge_papers(rows).withColumn("papers", F.array_join("papers", ","))


@register("reg_papers_list", "SELECT p_brand, string_agg(k::VARCHAR, ',' ORDER BY k) AS papers FROM (SELECT DISTINCT p_brand, p_size AS k FROM part) GROUP BY 1")
def reg_papers_list(spark, sf_dir):
    return view(spark, sf_dir, "part").groupBy("p_brand").agg(papers_list("p_size").alias("papers"))


@register("reg_cluster_signatures", "SELECT label, 'empirical:cluster:' || array_to_string(list_sort(list(vec_id::VARCHAR))[:3], ',') AS signature FROM embeddings GROUP BY 1")
def reg_cluster_signatures(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list("vec_id").alias("p")).select("label", registry.cluster_signature("empirical", F.col("p")).alias("signature"))


_NOTE_STATUS = "CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 3 = 1 THEN 'draft' ELSE 'valid' END"


@register(
    "reg_signal_cards",
    with_views("texts") + f""", o AS (SELECT o_orderkey, {_NOTE_STATUS} AS s FROM orders), g AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size = 1),
c AS (SELECT CASE WHEN (SELECT count(*) FROM texts WHERE triage_label = '') >= 20 THEN 'red' ELSE 'yellow' END AS severity, 'triage.pending' AS card, (SELECT count(*) FROM texts WHERE triage_label = '') AS n
UNION ALL SELECT 'yellow', 'triage.maybe', (SELECT count(*) FROM texts WHERE triage_label = 'maybe')
UNION ALL SELECT 'yellow', 'download.missing_files', (SELECT count(*) FROM texts WHERE triage_label IN ('include', 'maybe') AND lang <> 'en')
UNION ALL SELECT 'red', 'notes.missing', (SELECT count(*) FROM o WHERE s = 'none') UNION ALL SELECT 'yellow', 'notes.draft', (SELECT count(*) FROM o WHERE s = 'draft')
UNION ALL SELECT 'yellow', 'synthesis.unscored_candidates', (SELECT count(*) FROM benchmark) UNION ALL SELECT 'red', 'catalogue.must_cite_missing', (SELECT count(*) FROM part WHERE p_size = 50)
UNION ALL SELECT 'yellow', 'catalogue.other_missing', (SELECT count(*) FROM part WHERE p_size < 20) UNION ALL SELECT 'yellow', 'snowball.not_run', (SELECT count(*) FROM texts WHERE triage_label = 'include')
UNION ALL SELECT 'yellow', 'corpus.empty_cells', (SELECT count(DISTINCT p_brand) * count(DISTINCT p_type) - count(*) FROM g)) SELECT * FROM c WHERE n > 0""",
)
def reg_signal_cards(spark, sf_dir):
    texts, orders, parts = view(spark, sf_dir, "texts"), view(spark, sf_dir, "orders"), view(spark, sf_dir, "part")
    coverage = parts.select(F.col("p_partkey").alias("paper_id"), (F.col("p_size") == 50).alias("must_cite"), F.when((F.col("p_size") < 20) | (F.col("p_size") == 50), 0).otherwise(1).alias("n"))
    jobs = spark.createDataFrame([], "status string, last_error string, new_added int")
    cells = parts.where("p_size = 1").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("method")).agg(F.count("*").alias("n_papers"))
    return registry.signal_cards(
        texts.select("paper_id", F.col("triage_label").alias("label")), orders.select(F.col("o_orderkey").alias("paper_id"), F.expr(_NOTE_STATUS).alias("note_status")), texts.where("lang = 'en'").select("paper_id"),
        view(spark, sf_dir, "benchmark").select(F.col("text").alias("title"), F.lit("").alias("overall")), coverage, jobs, spark.createDataFrame([], "a long, b long"), cells,
    )


@register("reg_next_step", "SELECT * FROM (VALUES (0, 'setup', 'done'), (1, 'search', 'done'), (2, 'triage', 'open'), (3, 'read', 'locked'), (4, 'synthesis', 'locked'), (5, 'catalogue', 'locked')) t(nth, stage, status)")
def reg_next_step(spark, sf_dir):
    summary = {r["label"]: r["n"] for r in reports.label_summary(view(spark, sf_dir, "texts")).collect()}  # a row for each label
    return spark.createDataFrame([(i, *s) for i, s in enumerate(registry.next_step(True, True, summary, {}))], "nth int, stage string, status string")


@register(
    "reg_competitors",
    """WITH e AS (SELECT DISTINCT label AS candidate_id, vec_id AS paper_id FROM embeddings WHERE embedding[1] > 0.3), p AS (SELECT vec_id AS paper_id, label, embedding[2] > 0.3 AS must_cite, embedding[3] > 0.3 AS core FROM embeddings),
c AS (SELECT candidate_id, p.paper_id, CASE WHEN e2.paper_id IS NOT NULL THEN 0 WHEN p.label = candidate_id THEN 1 WHEN must_cite THEN 2 WHEN core THEN 3 END AS rank FROM (SELECT DISTINCT candidate_id FROM e) CROSS JOIN p LEFT JOIN e e2 USING (candidate_id, paper_id))
SELECT candidate_id, nth, paper_id, ['evidence', 'category', 'must cite', 'core'][rank + 1] AS why FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank, paper_id) AS nth FROM c WHERE rank IS NOT NULL) WHERE nth <= 8""",
)
def reg_competitors(spark, sf_dir):
    x = lambda i: F.element_at("embedding", i) > F.lit(0.3).cast("float")
    rows = view(spark, sf_dir, "embeddings")
    papers = rows.select(F.col("vec_id").alias("paper_id"), F.array("label").alias("category"), x(2).alias("must_cite"), F.when(x(3), "core").otherwise("peripheral").alias("relevance"))
    return registry.competitors(rows.where(x(1)).select(F.col("label").alias("candidate_id"), F.col("vec_id").alias("paper_id")), papers, 8)


@register(
    "reg_cluster_context",
    with_views("claims") + """, p AS (SELECT DISTINCT paper_id, topic FROM claims) SELECT a.paper_id, 'sibling' AS kind, b.paper_id::VARCHAR AS key, 1::BIGINT AS n FROM p a JOIN p b ON a.topic = b.topic AND a.paper_id <> b.paper_id
UNION ALL SELECT paper_id, 'claim cluster', cluster_id::VARCHAR, count(*) FROM claims GROUP BY ALL""",
)
def reg_cluster_context(spark, sf_dir):
    claims = view(spark, sf_dir, "claims")
    papers = claims.select("paper_id", F.col("topic").alias("paper_cluster_id")).distinct()
    return registry.cluster_context(papers, claims, papers.select("paper_id"))


_ROWS = "SELECT CASE WHEN c_nationkey = 0 THEN '' ELSE 'p' || c_custkey END AS paper_id, ' ' || c_name AS title, c_mktsegment || ', ' || c_name || ',' AS authors, CASE WHEN c_nationkey = 1 THEN 'n.d.' ELSE CAST(1990 + c_nationkey AS VARCHAR(4)) END AS year, 'v' AS venue, 'maybe' AS triage_label FROM customer"


@register(
    "ing_sync_papers",
    "SELECT 'p' || c_custkey AS paper_id, c_name AS title, CASE WHEN c_nationkey = 1 THEN NULL ELSE 1990 + c_nationkey END AS year, 'maybe' AS triage_label FROM customer WHERE c_nationkey <> 0 UNION ALL SELECT 's' || s_suppkey, s_name, 2000, 'include' FROM supplier",
)
def ing_sync_papers(spark, sf_dir):
    return _synced(spark, sf_dir)[0].select("paper_id", "title", "year", "triage_label")


def _synced(spark, sf_dir):
    view(spark, sf_dir, "customer")
    old = spark.sql("SELECT 's' || s_suppkey AS paper_id, s_name AS title, 2000 AS year, 'w' AS venue, 'include' AS triage_label FROM supplier UNION ALL SELECT 'p' || c_custkey, 'old', 1, 'w', '' FROM customer WHERE c_nationkey > 12")
    return ingest.synced_papers(spark.sql(_ROWS), old)


@register("ing_sync_authors", "SELECT 'p' || c_custkey AS paper_id, 1 AS position, c_mktsegment AS author FROM customer WHERE c_nationkey <> 0 UNION ALL SELECT 'p' || c_custkey, 2, c_name FROM customer WHERE c_nationkey <> 0")
def ing_sync_authors(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@register("ing_sync_counts", "SELECT count(*) FILTER (c_nationkey BETWEEN 1 AND 12) AS inserted, count(*) FILTER (c_nationkey > 12) AS updated, count(*) FILTER (c_nationkey = 0) AS skipped FROM customer")
def ing_sync_counts(spark, sf_dir):
    return _synced(spark, sf_dir)[2]


@register(
    "ing_chunk_sections",
    "SELECT conv_id AS paper_id, CASE WHEN role = 'system' THEN 'other' ELSE role END AS label, count(*) AS n FROM conversations GROUP BY ALL",
)
def ing_chunk_sections(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text", "role")
    chunks = rows.select("paper_id", "chunk_id", "text")
    return ingest.ingested_chunks(chunks, rows.where("role <> 'system'").select("chunk_id", F.col("role").alias("label")), chunks.limit(0))[1]


_LAST = "l AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1)"


@register("ing_decided", f"WITH {_LAST} SELECT vec_id AS row_index, coalesce(e, label::VARCHAR) AS triage_label, CASE WHEN e IS NULL THEN 'old' ELSE 'by ' || e END AS reason FROM embeddings LEFT JOIN l ON vec_id = user_id")
def ing_decided(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("label").cast("string").alias("triage_label"), F.lit("old").alias("reason"))
    return ingest.decided(rows, view(spark, sf_dir, "events").select(F.col("user_id").alias("row_index"), F.col("event_type").alias("label"), F.concat(F.lit("by "), F.col("event_type")).alias("reason"), F.col("event_id").alias("at")))


@register("ing_suggested", f"WITH {_LAST} SELECT user_id AS row_index, e AS suggestion, CASE WHEN label < 5 THEN 'set' ELSE 'skipped' END AS status FROM l LEFT JOIN embeddings ON vec_id = user_id")
def ing_suggested(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("row_index"))
    return ingest.suggested(rows, view(spark, sf_dir, "events").select(F.col("user_id").alias("row_index"), F.col("event_type").alias("suggestion"), F.col("event_id").alias("at")))


_ATTEMPTS = "SELECT l_orderkey AS paper_id, l_linenumber AS nth, l_returnflag AS source, l_quantity > 40 AS ok, 'x' AS reason FROM lineitem"


@register(
    "ing_download_log",
    f"""WITH a AS ({_ATTEMPTS}), f AS (SELECT paper_id, min(nth) AS upto FROM a WHERE ok GROUP BY 1), n AS (SELECT paper_id, count(*) AS n_attempts FROM a LEFT JOIN f USING (paper_id) WHERE upto IS NULL OR nth <= upto GROUP BY 1)
SELECT paper_id, CASE WHEN upto IS NULL THEN 'manual' ELSE 'downloaded' END AS status, n_attempts FROM n LEFT JOIN f USING (paper_id)""",
)
def ing_download_log(spark, sf_dir):
    view(spark, sf_dir, "lineitem")
    return ingest.download_log(spark.sql(_ATTEMPTS)).select("paper_id", "status", "n_attempts")


@register("ing_manual_list", f"WITH a AS ({_ATTEMPTS}) SELECT o_orderkey AS paper_id, o_orderpriority AS title FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (SELECT paper_id FROM a WHERE ok)")
def ing_manual_list(spark, sf_dir):
    view(spark, sf_dir, "lineitem")
    papers = view(spark, sf_dir, "papers").select("paper_id", F.col("venue").alias("title"), "triage_label")
    return ingest.manual_list(papers, ingest.download_log(spark.sql(_ATTEMPTS)))


@register(
    "ing_stage_status",
    with_views("texts") + """, p AS (SELECT paper_id, lang = 'en' AS f, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = paper_id) AS v FROM texts WHERE triage_label IN ('include', 'maybe'))
SELECT count(*) AS labelled, count(*) FILTER (f) AS with_file, count(*) FILTER (v) AS with_vector, count(*) FILTER (f AND NOT v) AS waiting, count(*) FILTER (v) > 0 AND count(*) FILTER (f AND NOT v) = 0 AS ready FROM p""",
)
def ing_stage_status(spark, sf_dir):
    texts = view(spark, sf_dir, "texts")
    return ingest.stage_status(texts, texts.where("lang = 'en'"), view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id")))


@register("ing_target_progress", with_views("texts") + ", n AS (SELECT count(*) FILTER (triage_label = 'include') AS n FROM texts) SELECT n AS included, round(least(100, 100 * n / 5000), 2) AS pct, n >= 50 AS enough, greatest(0, 5000 - n) AS missing FROM n")
def ing_target_progress(spark, sf_dir):
    return ingest.target_progress(view(spark, sf_dir, "texts"), 5000, 50)


@register(
    "ing_paper_view",
    with_views("papers", "fields", "usage", "results") + """SELECT paper_id, (SELECT count(*) FROM fields f WHERE f.paper_id = p.paper_id) AS n_fields, coalesce((SELECT count(DISTINCT (kind, canonical)) FROM usage u WHERE u.paper_id = p.paper_id), 0) AS n_names,
(SELECT count(*) FROM results r WHERE r.paper_id = p.paper_id) AS n_results FROM papers p""",
)
def ing_paper_view(spark, sf_dir):
    found = ingest.paper_view(*(view(spark, sf_dir, v) for v in ("papers", "fields", "usage", "results")))
    names = F.aggregate(F.map_values("names"), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("paper_id", F.size(F.map_keys("fields")).alias("n_fields"), names.alias("n_names"), F.size("results").alias("n_results"))


@register(
    "ing_edited",
    with_views("fields") + f""", e AS (SELECT o_orderkey AS paper_id, 'sample_type' AS field_name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'edited' END AS field_value FROM orders WHERE o_orderstatus <> 'F')
SELECT f.paper_id, f.field_name, f.field_value, 'extracted' AS mechanism FROM fields f LEFT JOIN e USING (paper_id, field_name) WHERE e.paper_id IS NULL AND f.field_name <> 'total_price' UNION ALL SELECT paper_id, field_name, field_value, 'user_edit' FROM e WHERE field_value IS NOT NULL""",
)
def ing_edited(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("paper_id"), F.lit("sample_type").alias("field_name"), "o_orderstatus")
    first = orders.select("paper_id", "field_name", F.lit("old").alias("field_value"), F.lit(1).alias("at"))
    edits = first.union(orders.select("paper_id", "field_name", F.when(F.col("o_orderstatus") != "P", "edited").alias("field_value"), F.lit(2).alias("at")))
    return ingest.edited(view(spark, sf_dir, "fields").where("field_name <> 'total_price'"), edits)


@register("ing_document_text", "SELECT conv_id AS paper_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def ing_document_text(spark, sf_dir):
    found = ingest.document_text(view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_idx"), "text"))
    return found.select("paper_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _texts(spark, sf_dir):
    papers = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("abstract"))
    claims = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    spans = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("span_id"), F.col("s_name").alias("span"), F.lit("in context").alias("context"))
    return ingest.texts_to_embed(papers, claims, spans, 100)


_TEXTS = """t AS (SELECT 'paper' AS kind, p_partkey::VARCHAR AS id, p_name || chr(10) || CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS text FROM part UNION ALL SELECT 'claim', item_id::VARCHAR, substr(trim(text), 1, 100) FROM benchmark UNION ALL SELECT 'entity', s_suppkey::VARCHAR, s_name || '. in context' FROM supplier),
h AS (SELECT kind, id, sha256(text)[:32] AS hash FROM t WHERE trim(text) <> '')"""


@register("ing_texts_to_embed", f"WITH {_TEXTS} SELECT * FROM h")
def ing_texts_to_embed(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", "hash")


@register("ing_work_items", f"WITH {_TEXTS} SELECT * FROM h WHERE kind <> 'entity' AND NOT (kind = 'paper' AND hash < '8')")
def ing_work_items(spark, sf_dir):
    texts = _texts(spark, sf_dir).select("kind", "id", "hash")
    return ingest.work_items(texts, texts.where("kind = 'paper' and hash < '8'"), texts.where("kind = 'entity'"))


@register(
    "ing_retrieval_contexts",
    """WITH g AS (SELECT l_suppkey AS q, l_partkey AS id, max(l_quantity) AS x FROM lineitem GROUP BY ALL), h AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY x DESC, id) AS rank FROM g),
o AS (SELECT 'a' || q AS anchor, id, rank, 'text of ' || id AS text FROM h WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, anchor) = 1),
b AS (SELECT *, sum(length(text)) OVER (PARTITION BY anchor ORDER BY rank, id) - length(text) AS before FROM o) SELECT anchor, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank, id)) AS digest, count(*) AS n FROM b WHERE before < 60 GROUP BY 1""",
)
def ing_retrieval_contexts(spark, sf_dir):
    from pyspark.sql.window import Window

    per = view(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("x"))
    hits = per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "id"))).withColumn("text", F.concat(F.lit("text of "), F.col("id").cast("string")))
    anchors = per.select("query_id", F.concat(F.lit("a"), F.col("query_id").cast("string")).alias("anchor")).distinct()
    found = ingest.retrieval_contexts(anchors, hits.drop("x"), 10, 60)
    return found.select("anchor", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("ids").cast("long").alias("n"))


@register(
    "ing_prompts",
    """WITH c AS (SELECT conv_id, turn, substr(text, 1, 400) AS text, sum(length(substr(text, 1, 400)) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations), p AS (SELECT *, floor((upto - 1) / 402)::INT AS part FROM c)
SELECT conv_id AS paper_id, part, md5('Find claims.' || chr(10) || chr(10) || string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM p GROUP BY ALL""",
)
def ing_prompts(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("paragraph_idx"), "text")
    return ingest.prompts(rows, "Find claims.", "[]", 400).select("paper_id", "part", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@register("ing_json_answers", "SELECT p_partkey, p_name AS name, 2 AS n FROM part")
def ing_json_answers(spark, sf_dir):
    answer = F.concat(F.lit('Sure:\n```json\n[{"name": "'), F.col("p_name"), F.lit('"}, {"name": "x"}]\n```\nDone.'))
    found = view(spark, sf_dir, "part").select("p_partkey", ingest.json_array(answer).alias("a"))
    return found.select("p_partkey", F.element_at("a", 1)["name"].alias("name"), F.size("a").alias("n"))


@register("ing_synthetic_prototypes", "SELECT DISTINCT CASE WHEN p_size < 25 THEN 'include' ELSE 'exclude' END AS side, CASE WHEN p_size < 25 THEN 'A study of gears: ' || p_name ELSE p_name END AS text FROM part")
def ing_synthetic_prototypes(spark, sf_dir):
    rows = view(spark, sf_dir, "part").select(F.when(F.col("p_size") < 25, "include").otherwise("exclude").alias("side"), F.concat(F.lit("- "), F.col("p_name")).alias("criterion"))
    return ingest.synthetic_prototypes(rows, "gears")


@register("ing_pending_rows", "SELECT o_orderkey AS id, '' AS triage_label FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def ing_pending_rows(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    as_found = lambda p: orders.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doi"), F.col("o_custkey").alias("arxiv_id"), F.lit("").alias("openalex_id"), F.lit("").alias("title"))
    return ingest.pending_rows(as_found("1-URGENT"), as_found("5-LOW")).select("id", "triage_label")


@register("ing_numbered_ids", "WITH u AS (SELECT o_orderkey::BIGINT AS k, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey > 0), s AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS k FROM supplier), n AS (SELECT s_name, s.k + coalesce(max(u.i) FILTER (u.k - u.i < s.k), 0) AS n FROM s LEFT JOIN u ON true GROUP BY s_name, s.k) SELECT s_name, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS paper_id FROM n")
def ing_numbered_ids(spark, sf_dir):
    from corpusloom.sources.project import numbered_ids

    used = view(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("paper_id"))
    return numbered_ids(view(spark, sf_dir, "supplier").select("s_name"), used, "s_name")


@register("ing_provenance", "SELECT l_returnflag, count(*) AS n, count(*) AS ids, 'regex' AS mechanism FROM lineitem GROUP BY 1")
def ing_provenance(spark, sf_dir):
    from corpusloom.sources.project import with_provenance

    facts, rows = with_provenance(view(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "regex", raw_text="l_returnflag")
    joined = facts.join(rows, "prov_id")
    return joined.groupBy("l_returnflag", "mechanism").agg(F.count("*").alias("n"), F.count_distinct("prov_id").alias("ids"))


@register("net_rerank_all", with_views("cites", "claims") + ", d AS (SELECT dst, count(*) AS n FROM cites GROUP BY 1), c AS (SELECT DISTINCT cluster_id, paper_id FROM claims) SELECT cluster_id, round(avg(1 + ln(1 + coalesce(n, 0))), 6) AS weight FROM c LEFT JOIN d ON dst = paper_id GROUP BY 1")
def net_rerank_all(spark, sf_dir):
    claims = view(spark, sf_dir, "claims").select(F.col("cluster_id").cast("string").alias("signature"), "paper_id", F.lit(1.0).alias("salience")).distinct()
    found = network.rerank(claims.select("signature", "salience").distinct(), claims.select("signature", "paper_id"), view(spark, sf_dir, "cites"))
    return rounded(found, "weight").select(F.col("signature").cast("int").alias("cluster_id"), "weight")
