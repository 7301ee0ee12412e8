"""Bringing rows in and handing structured rows out: papers from CSV, chunks with sections, edits, views of a paper, texts to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.entities import existing


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def synced_papers(rows: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, authors, counts) after CSV rows (paper_id, title, authors, year, venue, triage_label) are merged in.

    Rows without an id are left out; a row of a known id replaces it, others stay. A year that is no number is null. Authors are numbered from 1 in their order.
    counts: (inserted, updated, skipped).
    """
    valid = rows.where(_text("paper_id") != "")
    new = valid.select(_text("paper_id").alias("paper_id"), _text("title").alias("title"), F.trim("year").try_cast("int").alias("year"), _text("venue").alias("venue"), _text("triage_label").alias("triage_label"))
    kept = papers.join(new.select("paper_id"), "paper_id", "left_anti").select(*new.columns)
    names = F.filter(F.split(_text("authors"), r",\s*"), lambda a: a != "")
    authors = valid.select(_text("paper_id").alias("paper_id"), F.posexplode(names).alias("position", "author")).withColumn("position", F.col("position") + 1)
    known = new.join(papers.select("paper_id").withColumn("old", F.lit(True)), "paper_id", "left").agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old")).alias("updated"))
    counts = known.crossJoin(rows.agg(F.count_if(_text("paper_id") == "").alias("skipped")))  # one row each
    return kept.unionByName(new), authors, counts


def ingested_chunks(chunks: DataFrame, labels: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks after, sections): chunks (paper_id, chunk_id, text) replace those of the same papers in current; sections counts labels (chunk_id, label) by paper."""
    kept = current.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti").select(*chunks.columns)
    counted = chunks.join(labels, "chunk_id", "left").groupBy("paper_id", F.coalesce("label", F.lit("other")).alias("label")).agg(F.count("*").alias("n"))
    return kept.unionByName(chunks), counted


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (row_index, triage_label, reason) after decisions (row_index, label, reason, at): the last of a row counts, a row that is not there is left out."""
    last = decisions.groupBy("row_index").agg(F.max_by(F.struct("label", "reason"), "at").alias("d"))
    joined = rows.join(last.select("row_index", F.col("d.label").alias("new_label"), F.col("d.reason").alias("new_reason")), "row_index", "left")
    return joined.select(*[F.coalesce("new_label", "triage_label").alias(c) if c == "triage_label" else F.when(F.col("new_label").isNotNull(), F.col("new_reason")).otherwise(F.col("reason")).alias(c) if c == "reason" else F.col(c) for c in rows.columns])


def suggested(rows: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(row_index, suggestion, status): what becomes of suggestions (row_index, suggestion, at): the last counts, and one for a row that is not there is skipped."""
    last = suggestions.groupBy("row_index").agg(F.max_by("suggestion", "at").alias("suggestion"))
    return last.join(rows.select("row_index").withColumn("known", F.lit(True)), "row_index", "left").select("row_index", "suggestion", F.when(F.col("known"), "set").otherwise("skipped").alias("status"))


def pending_rows(found: DataFrame, corpus: DataFrame, title: str = "title") -> DataFrame:
    """found (doi, arxiv_id, openalex_id, title, …) that the corpus does not have by any of these, with an empty label: rows to be triaged."""
    return existing(found, corpus, ["doi", "arxiv_id", "openalex_id"], title).where("matched_by is null").drop("matched_by").withColumn("triage_label", F.lit(""))


def download_log(attempts: DataFrame) -> DataFrame:
    """(paper_id, status, n_attempts, source): the outcome of each paper's attempts (paper_id, nth, source, ok, reason), up to the first that worked."""
    first = attempts.where("ok").groupBy("paper_id").agg(F.min_by(F.struct("source", "nth"), "nth").alias("s"))
    n = attempts.join(first.select("paper_id", F.col("s.nth").alias("upto")), "paper_id", "left").where("upto is null or nth <= upto").groupBy("paper_id").agg(F.count("*").alias("n_attempts"))
    return n.join(first, "paper_id", "left").select("paper_id", F.when(F.col("s").isNotNull(), "downloaded").otherwise("manual").alias("status"), "n_attempts", F.col("s.source").alias("source"))


def manual_list(papers: DataFrame, log: DataFrame) -> DataFrame:
    """Labelled papers whose every attempt failed, or that have none: to be fetched by hand."""
    return papers.where(F.col("triage_label").isin("include", "maybe")).join(log.where("status = 'downloaded'").select("paper_id"), "paper_id", "left_anti").select("paper_id", "title")


def stage_status(papers: DataFrame, files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: papers labelled, with a file, with a vector, and whether all that can be embedded is."""
    p = papers.where(F.col("triage_label").isin("include", "maybe")).select("paper_id")
    have = p.join(files.select("paper_id").distinct().withColumn("f", F.lit(1)), "paper_id", "left").join(vectors.select("paper_id").distinct().withColumn("v", F.lit(1)), "paper_id", "left")
    counts = have.agg(F.count("*").alias("labelled"), F.count("f").alias("with_file"), F.count("v").alias("with_vector"), F.count_if(F.col("f").isNotNull() & F.col("v").isNull()).alias("waiting"))
    return counts.withColumn("ready", (F.col("with_vector") > 0) & (F.col("waiting") == 0))


def target_progress(papers: DataFrame, target: int, minimum: int) -> DataFrame:
    """One row: included papers against the topic's target and minimum, in percent, and what is still missing."""
    n = papers.agg(F.count_if(F.col("triage_label") == "include").alias("included"))
    return n.select("included", F.round(F.least(F.lit(100.0), F.try_divide(100 * F.col("included"), F.lit(target))), 2).alias("pct"), (F.col("included") >= minimum).alias("enough"), F.greatest(F.lit(0), F.lit(target) - F.col("included")).alias("missing"))


def paper_view(papers: DataFrame, fields: DataFrame, usage: DataFrame, results: DataFrame) -> DataFrame:
    """(paper_id, fields, names, results): each paper's facts as one row: a map of fields, names by kind with their number, results in order of metric."""
    f = fields.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field_name", "field_value")))).alias("fields"))
    per = usage.groupBy("paper_id", "kind").agg(F.count_distinct("canonical").alias("n"))
    u = per.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("names"))
    r = results.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("metric", "dataset", "value"))).alias("results"))
    out = papers.select("paper_id").join(f, "paper_id", "left").join(u, "paper_id", "left").join(r, "paper_id", "left")
    empty = {"fields": F.create_map().cast("map<string,string>"), "names": F.create_map().cast("map<string,bigint>")}
    return out.select("paper_id", *[F.coalesce(c, empty[c]).alias(c) for c in empty], F.coalesce(F.col("results"), F.array().cast(results_type(results))).alias("results"))


def results_type(results: DataFrame) -> str:
    return "array<" + results.select(F.struct("metric", "dataset", "value").alias("r")).schema["r"].dataType.simpleString() + ">"


def edited(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """(paper_id, field_name, field_value, mechanism): fields after a person's edits (paper_id, field_name, field_value, at); the last edit counts, a null value removes the field."""
    last = edits.groupBy("paper_id", "field_name").agg(F.max_by(F.struct("field_value"), "at").alias("e"))
    kept = fields.join(last, ["paper_id", "field_name"], "left_anti").select("paper_id", "field_name", "field_value", F.lit("extracted").alias("mechanism"))
    return kept.union(last.where("e.field_value is not null").select("paper_id", "field_name", "e.field_value", F.lit("user_edit")))


def document_text(chunks: DataFrame) -> DataFrame:
    """(paper_id, text): a paper's chunks (paper_id, chunk_idx, text) in order, a blank line between."""
    listed = chunks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("x"))
    return listed.select("paper_id", F.array_join(F.transform("x", lambda c: c["text"]), "\n\n").alias("text"))


def texts_to_embed(papers: DataFrame, claims: DataFrame, spans: DataFrame, characters: int = 2000) -> DataFrame:
    """(kind, id, text, hash): what is embedded of papers (title, abstract), claims (text) and spans (span, context); blank ones are left out, the hash tells of changes."""
    p = papers.select(F.lit("paper").alias("kind"), F.col("paper_id").cast("string").alias("id"), F.concat_ws("\n", _text("title"), _text("abstract")).alias("text"))
    c = claims.select(F.lit("claim"), F.col("claim_id").cast("string"), _text("text"))
    s = spans.select(F.lit("entity"), F.col("span_id").cast("string"), F.concat_ws(". ", _text("span"), _text("context")))
    cut = p.union(c).union(s).withColumn("text", F.substring("text", 1, characters)).where(F.trim("text") != "")
    return cut.withColumn("hash", content_hash(F.col("text")))


def content_hash(text: Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def work_items(texts: DataFrame, stored: DataFrame, attempted: DataFrame) -> DataFrame:
    """texts (kind, id, hash, …) without a stored vector of the same content, and not attempted in this session (kind, id, hash)."""
    keys = ["kind", "id", "hash"]
    return texts.join(stored.select(*keys).distinct(), keys, "left_anti").join(attempted.select(*keys).distinct(), keys, "left_anti")


def retrieval_contexts(anchors: DataFrame, hits: DataFrame, per_anchor: int, characters: int) -> DataFrame:
    """(anchor, text, ids): for each anchor (anchor, query_id) the texts of its hits (query_id, rank, id, text), best first, each text at one anchor only, within a budget of characters.

    A text that several anchors find goes to the one that ranks it best.
    """
    near = hits.join(anchors, "query_id").where(F.col("rank") <= per_anchor)
    mine = near.withColumn("owner", F.row_number().over(Window.partitionBy("id").orderBy("rank", "anchor"))).where("owner = 1")
    order = Window.partitionBy("anchor").orderBy("rank", "id")
    used = mine.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).where(F.col("before") < characters)
    listed = used.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("x"))
    return listed.select("anchor", F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("text"), F.transform("x", lambda r: r["id"]).alias("ids"))


def synthetic_prototypes(criteria: DataFrame, topic: str) -> DataFrame:
    """(side, text): sentences that a wanted or unwanted paper might have, from inclusion and exclusion criteria (side, criterion), to be embedded until people have decided enough."""
    line = F.trim(F.regexp_replace("criterion", r"^[-*\d.)\s]+", ""))
    told = F.when(F.col("side") == "include", F.concat(F.lit(f"A study of {topic}: "), line)).otherwise(line)
    return criteria.where(line != "").select("side", told.alias("text")).distinct()


def prompts(docs: DataFrame, instruction: str, schema: str, characters: int) -> DataFrame:
    """(paper_id, part, prompt, schema): instructions with a paper's paragraphs (paper_id, paragraph_idx, text) in parts of at most ``characters``; a longer paragraph is a part of its own, cut."""
    order = Window.partitionBy("paper_id").orderBy("paragraph_idx")
    cut = docs.withColumn("text", F.substring("text", 1, characters)).withColumn("upto", F.sum(F.length("text") + 2).over(order))
    part = F.floor((F.col("upto") - 1) / (characters + 2)).cast("int")
    listed = cut.groupBy("paper_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("paragraph_idx", "text"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["paragraph_idx"].cast("string"), F.lit("] "), r["text"])), "\n\n")
    return listed.select("paper_id", "part", F.concat(F.lit(instruction + "\n\n"), body).alias("prompt"), F.lit(schema).alias("schema"))


def json_array(answer: Column) -> Column:
    """The first JSON array of objects in a model's answer, whatever stands around it, as an array of maps; empty where there is none."""
    body = F.regexp_extract(F.regexp_replace(answer, r"(?s)```(?:json)?", ""), r"(?s)(\[\s*\{.*\}\s*\])", 1)
    return F.coalesce(F.from_json(body, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
