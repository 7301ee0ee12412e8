"""The detectors by name: what each needs, running one or all, dismissals, missing inputs, coherence of what they flag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.common import top
from corpusloom.scale import eligible

CANDIDATES = "type string, signature string, salience double, papers array<string>"


@dataclass(frozen=True)
class Detector:
    """A detector: its category, the tables it reads, and a function from those tables to candidates (signature, salience, and papers if it names any)."""

    category: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)


def as_candidates(kind: str, found: DataFrame) -> DataFrame:
    papers = F.transform(F.col("papers"), lambda p: p.cast("string")) if "papers" in found.columns else F.array().cast("array<string>")
    return found.select(F.lit(kind).alias("type"), "signature", F.col("salience").cast("double").alias("salience"), papers.alias("papers"))


def cluster_signature(kind: str, papers) -> F:
    """``kind:cluster:`` and the three smallest papers, as text."""
    return F.concat(F.lit(f"{kind}:cluster:"), F.array_join(F.slice(F.array_sort(F.transform(papers, lambda p: p.cast("string"))), 1, 3), ","))


def run_one(kind: str, detector: Detector, tables: dict[str, DataFrame], dismissed: DataFrame | None = None) -> DataFrame:
    """CANDIDATES of one detector, without those dismissed (type, signature)."""
    found = as_candidates(kind, detector.run(*[tables[n] for n in detector.needs], **detector.options))
    return found if dismissed is None else found.join(dismissed.select("type", "signature").distinct(), ["type", "signature"], "left_anti").select(*found.columns)


def run_all(spark: SparkSession, registry: dict[str, Detector], tables: dict[str, DataFrame], dismissed: DataFrame | None = None, limit: int = 100) -> tuple[DataFrame, dict[str, str]]:
    """(the most salient candidates of all detectors, errors by type). A detector that lacks a table or cannot be planned is left out and named."""
    parts, errors = [], {}
    for kind, detector in registry.items():
        lacking = [n for n in detector.needs if n not in tables]
        try:
            if lacking:
                raise LookupError("no table " + ", ".join(lacking))
            parts.append(run_one(kind, detector, tables, dismissed))
        except (LookupError, PySparkException, ValueError) as error:
            errors[kind] = str(error).split("\n")[0]
    everything = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CANDIDATES)
    return top(everything, limit), errors


def corpus_counts(papers: DataFrame, fields: DataFrame, results: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: eligible papers, fields, results, claims, claims with a stance, citations."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(papers.where(eligible()), "corpus"), n(fields, "fields"), n(results, "results"), claims.agg(F.count("*").alias("claims"), F.count("stance").alias("stanced")), n(citations, "citations")]
    return reduce(DataFrame.crossJoin, parts)  # one row each


# Which table's rows each detector cannot do without.
WANTED = {
    "methodological": ["fields"], "knowledge": ["fields"], "population": ["fields"], "practical": ["fields", "claims"], "theoretical": ["fields"], "evidence": ["results"], "empirical": ["claims", "stanced"],
    "citation_centrality": ["citations"], "main_path": ["citations"], "co_citation": ["citations"], "bibliographic_coupling": ["citations"],
}


def preconditions(counts: DataFrame) -> DataFrame:
    """(type, missing) for each detector that cannot run on these :func:`corpus_counts`; without papers, all lack them alone."""
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.array(*[F.lit(n) for n in need]).alias("need"), F.array(*[F.col(n) for n in need]).alias("have")) for t, need in WANTED.items()])
    each = counts.select("corpus", F.explode(rows).alias("r")).select("corpus", "r.*")
    lacking = F.transform(F.filter(F.arrays_zip("need", "have"), lambda x: x["have"] == 0), lambda x: x["need"])
    return each.select("type", F.when(F.col("corpus") == 0, F.array(F.lit("corpus"))).otherwise(lacking).alias("missing")).where("size(missing) > 0")


# Entity kinds that can anchor a theory.
ANCHOR_KINDS = r"(?i)(framework|theory|concept|ideology|doctrine|paradigm|principle|model)"
LEAST_FILLED = 30.0


def missing_inputs(coverage: DataFrame, counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(type, input, told): which gap types lack input, from the coverage of fields (field_name, pct_known), table sizes (name, n) and entity kinds (kind, n).

    A field has to be known for LEAST_FILLED percent of the papers, a table to have rows, and some kind to anchor theories.
    """
    fields = {"methodological": "method_family", "knowledge": "system_domain", "population": "system_domain"}
    tables = {"methodological": "categories", "evidence": "results", "empirical": "claims", "practical": "claims"}
    spark = coverage.sparkSession
    want = spark.createDataFrame([*[(t, f, "field") for t, f in fields.items()], *[(t, n, "table") for t, n in tables.items()]], "type string, input string, what string")
    have = coverage.select(F.col("field_name").alias("input"), F.col("pct_known").cast("double").alias("n"), F.lit("field").alias("what")).union(counts.select("name", F.col("n").cast("double"), F.lit("table")))
    low = want.join(have, ["input", "what"], "left").where(F.when(F.col("what") == "field", F.coalesce("n", F.lit(0.0)) < LEAST_FILLED).otherwise(F.coalesce("n", F.lit(0.0)) == 0))
    told = low.select("type", "input", F.when(F.col("what") == "field", F.concat(F.lit("known for "), F.format_number(F.coalesce("n", F.lit(0.0)), 0), F.lit("% of papers"))).otherwise("empty").alias("told"))
    anchors = kinds.agg(F.coalesce(F.sum(F.when(F.col("kind").rlike(ANCHOR_KINDS), F.col("n"))), F.lit(0)).alias("anchors"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))
    none = anchors.where("anchors = 0").select(F.lit("theoretical").alias("type"), F.lit("anchors").alias("input"), F.concat(F.lit("kinds: "), F.coalesce(F.nullif("kinds", F.lit("")), F.lit("(none)"))).alias("told"))
    return told.union(none)


def dismissals(actions: DataFrame) -> DataFrame:
    """(type, signature, at): what is dismissed after all actions (type, signature, action, at); the last of dismiss and restore counts."""
    last = actions.groupBy("type", "signature").agg(F.max(F.struct("at", "action")).alias("l"))
    return last.where("l.action = 'dismiss'").select("type", "signature", "l.at")


def coherence_conflicts(candidates: DataFrame, leading: int = 10, types: int = 3) -> DataFrame:
    """(paper_id, kind, types): papers whose flags do not go together, from each detector's ``leading`` candidates.

    central_and_novel: citation-central and novel by vectors or n-grams. signal_stack: flagged by ``types`` detectors and more. orphan_and_central: in an orphan category, yet central.
    """
    order = Window.partitionBy("type").orderBy(F.desc("salience"), "signature")
    best = candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= leading)
    flags = best.select("type", F.explode(F.array_distinct("papers")).alias("paper_id"), F.col("signature").contains("reason=orphan").alias("orphan"))
    per = flags.groupBy("paper_id").agg(F.sort_array(F.collect_set("type")).alias("types"), F.max(F.col("orphan") & (F.col("type") == "theoretical")).alias("orphan"))
    central = F.array_contains("types", "citation_centrality")
    novel = F.arrays_overlap("types", F.array(F.lit("lof_novelty"), F.lit("ngram_novelty")))
    found = F.array_compact(F.array(F.when(central & novel, "central_and_novel"), F.when(F.size("types") >= types, "signal_stack"), F.when(central & F.col("orphan"), "orphan_and_central")))
    return per.select("paper_id", F.explode(found).alias("kind"), F.array_join("types", ",").alias("types"))


def merge_papers(found: DataFrame, by: str = "signature") -> DataFrame:
    """Candidates of one signature as one: the highest salience, and the papers of all, each once."""
    return found.groupBy("type", by).agg(F.max("salience").alias("salience"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("papers")))).alias("papers"))


# Severities, gravest first.
SEVERITY = ("red", "yellow", "green")


def signal_cards(labels: DataFrame, notes: DataFrame, files: DataFrame, candidates: DataFrame, coverage: DataFrame, jobs: DataFrame, pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(severity, card, n): what a project should look after, gravest first, then the larger.

    labels (paper_id, label); files (paper_id); notes (paper_id, note_status); candidates (title, overall); coverage (paper_id, must_cite, n), mentions of each paper in the
    catalogue; jobs (status, last_error, new_added); pairs (a, b), likely contradictions; cells (category, method, n_papers). A card without cases is left out.
    """
    labelled = labels.where(F.col("label").isin("include", "maybe"))
    n = lambda df, card, severity: df.agg(F.count("*").alias("n")).where("n > 0").select(severity.alias("severity") if hasattr(severity, "alias") else F.lit(severity).alias("severity"), F.lit(card).alias("card"), "n")
    blank = F.coalesce("label", F.lit("")) == ""
    unmentioned, all_papers = coverage.where("n = 0 and not must_cite"), coverage.agg(F.count("*").alias("total"))
    few = unmentioned.agg(F.count("*").alias("n")).crossJoin(all_papers).where("n >= 5 or (total > 0 and n >= 0.3 * total)").select(F.lit("yellow").alias("severity"), F.lit("catalogue.other_missing").alias("card"), "n")  # one row each
    rows, columns = cells.select("category").distinct(), cells.select("method").distinct()
    voids = rows.crossJoin(F.broadcast(columns)).join(cells.where("n_papers > 0"), ["category", "method"], "left_anti")  # axes of declared values
    included = labels.where("label = 'include'").agg(F.count("*").alias("n"))
    parts = [
        n(labels.where(blank), "triage.pending", F.when(F.col("n") >= 20, "red").otherwise("yellow")),
        n(labels.where("label = 'maybe'"), "triage.maybe", "yellow"),
        n(labelled.join(files, "paper_id", "left_anti"), "download.missing_files", "yellow"),
        n(notes.where("note_status = 'none'"), "notes.missing", "red"),
        n(notes.where("note_status = 'draft'"), "notes.draft", "yellow"),
        n(candidates.where(F.coalesce("overall", F.lit("")) == ""), "synthesis.unscored_candidates", "yellow"),
        n(coverage.where("n = 0 and must_cite"), "catalogue.must_cite_missing", "red"),
        few,
        included.join(jobs.limit(1), how="left_anti").where("n >= 3").select(F.lit("yellow"), F.lit("snowball.not_run"), "n"),
        n(jobs.where(F.coalesce("last_error", F.lit("")) != ""), "snowball.errored", "red"),
        n(jobs.where("status = 'finished' and new_added > 0"), "snowball.completed", "green"),
        n(pairs, "synthesis.contradictions", "yellow"),
        n(voids, "corpus.empty_cells", "yellow").where("n >= 2"),
    ]
    cards = reduce(DataFrame.union, parts)
    return cards.orderBy(F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity")), F.desc("n"), "card")


def next_step(setup: bool, searched: bool, summary: dict[str, int], notes: dict[str, int], synthesised: bool = False, catalogued: bool = False) -> list[tuple[str, str]]:
    """(stage, status) of the stages in order: done, open or locked. summary: rows by label (pending, include, maybe, exclude); notes: by status (none, draft, valid).

    Synthesis waits for notes: half of the labelled papers, and 20 at least.
    """
    labelled = summary.get("include", 0) + summary.get("maybe", 0)
    triaged = searched and summary.get("pending", 0) == 0 and labelled + summary.get("exclude", 0) > 0
    read = triaged and sum(notes.values()) > 0 and notes.get("none", 0) == 0 and notes.get("draft", 0) == 0
    enough = notes.get("valid", 0) >= max(20, labelled // 2)
    stages = [("setup", True, setup), ("search", setup, searched), ("triage", searched, triaged), ("read", triaged, read), ("synthesis", triaged and enough, synthesised), ("catalogue", synthesised, catalogued)]
    return [(name, "done" if done else "open" if ready else "locked") for name, ready, done in stages]


def competitors(evidence: DataFrame, papers: DataFrame, n: int = 5) -> DataFrame:
    """(candidate_id, nth, paper_id, why): the papers that a candidate (candidate_id, paper_id) rests on, then others of their categories, then must-cite and core ones; n at most.

    papers (paper_id, category array, must_cite, relevance).
    """
    given = evidence.join(papers, "paper_id").select("candidate_id", "paper_id", "category")
    shared = given.select("candidate_id", F.explode("category").alias("c")).distinct().join(papers.select("paper_id", F.explode("category").alias("c")), "c")
    leading = papers.where("must_cite or relevance = 'core'").orderBy(F.desc("must_cite"), "paper_id").limit(n * 2 + 64)  # more than any candidate can need: n, and as many as may be there already
    rest = evidence.select("candidate_id").distinct().crossJoin(F.broadcast(leading.select("paper_id", F.when(F.col("must_cite"), 2).otherwise(3).alias("rank"))))
    every = given.select("candidate_id", "paper_id", F.lit(0).alias("rank")).union(shared.select("candidate_id", "paper_id", F.lit(1))).union(rest)
    best = every.groupBy("candidate_id", "paper_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("candidate_id").orderBy("rank", "paper_id")
    why = F.element_at(F.array(F.lit("evidence"), F.lit("category"), F.lit("must cite"), F.lit("core")), F.col("rank") + 1)
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("candidate_id", "nth", "paper_id", why.alias("why"))


def cluster_context(papers: DataFrame, claims: DataFrame, paper: DataFrame) -> DataFrame:
    """(paper_id, kind, key, n): of given papers (paper_id), the siblings in their cluster, and the claim clusters that they have claims in."""
    asked = papers.join(paper.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "paper_cluster_id")
    near = asked.where("paper_cluster_id is not null").join(papers.select(F.col("paper_id").alias("other"), "paper_cluster_id"), "paper_cluster_id").where("other <> paper_id")
    siblings = near.select("paper_id", F.lit("sibling").alias("kind"), F.col("other").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    own = claims.join(asked.select("paper_id"), "paper_id", "left_semi").where("cluster_id is not null").groupBy("paper_id", "cluster_id").agg(F.count("*").alias("n"))
    return siblings.union(own.select("paper_id", F.lit("claim cluster"), F.col("cluster_id").cast("string"), "n"))


def markdown_matrix(cube: DataFrame) -> str:
    """A table of :func:`corpusloom.operators.reports.matrix`, whose axes are declared values and fit a page."""
    rows = cube.collect()
    cell = {(r["category"], r["method"]): r["n_papers"] for r in rows if r["level"] == 0}
    row, column = ({r[c]: r["n_papers"] for r in rows if r["level"] == k} for c, k in (("category", 1), ("method", 2)))
    grand = next((r["n_papers"] for r in rows if r["level"] == 3), 0)
    methods = sorted(column)
    lines = ["| | " + " | ".join(methods) + " | all |", "|-" * (len(methods) + 2) + "|"]
    lines += [f"| {c} | " + " | ".join(str(cell.get((c, m), "")) for m in methods) + f" | {row[c]} |" for c in sorted(row)]
    return "\n".join([*lines, "| all | " + " | ".join(str(column[m]) for m in methods) + f" | {grand} |"]) + "\n"


def markdown_list(rows: DataFrame, title: str, columns: list[str], limit: int = 1000) -> str:
    """A heading and a list of the first rows: candidates, indicators, a shortlist or a funnel."""
    lines = [f"## {title}", ""]
    lines += ["- " + ", ".join(f"{c}: {'' if r[c] is None else r[c]}" for c in columns) for r in rows.select(*columns).limit(limit).collect()]
    return "\n".join(lines) + "\n"
