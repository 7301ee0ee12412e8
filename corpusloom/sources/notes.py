"""Reading notes: Markdown with front matter, their checks, defaults, aggregates and reference lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Body headings, in order, and the field each fills.
BODY = {
    "problem_statement": "Problem statement",
    "method_summary": "Method summary",
    "ground_truth_and_evaluation": "Ground truth and evaluation",
    "stated_limitations": "Stated limitations",
    "gaps_this_paper_opens": "Gaps this paper opens",
    "relevance_to_the_thesis_topic": "Relevance to the thesis topic",
}
# Enumerations of notes.
RELEVANCE = ("core", "adjacent", "peripheral")
NOVELTY = ("strong", "moderate", "incremental", "unclear")
FLAGS = ("self_constructed_ground_truth", "comparison_table_only", "hobby_project_scale", "predictable_outcome")
FIRST_YEAR, LAST_YEAR = 1990, 2030

NOTE = f"""paper_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, pdf_path string, read_date string, schema_version int,
    category array<string>, method_family string, relevance string, must_cite boolean, novelty string, contribution string, external_ground_truth boolean, baseline_compared boolean,
    uncertainty boolean, {", ".join(f"{f} boolean" for f in FLAGS)}, {", ".join(f"{k} string" for k in BODY)}, bad_provenance array<string>"""


def _scalar(text: str):
    """A YAML scalar: quoted text, a number, a truth value, nothing, a flow list, or text."""
    s = text.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1].replace('\\"', '"') if s[0] == '"' else s[1:-1].replace("''", "'")
    if s[:1] == "[" and s[-1:] == "]":
        return [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)""", s[1:-1])] if s[1:-1].strip() else []
    s = re.sub(r"\s+#.*$", "", s)
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?\d*\.\d+", s):
        return float(s)
    return {} if s == "{}" else s


def read_front_matter(text: str):
    """The mappings, lists and scalars of the YAML that front matter uses, by indentation; ValueError for anything else."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]

    def block(at: int, depth: int):
        if at >= len(lines) or lines[at][0] < depth:
            return None, at
        return (sequence if lines[at][1].startswith("- ") or lines[at][1] == "-" else mapping)(at, lines[at][0])

    def mapping(at: int, depth: int):
        out = {}
        while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
            m = re.fullmatch(r"""("[^"]*"|'[^']*'|[^:\s][^:]*?)\s*:(?:\s+(.*))?""", lines[at][1])
            if not m:
                raise ValueError(lines[at][1])
            key, rest = _scalar(m[1]), (m[2] or "").strip()
            if rest in ("", "|", ">"):
                if rest:
                    at, kept = at + 1, []
                    while at < len(lines) and lines[at][0] > depth:
                        kept.append(lines[at][1])
                        at += 1
                    out[key] = ("\n" if rest == "|" else " ").join(kept)
                    continue
                under_list = at + 1 < len(lines) and lines[at + 1][0] == depth and lines[at + 1][1].startswith("- ")
                out[key], at = block(at + 1, depth if under_list else depth + 1)
            else:
                out[key], at = _scalar(rest), at + 1
        return out, at

    def sequence(at: int, depth: int):
        out = []
        while at < len(lines) and lines[at][0] == depth and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:].strip()
            if re.match(r"""[^"'\[{][^:]*:(\s|$)""", rest):
                lines[at] = (depth + 2, rest)
                value, at = mapping(at, depth + 2)
            else:
                value, at = (_scalar(rest), at + 1) if rest else block(at + 1, depth + 1)
            out.append(value)
        return out, at

    value, at = block(0, 0)
    if at != len(lines):
        raise ValueError(lines[at][1])
    return value or {}


def parse_note(markdown: str | None) -> dict:
    """A row of NOTE; without front matter, or with a bad one, its fields are empty."""
    out = {k: None for k in ("paper_id", "title", "year", "venue", "doi", "arxiv_id", "url", "pdf_path", "read_date", "method_family", "relevance", "novelty", "contribution")}
    out |= {"authors": [], "category": [], "bad_provenance": [], "schema_version": 2, "must_cite": False, "external_ground_truth": False, "baseline_compared": False, "uncertainty": False}
    out |= {k: False for k in FLAGS} | {k: "" for k in BODY}
    m = re.match(r"---\n(.*?)\n---\n(.*)\Z", markdown or "", re.S)
    if not m:
        return out
    try:
        fm = read_front_matter(m[1])
        fm = fm if isinstance(fm, dict) else {}
    except ValueError:
        fm = {}
    under = lambda k: fm.get(k) if isinstance(fm.get(k), dict) else {}
    text = lambda v: None if v is None or isinstance(v, (dict, list)) else str(v)
    if fm:
        out |= {k: text(fm.get(k)) for k in ("paper_id", "title", "venue", "doi", "arxiv_id", "url", "pdf_path", "read_date")}
        people = fm.get("authors")
        out["authors"] = [a.strip() for a in people.split(",") if a.strip()] if isinstance(people, str) else [str(a) for a in people or []]
        out["category"] = [str(c) for c in fm["category"]] if isinstance(fm.get("category"), list) else []
        out["year"] = fm["year"] if isinstance(fm.get("year"), int) else None
        version = fm.get("schema_version")
        out["schema_version"] = version if isinstance(version, int) else 2 if fm.get("extracted") else 1
        out["method_family"], out["relevance"] = text(under("method").get("family")), text(under("relevance").get("relevance_to_topic"))
        out["novelty"], out["contribution"] = text(under("claims").get("novelty_strength")), text(under("claims").get("primary_contribution"))
        out["must_cite"] = under("relevance").get("must_cite") is True
        out["external_ground_truth"] = under("ground_truth").get("external") is True
        out["baseline_compared"], out["uncertainty"] = under("evaluation").get("baseline_compared") is True, under("evaluation").get("has_uncertainty_quantification") is True
        out |= {k: under("quality_flags").get(k) is True for k in FLAGS}
        out["bad_provenance"] = unsupported(under("extracted"))
    for key, heading in BODY.items():
        found = re.search(rf"^##\s+{heading}\s*\n(.*?)(?=\n##\s|\Z)", m[2], re.S | re.M)
        out[key] = found[1].strip() if found else ""
    return out


def unsupported(extracted: dict) -> list[str]:
    """Paths below ``extracted`` that hold a value without a mechanism in its provenance."""
    told = lambda v: isinstance(v, dict) and isinstance(v.get("provenance"), dict) and bool(v["provenance"].get("mechanism"))
    nested = ("population", "quoted_spans")
    groups = [("", {k: v for k, v in extracted.items() if k not in nested})] + [(f"{g}.", extracted[g]) for g in nested if isinstance(extracted.get(g), dict)]
    out = []
    for prefix, group in groups:
        for key, value in group.items():
            if isinstance(value, list):
                out += [f"{prefix}{key}[{i}]" for i, v in enumerate(value) if not told(v)]
            elif value is not None and not told(value):
                out.append(f"{prefix}{key}")
    return sorted(out)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, NOTE…) of the Markdown files below path, a row each."""
    return parse_notes(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown")))


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, NOTE…) of rows (path, markdown)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame([{"path": p} | parse_note(m) for p, m in zip(b["path"], b["markdown"])], columns=["path", *_note_columns()])

    return files.select("path", "markdown").mapInPandas(run, f"path string, {NOTE}")


def _note_columns() -> list[str]:
    return [c.split()[0] for c in re.sub(r"<[^>]*>", "", NOTE).replace("\n", " ").split(",")]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def with_errors(notes: DataFrame) -> DataFrame:
    """notes with ``errors``: what keeps each from being valid, in a fixed order."""
    bad = lambda when, message: F.when(when, F.lit(message) if isinstance(message, str) else message)
    checks = [bad(_blank(k), f"empty: {k}") for k in ("paper_id", "title", "pdf_path", "read_date")]
    checks.append(bad(_blank("doi") & _blank("arxiv_id") & _blank("url"), "empty: doi, arxiv_id, or url required"))
    checks.append(bad(F.coalesce(F.size("authors"), F.lit(0)) <= 0, "empty: authors"))
    checks.append(bad(~F.coalesce(F.col("year").between(FIRST_YEAR, LAST_YEAR), F.lit(False)), F.concat(F.lit("year out of range: "), F.coalesce(F.col("year").cast("string"), F.lit("none")))))
    checks.append(bad(F.coalesce(F.size("category"), F.lit(0)) <= 0, "empty: category"))
    checks.append(bad(_blank("method_family"), "empty: method.family"))
    checks.append(bad(_blank("relevance"), "empty: relevance.relevance_to_topic"))
    checks.append(bad(~F.coalesce(F.col("relevance").isin(*RELEVANCE), F.lit(False)), "relevance.relevance_to_topic must be " + "/".join(RELEVANCE)))
    lacking = F.transform(F.coalesce("bad_provenance", F.array().cast("array<string>")), lambda p: F.concat(F.lit("extracted."), p, F.lit(": missing provenance")))
    return notes.withColumn("errors", F.concat(F.array_compact(F.array(*checks)), lacking))


def derived_novelty() -> Column:
    """Strong: external truth, a baseline and uncertainty; moderate without the last; incremental if the truth is the authors' own; else unclear."""
    c = lambda x: F.coalesce(F.col(x), F.lit(False))
    external, base = c("external_ground_truth"), c("baseline_compared")
    return F.when(external & base & c("uncertainty"), "strong").when(external & base, "moderate").when(c("self_constructed_ground_truth"), "incremental").otherwise("unclear")


def with_defaults(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """notes with blanks filled from the corpus rows (paper_id, authors, year, venue, doi, arxiv_id, url, source_database), and a novelty where none is valid."""
    r = rows.select("paper_id", *[F.col(c).alias(f"row_{c}") for c in ("authors", "year", "venue", "doi", "arxiv_id", "url", "source_database")])
    out = notes.join(r, "paper_id", "left")
    fill = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.nullif(F.trim(F.col(f"row_{c}")), F.lit("")))
    people = F.filter(F.transform(F.split("row_authors", ","), lambda a: F.trim(a)), lambda a: a != "")
    out = out.withColumns({c: fill(c) for c in ("venue", "doi", "arxiv_id", "url")})
    out = out.withColumn("authors", F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, F.col("authors")).otherwise(F.coalesce(people, F.array().cast("array<string>"))))
    out = out.withColumn("year", F.when(F.col("year") > 0, F.col("year")).otherwise(F.col("row_year").try_cast("int")))
    preprint = F.col("arxiv_id").isNotNull() | F.lower(F.coalesce("row_source_database", F.lit(""))).contains("arxiv")
    out = out.withColumn("venue", F.coalesce("venue", F.when(preprint, "arXiv")))
    out = out.withColumn("novelty", F.when(F.lower("novelty").isin(*NOVELTY), F.col("novelty")).otherwise(derived_novelty()))
    return out.select(*notes.columns)


def eligible_notes(rows: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """(paper_id, triage_label, note_status) of labelled rows with a file (paper_id): none, draft or valid."""
    checked = with_errors(notes).select("paper_id", F.when(F.size("errors") == 0, "valid").otherwise("draft").alias("status"))
    keep = rows.where(F.col("triage_label").isin("include", "maybe")).join(files.select("paper_id").distinct(), "paper_id", "left_semi")
    return keep.join(checked, "paper_id", "left").select("paper_id", "triage_label", F.coalesce("status", F.lit("none")).alias("note_status"))


def aggregate(notes: DataFrame) -> DataFrame:
    """(kind, key, n) over notes: papers by category, method, cell of both, flag, relevance and novelty, and totals."""
    n = notes.where(~_blank("paper_id")).select(
        "paper_id", F.when(F.size("category") > 0, F.col("category")).otherwise(F.array(F.lit("other"))).alias("category"), F.coalesce(F.nullif("method_family", F.lit("")), F.lit("other")).alias("method"),
        F.coalesce("relevance", F.lit("unknown")).alias("relevance"), F.coalesce("novelty", F.lit("unknown")).alias("novelty"), "must_cite", "external_ground_truth", *FLAGS,
    )
    told = F.array_compact(F.array(*[F.when(F.col(f), F.struct(F.lit("flag").alias("kind"), F.lit(f).alias("key"))) for f in FLAGS]))
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    cells = F.flatten(F.transform(F.array_distinct("category"), lambda c: F.array(one("category", c), one("cell", F.concat(c, F.lit("|"), F.col("method"))))))
    totals = F.array_compact(F.array(one("total", F.lit("papers")), F.when(F.col("must_cite"), one("total", F.lit("must_cite"))), F.when(F.col("external_ground_truth"), one("total", F.lit("external_ground_truth")))))
    each = F.concat(cells, F.array(one("method", F.col("method")), one("relevance", F.col("relevance")), one("novelty", F.col("novelty"))), told, totals)
    return n.select(F.explode(each).alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def summaries(notes: DataFrame) -> DataFrame:
    """(id, flags, contrib, gaps): what a language model is shown of each note; the flags that are set, texts cut to 200 and 600 characters."""
    told = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS]))
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return notes.select(F.col("paper_id").alias("id"), told.alias("flags"), cut("contribution", 200).alias("contrib"), cut("gaps_this_paper_opens", 600).alias("gaps"))


def reference_list(papers: DataFrame) -> DataFrame:
    """(id, line): a Markdown line for each paper (id, authors array, title, venue, year, doi, arxiv_id, url), to be ordered by id."""
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(""))
    doi, arxiv, url = (some(F.col(c)) for c in ("doi", "arxiv_id", "url"))
    link = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise(url)
    title = F.concat(F.lit("*"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")), F.lit("*."))
    people = F.coalesce(F.nullif(F.array_join("authors", ", "), F.lit("")), F.lit("(unknown authors)"))
    year = F.when(F.col("year") > 0, F.col("year").cast("string")).otherwise("n.d.")
    parts = F.array(F.concat(F.lit("[paper_"), F.col("id").cast("string"), F.lit("]")), people, title, some(F.col("venue")), year, F.when(link != "", F.concat(F.lit("<"), link, F.lit(">"))).otherwise(""))
    return papers.select("id", F.concat(F.lit("- "), F.array_join(F.filter(parts, lambda p: p != ""), " ")).alias("line"))


def bundle(notes: DataFrame, candidates: DataFrame) -> dict:
    """What a catalogue is written from: aggregates as {kind: {key: n}}, summaries, and the accepted or refined candidates (title, overall). Small by nature: notes are read by people."""
    counts: dict[str, dict[str, int]] = {}
    for r in aggregate(notes).orderBy("kind", "key").collect():
        counts.setdefault(r["kind"], {})[r["key"]] = r["n"]
    papers = [r.asDict() for r in summaries(notes).orderBy("id").collect()]
    return {"counts": counts, "papers": papers, "candidates": [r.asDict() for r in candidates.where(F.col("overall").isin("accept", "refine")).orderBy("title").collect()]}
