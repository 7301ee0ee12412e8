"""Records of bibliographic services as candidate rows, and what follows from them: links to fetch, files to check, edges to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions import text as T

#: The row shape that all services are brought to.
CANDIDATE = ("title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "url", "pdf_url", "source_database", "source_query")
PLACE = "struct<pdf_url: string, landing_page_url: string, source: struct<display_name: string>>"
WORK = f"""id string, title string, doi string, publication_year int, abstract_inverted_index map<string, array<int>>,
    authorships array<struct<author: struct<display_name: string>>>, primary_location {PLACE}, best_oa_location {PLACE}, locations array<{PLACE}>,
    host_venue struct<display_name: string>, ids struct<arxiv: string>, external_ids struct<arxiv: string>, referenced_works array<string>"""
SCHOLAR = """title string, year int, venue string, abstract string, url string, authors array<struct<name: string>>,
    externalIds struct<DOI: string, ArXiv: string>, openAccessPdf struct<url: string>"""


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def restored_abstract(index: Column) -> Column:
    """The text of an inverted index {word: [positions]}; null or empty gives the empty string."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " "), F.lit(""))


def works_to_candidates(works: DataFrame, query: str) -> DataFrame:
    """Rows of WORK as candidates. A PDF's own address comes before a landing page, and the best place before the others."""
    c = F.col
    arxiv = F.regexp_replace(_first(c("ids.arxiv"), c("external_ids.arxiv")), "^https?://arxiv\\.org/abs/", "")
    doi = F.regexp_replace(F.coalesce(c("doi"), F.lit("")), "^https://doi\\.org/", "")
    listed = lambda f: F.filter(F.transform(c("locations"), lambda x: x[f]), lambda u: u.isNotNull() & (u != ""))
    place = lambda f: [c(f"best_oa_location.{f}"), c(f"primary_location.{f}"), F.get(listed(f), F.lit(0))]
    fallback = [F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)), F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))]
    names = F.filter(F.transform(c("authorships"), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    venue = _first(c("primary_location.source.display_name"), c("host_venue.display_name"), F.get(F.col("locations"), F.lit(0))["source"]["display_name"])
    return works.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("authors"), F.coalesce(c("publication_year").cast("string"), F.lit("")).alias("year"),
        venue.alias("venue"), restored_abstract(c("abstract_inverted_index")).alias("abstract"), doi.alias("doi"), arxiv.alias("arxiv_id"), F.coalesce("id", F.lit("")).alias("url"),
        _first(*place("pdf_url"), *place("landing_page_url"), *fallback).alias("pdf_url"), F.lit("openalex").alias("source_database"), F.lit(query).alias("source_query"),
    )


def scholar_to_candidates(items: DataFrame, query: str) -> DataFrame:
    """Rows of SCHOLAR as candidates."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return items.select(
        text("title").alias("title"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("authors"), text("year").alias("year"), text("venue").alias("venue"), text("abstract").alias("abstract"),
        text("externalIds.DOI").alias("doi"), text("externalIds.ArXiv").alias("arxiv_id"), text("url").alias("url"), text("openAccessPdf.url").alias("pdf_url"),
        F.lit("semantic_scholar").alias("source_database"), F.lit(query).alias("source_query"),
    )


def feed_to_candidates(feeds: DataFrame, query: str) -> DataFrame:
    """Entries of Atom feeds (xml) as candidates; a feed that does not parse gives none."""
    import pandas as pd

    def run(batches):
        import xml.etree.ElementTree as X

        name = lambda e: e.tag.rsplit("}", 1)[-1]
        for batch in batches:
            rows = []
            for xml in batch["xml"]:
                try:
                    root = X.fromstring(xml or "")
                except X.ParseError:
                    continue
                for entry in (e for e in root.iter() if name(e) == "entry"):
                    of = lambda k: " ".join(next((e.text or "" for e in entry if name(e) == k), "").split())  # noqa: B023, E731
                    people = [" ".join((n.text or "").split()) for a in entry if name(a) == "author" for n in a if name(n) == "name"]
                    number = of("id").rsplit("/", 1)[-1].split("v")[0]
                    rows.append((of("title"), ", ".join(people), of("published")[:4], "arXiv", of("summary"), "", number, of("id"), f"https://arxiv.org/pdf/{number}.pdf" if number else "", "arxiv", query))
            yield pd.DataFrame(rows, columns=list(CANDIDATE)).astype("string")

    return feeds.select("xml").mapInPandas(run, ", ".join(f"{c} string" for c in CANDIDATE))


def openalex_id(url: Column) -> Column:
    """W and digits, at the start or after the service's host; null without."""
    return F.nullif(F.regexp_extract(url, r"(?i)(?:openalex\.org/|^)(W\d+)", 1), F.lit(""))


def download_candidates(rows: DataFrame) -> DataFrame:
    """(paper_id, nth, url, source): addresses to try in order, from pdf_url, arxiv_id and open_access_url; blank ones give none."""
    told = lambda url, source: F.when(F.coalesce(F.trim(url), F.lit("")) != "", F.struct(url.alias("url"), F.lit(source).alias("source")))
    direct = F.when(F.trim("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.trim("arxiv_id"), F.lit(".pdf")))
    each = F.array_compact(F.array(told(F.col("pdf_url"), "primary pdf_url"), told(direct, "arxiv direct"), told(F.col("open_access_url"), "unpaywall")))
    return rows.select("paper_id", F.posexplode(each).alias("nth", "c")).select("paper_id", "nth", "c.url", "c.source")


# What a usable PDF file is.
PDF_MAGIC, PDF_MIN_BYTES, PDF_MAX_BYTES = "%PDF-", 100 * 1024, 50 * 1024 * 1024


def checked_files(files: DataFrame) -> DataFrame:
    """(path, length, ok, reason) of binary files (path, length, content): neither too small nor too large, and a PDF by its first bytes."""
    n = F.col("length")
    size = F.concat(F.when(n < PDF_MIN_BYTES, F.lit("too small (")).otherwise(F.lit("too large (")), n.cast("string"), F.lit(" bytes)"))
    magic = F.substring("content", 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC).cast("binary")
    reason = F.when((n < PDF_MIN_BYTES) | (n > PDF_MAX_BYTES), size).when(~magic, F.lit("not a PDF (wrong magic bytes)"))
    return files.select("path", n.alias("length"), reason.isNull().alias("ok"), reason.alias("reason"))


def snowball_edges(states: DataFrame) -> DataFrame:
    """(src, dst, source) from expansion states (json), of either shape: ``edges`` [{from, to, source}], or ``expansions`` {paper: {kind: [ids]}}.

    Rows without both ends are left out, repeats are one.
    """
    shape = "edges array<struct<`from`: string, `to`: string, source: string>>, expansions map<string, map<string, array<string>>>"
    s = states.select(F.from_json("json", shape).alias("s"))
    listed = s.select(F.explode("s.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.source", F.lit("snowball")).alias("source"))
    grown = s.select(F.explode("s.expansions").alias("paper", "kinds")).select("paper", F.explode("kinds").alias("kind", "ids")).select("paper", "kind", F.explode("ids").alias("id"))
    grown = grown.select(F.when(F.col("kind") == "cited_by", F.col("id")).otherwise(F.col("paper")).alias("src"), F.when(F.col("kind") == "cited_by", F.col("paper")).otherwise(F.col("id")).alias("dst"), F.lit("snowball").alias("source"))
    return listed.union(grown).where("src is not null and dst is not null and src <> '' and dst <> ''").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of more (src, dst, source) that edges does not have, each once; a null source equals a null source."""
    e, m = edges.select("src", "dst", "source").distinct().alias("e"), more.select("src", "dst", "source").distinct().alias("m")
    same = (F.col("e.src") == F.col("m.src")) & (F.col("e.dst") == F.col("m.dst")) & F.col("e.source").eqNullSafe(F.col("m.source"))
    return m.join(e, same, "left_anti")


class _Pages(DataSourceReader):
    """A partition for each stored answer of a service."""

    def __init__(self, options):
        self.paths = [p for p in options.get("answers", "").split(";") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            with open(partition.value, encoding="utf-8") as f:
                yield partition.value, f.read()


class StoredAnswers(DataSource):
    """``spark.read.format("service_answers").option("answers", "a;b")``: (page, body) of answers that were fetched before.

    Fetching is the caller's; the files must be where executors can open them.
    """

    @classmethod
    def name(cls) -> str:
        return "service_answers"

    def schema(self) -> str:
        return "page string, body string"

    def reader(self, schema):
        return _Pages(self.options)


def read_answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(StoredAnswers)
    return spark.read.format("service_answers").option("answers", ";".join(paths)).load()


def openalex_works(answers: DataFrame) -> DataFrame:
    """Rows of WORK from answers (body): {"results": [...]}."""
    return answers.select(F.from_json("body", f"struct<results: array<struct<{WORK}>>>").alias("a")).select(F.inline("a.results"))


def scholar_items(answers: DataFrame) -> DataFrame:
    """Rows of SCHOLAR from answers (body): {"data": [...]}."""
    return answers.select(F.from_json("body", f"struct<data: array<struct<{SCHOLAR}>>>").alias("a")).select(F.inline("a.data"))


def in_corpus(external: DataFrame, corpus: DataFrame) -> DataFrame:
    """external with ``known``: whether a corpus row has the same DOI, arXiv id, or first 80 characters of the normalised title."""
    start = lambda: F.substring(T.normalise_title(F.col("title")), 1, 80)
    keys = {"doi": T.normalise_doi(F.col("doi")), "arxiv": F.nullif(F.lower(F.trim("arxiv_id")), F.lit("")), "start": F.nullif(start(), F.lit(""))}
    out = external.withColumns({f"key_{k}": v for k, v in keys.items()}).withColumn("known", F.lit(False))
    for k, v in keys.items():
        have = corpus.select(v.alias(f"key_{k}")).where(f"key_{k} is not null").distinct().withColumn("hit", F.lit(True))
        out = out.join(have, f"key_{k}", "left").withColumn("known", F.col("known") | F.coalesce("hit", F.lit(False))).drop("hit")
    return out.select(*external.columns, "known")
