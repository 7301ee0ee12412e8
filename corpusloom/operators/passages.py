"""What stands where in a paper: section types and trees, sentences around a place, citations, spans, reported results, and the chunks a question may read."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T

_NUMBERED = r"^(?:\d+(?:_\d+)*_)?"
# Section labels of heading slugs; the first label with a matching pattern counts.
SLUG_RULES = {
    "abstract": [r"^abstract$", r"^\d+(?:_\d+)*_abstract$"],
    "introduction": [_NUMBERED + r"(?:introduction|intro)$", _NUMBERED + r"motivation$"],
    "related_work": [r"related[_ ]?work", r"prior[_ ]?work", r"literature[_ ]?review", _NUMBERED + r"(?:related|state[_ ]?of[_ ]?the[_ ]?art|sota)"],
    "background": [_NUMBERED + "background", r"preliminaries?", _NUMBERED + "fundamentals?"],
    "methods": [_NUMBERED + r"(?:methods?|methodology|approach|system|design|architecture|model|algorithm|framework|technique|proposed)(?:_|$)", _NUMBERED + "our_"],
    "experimental_setup": [
        _NUMBERED + r"(?:experimental[_ ]?setup|experiment[s]?|setup|implementation|evaluation[_ ]?setup|materials)",
        _NUMBERED + "datasets?$",
        _NUMBERED + r"data(?:_collection)?$",
        _NUMBERED + "participants?",
    ],
    "results": [_NUMBERED + r"(?:results?|findings|empirical[_ ]?results?|performance|outcomes?)$", _NUMBERED + "analysis$", _NUMBERED + "evaluation$"],
    "discussion": [_NUMBERED + "discussion", "implications", "interpretation"],
    "limitations": [r"limitations?$", r"threats?[_ ]?to[_ ]?validity", r"^caveats?$"],
    "conclusion": [_NUMBERED + r"(?:conclusion|conclusions|concluding[_ ]?remarks|summary|closing)"],
    "future_work": [r"future[_ ]?work", r"open[_ ]?(?:problems?|questions?|directions?)", r"next[_ ]?steps?"],
    "references": [r"^references?$", r"^bibliography"],
    "appendix": [r"^appendi(?:x|ces)", _NUMBERED + "appendix", "supplementary"],
}
# Section types of headings as they stand, without numbering; the first type with a matching pattern counts.
HEADING_RULES = {
    "abstract": [r"^abstract$", r"^summary$"],
    "related_work": [r"related\s*work", r"prior\s*work", r"literature\s*review", r"state\s*of\s*the\s*art", r"background\s+and\s+related", r"previous\s*work"],
    "background": [r"^background$", r"preliminaries?", r"^fundamentals?$", r"threat\s*model"],
    "introduction": [r"^introduction$", r"^intro$", r"^motivation$", r"^overview$", r"^background$"],
    "experimental_setup": [
        r"experimental?\s*setup", r"experimental?\s*design", r"^experiments?$", r"^evaluation\s*setup", r"^datasets?$", r"^data(?:\s*collection)?$",
        r"^materials?(?:\s*and\s*methods?)?$", r"participants?", r"^implementation$", r"^setup$", r"protocol",
    ],
    "methods": [r"^methods?$", r"methodology", r"^approach$", r"^proposed\s+method", r"^system\s+design", r"^architecture", r"^model$", r"^algorithm", r"^framework$", r"^technique", r"^our\s+"],
    "results": [r"^results?\b", r"^findings\b", r"^empirical\s*results", r"^performance\b", r"^outcomes?\b", r"^analysis\b", r"^empirical\s*analysis", r"^evaluation\b"],
    "discussion": [r"^discussions?\b", r"^interpretation", r"^implications?\b"],
    "limitations": [r"^limitations?$", r"threats?\s*to\s*validity", r"^caveats?$", r"^weakness"],
    "future_work": [r"future\s*work", r"open\s*(?:problems?|questions?|directions?|challenges)", r"next\s*steps", r"^outlook$"],
    "conclusion": [r"^conclusions?$", r"^concluding\s*remarks", r"^closing", r"^final\s*remarks"],
    "references": [r"^references?$", r"^bibliography", r"^works\s*cited", r"^literature\s*cited", r"^citations?$"],
    "acknowledgments": [r"^acknowledg(?:e)?ments?$", r"^thanks?$"],
    "appendix": [r"^appendi(?:x|ces)", r"supplementary", r"^supplement"],
}


def by_rules(text: Column, rules: dict[str, list[str]]) -> Column:
    """The first label with a pattern that is found in the text; null if none."""
    out = F
    for label, patterns in rules.items():
        out = out.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), label)
    return out


def section_of_slug(slug: Column) -> Column:
    return by_rules(F.lower(slug), SLUG_RULES)


def section_of_heading(heading: Column) -> Column:
    """The type of a heading as it stands; ``other`` where no rule fits."""
    bare = F.coalesce(heading, F.lit(""))
    for numbering in (r"^\s*\d+(?:\.\d+){0,4}\s*[.:\-]?\s*", r"(?i)^\s*[IVX]{1,5}\.\s*", r"^\s*[A-Z]\.\s*"):
        bare = F.regexp_replace(bare, numbering, "")
    return F.coalesce(by_rules(F.lower(F.trim(bare)), HEADING_RULES), F.lit("other"))


def section_tree(sections: DataFrame) -> DataFrame:
    """(doc_id, section_idx, level, parent_idx, section_type) of rows (doc_id, section_idx, level, heading).

    The parent is the nearest section before of a smaller level. A section whose heading tells nothing has its parent's type.
    """
    typed = sections.select("doc_id", "section_idx", F.coalesce("level", F.lit(1)).cast("int").alias("level"), section_of_heading(F.col("heading")).alias("own"))
    listed = typed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("section_idx").cast("int").alias("idx"), "level", "own"))).alias("s"))  # one document's sections
    tree = F.expr(
        """aggregate(s, named_struct('open', cast(array() as array<struct<idx:int,level:int,kind:string>>), 'out', cast(array() as array<struct<idx:int,level:int,parent:int,kind:string>>)), (acc, x) ->
            aggregate(array(filter(acc.open, o -> o.level < x.level)), acc, (a, above) ->
                aggregate(array(if(x.own = 'other', coalesce(try_element_at(above, -1).kind, 'other'), x.own)), a, (b, kind) ->
                    named_struct('open', concat(above, array(named_struct('idx', x.idx, 'level', x.level, 'kind', kind))),
                        'out', concat(b.out, array(named_struct('idx', x.idx, 'level', x.level, 'parent', try_element_at(above, -1).idx, 'kind', kind)))))), acc -> acc.out)"""
    )
    return listed.select("doc_id", F.explode(tree).alias("t")).select("doc_id", F.col("t.idx").alias("section_idx"), "t.level", F.col("t.parent").alias("parent_idx"), F.col("t.kind").alias("section_type"))


# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "et al|e.g|i.e|cf|etc|vs|fig|eq|no|vol|dr|mr|mrs|ms|prof|jr|sr|ref|sec|al|pp|p|inc|ltd|co".split("|")
_ABBREVIATED = "|".join(re.escape(a) for a in ABBREVIATIONS)
#: White space between two sentences: after a closing mark that belongs to no abbreviation, before anything but a small letter.
SENTENCE_GAP = rf"(?<=[.!?])(?<!(?i:(?:^|[^a-z])(?:{_ABBREVIATED}))[.!?])\s++(?![a-z])"


def sentence_at(text: Column, offset: Column) -> Column:
    """The sentence that holds the character at offset (from 0), trimmed; null outside the text."""
    parts = F.split(F.regexp_replace(text, SENTENCE_GAP, "$0\u0001"), "\u0001")
    start = F.struct(F.lit(0).alias("upto"), F.lit(None).cast("string").alias("s"))
    found = F.aggregate(parts, start, lambda a, p: F.struct((a["upto"] + F.length(p)).alias("upto"), F.coalesce(a["s"], F.when(a["upto"] + F.length(p) > offset, p)).alias("s")), lambda a: a["s"])
    return F.when((offset >= 0) & (offset < F.length(text)), F.regexp_replace(found, r"^\s+|\s+$", ""))


def clipped_context(text: Column, start: Column, end: Column, padding: int = 60) -> Column:
    """The text around [start, end), from 0: at most padding characters on each side, from after the last '. ' before, to the first sentence end after."""
    lo = F.greatest(start - padding, F.lit(0))
    before = F.substring(text, lo + 1, start - lo)
    head = F.regexp_replace(before, r"(?s)^.*\. ", "")
    after = F.substring(text, end + 1, padding)
    tail = F.regexp_extract(after, r"(?s)^(.*?[.!?])(?=\s+[A-Z(])", 1)
    return F.trim(F.concat(head, F.substring(text, start + 1, end - start), F.when(tail != "", tail).otherwise(after)))


def citation_markers(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, marker_idx, surface, target, context) of paragraphs (paragraph_id, text, marks array<struct<surface, target>>).

    Marks are looked for one after the other, each from where the one before ended; the context is the sentence at its middle. A
    mark that is not found has no context, and the next is looked for from the same place.
    """
    placed = F.expr(
        """aggregate(marks, named_struct('from', 1, 'out', cast(array() as array<int>)), (a, m) -> aggregate(array(if(length(m.surface) > 0, locate(m.surface, text, a.from), 0)), a, (b, at) ->
            named_struct('from', if(at > 0, at + length(m.surface), b.from), 'out', concat(b.out, array(at)))), a -> a.out)"""
    )
    each = paragraphs.select("paragraph_id", "text", F.posexplode(F.arrays_zip(F.col("marks"), placed.alias("place"))).alias("marker_idx", "x"))
    m = each.select("paragraph_id", "text", "marker_idx", F.col("x.marks.surface").alias("surface"), F.col("x.marks.target").alias("target"), F.col("x.place").alias("at"))
    middle = F.col("at") - 1 + F.floor(F.length("surface") / 2).cast("int")
    return m.select("paragraph_id", "marker_idx", "surface", "target", F.when(F.col("at") > 0, sentence_at(F.col("text"), middle)).alias("context"))


def surname(author: Column) -> Column:
    """What is before a comma, or else the last word; null if blank."""
    name = F.trim(author)
    return F.nullif(F.when(name.contains(","), F.trim(F.split(name, ",")[0])).otherwise(F.element_at(F.split(name, r"\s+"), -1)), F.lit(""))


def citation_anchors(authors: Column, year: Column) -> Column:
    """How a text names a paper: its first two authors' surnames of three letters and more with the year, longest first."""
    names = F.filter(F.transform(F.slice(authors, 1, 2), surname), lambda s: s.isNotNull() & (F.length(s) >= 3))
    y = year.cast("string")
    forms = lambda s: F.array_compact(F.array(*[F.concat(s, F.lit(a), y, F.lit(b)) for a, b in ((" et al., ", ""), (" et al. (", ")"), (" (", ")"), (", ", ""), (" et al ", ""))], F.concat(s, F.lit(" et al."))))
    every = F.array_distinct(F.flatten(F.transform(names, forms)))
    return F.transform(F.array_sort(F.transform(every, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])


def citation_contexts(links: DataFrame, chunks: DataFrame, window: int = 240) -> DataFrame:
    """(src, dst, anchor, chunk_idx, context): where a paper first names one that it cites.

    links (src, dst, anchors), anchors in order of preference; chunks (paper_id, chunk_idx, page, section, text). The first anchor
    that any chunk holds counts, at its first chunk. The window runs on into neighbouring chunks of the same page, references excluded.
    """
    body = chunks.withColumn("open", F.coalesce(F.col("section") != "references", F.lit(True)))
    order = Window.partitionBy("paper_id").orderBy("chunk_idx")
    turn = (~F.col("open")) | F.coalesce(~F.lag("open").over(order), F.lit(False)) | F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(False))
    runs = body.withColumn("run", F.sum(turn.cast("int")).over(order)).where("open")
    each = links.select("src", "dst", F.posexplode("anchors").alias("nth", "anchor"))
    hits = each.join(runs.select(F.col("paper_id").alias("src"), "chunk_idx", "run", "text"), "src").withColumn("at", F.expr("locate(lower(anchor), lower(text))")).where("at > 0")
    first = hits.groupBy("src", "dst").agg(F.min(F.struct("nth", "chunk_idx", "run", "at", "anchor", "text")).alias("h")).select("src", "dst", "h.*")
    listed = runs.groupBy(F.col("paper_id").alias("src"), "run").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_idx").alias("i"), F.col("text").alias("t")))).alias("near"))  # chunks of a page
    left = F.expr(f"aggregate(reverse(filter(near, x -> x.i < chunk_idx)), named_struct('need', {window} - at + 1, 's', ''), (a, x) -> if(a.need <= 0, a, named_struct('need', a.need - least(a.need, length(x.t)), 's', concat(right(x.t, a.need), ' ', a.s))), a -> a.s)")
    right = F.expr(f"aggregate(filter(near, x -> x.i > chunk_idx), named_struct('need', {window} - (length(text) - at + 1 - length(anchor)), 's', ''), (a, x) -> if(a.need <= 0, a, named_struct('need', a.need - least(a.need, length(x.t)), 's', concat(a.s, ' ', left(x.t, a.need)))), a -> a.s)")
    own = F.expr(f"substring(text, greatest(1, at - {window}), at - greatest(1, at - {window}) + length(anchor) + {window})")
    return first.join(listed, ["src", "run"]).select("src", "dst", "anchor", "chunk_idx", F.trim(F.concat(left, own, right)).alias("context"))


def numbered_references(docs: DataFrame) -> DataFrame:
    """(doc_id, n, text) of reference lists (doc_id, text): ``[n] …`` entries, or where there are none, lines ``n. …``; the first of a number counts."""
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("t"))
    bracket, lines = pairs(r"(?s)\[(\d{1,3})\]\s+([^\[]{15,500}?)(?=\s*\[\d{1,3}\]|$)"), pairs(r"(?:^|\n)\s*(\d{1,3})[.)]\s+([^\n]{15,500}(?:\n(?!\s*\d{1,3}[.)])[^\n]+)*)")
    each = docs.select("doc_id", F.posexplode(F.when(F.size(bracket) > 0, bracket).otherwise(lines)).alias("i", "x"))
    rows = each.select("doc_id", "i", F.col("x.n").cast("int").alias("n"), F.trim(F.regexp_replace("x.t", r"\s+", " ")).alias("text")).where("n >= 1")
    return rows.groupBy("doc_id", "n").agg(F.min_by("text", "i").alias("text"))


def sections_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): what follows a references heading, to the end; documents without one are left out."""
    heading = r"(?is)(?:^|\n)[ \t]*(?:[§*•·]\s+)?(?:\d+[.)\s]+)?(?:references|bibliography|works\s+cited|literature\s+cited)[.: ]*[ \t]*\n(.*)$"
    return docs.select("doc_id", F.regexp_extract("text", heading, 1).alias("text")).where("text <> ''")


# Ways a chunk looks like a title page.
FRONT_MATTER = r"(?i)\bpage\s+\d+\s*/\s*\d+\b|\bcorresponding\s+author\b|\bemail:\s*[^\s@]+@[^\s@]+"


def is_front_matter(idx: Column, text: Column) -> Column:
    """The first chunk, if it is empty, has a hint of a title page, or starts with over 12 capitals and no sentence end in 200 characters."""
    start, head = F.substring(F.coalesce(text, F.lit("")), 1, 1200), F.substring(F.coalesce(text, F.lit("")), 1, 200)
    capitals = ~head.rlike(r"[.!?]\s+[A-Z]") & (F.regexp_count(head, F.lit("[A-Z]")) > 12)
    return F.coalesce((idx == 0) & ((start == "") | start.rlike(FRONT_MATTER) | capitals), F.lit(False))


def routed_chunks(chunks: DataFrame, labels: list[str]) -> DataFrame:
    """chunks (paper_id, chunk_idx, label, text) that a question about sections ``labels`` may read, with tier and reading order ``nth``.

    A paper's chunks of those sections; where it has none, those labelled other; where it has none either, all but references. A title page is read last.
    """
    label = F.coalesce("label", F.lit("other"))
    tier = F.when(label.isin(*labels), 0).when(F.col("label") == "other", 1).when(~label.isin("references", "bibliography"), 2)
    rated = chunks.withColumn("tier", tier).where("tier is not null")
    best = rated.withColumn("best", F.min("tier").over(Window.partitionBy("paper_id"))).where((F.col("tier") <= F.col("best")) | (F.col("best") == 2))
    n = F.count("*").over(Window.partitionBy("paper_id"))
    last = F.when(n > 1, is_front_matter(F.col("chunk_idx"), F.col("text"))).otherwise(F.lit(False))
    order = Window.partitionBy("paper_id").orderBy("last", "chunk_idx")
    name = F.element_at(F.array(F.lit("sections"), F.lit("sections+other"), F.lit("whole_paper")), F.col("best") + 1)
    return best.withColumn("last", last).withColumn("nth", F.row_number().over(order)).withColumn("tier", name).select(*chunks.columns, "tier", "nth")


def budgeted_text(routed: DataFrame, characters: int = 1500, most_chunks: int = 4) -> DataFrame:
    """(paper_id, text, chunks): the routed chunks in order, until the budget of characters or of chunks is used up; the last is cut; blank ones do not count."""
    told = routed.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy("paper_id").orderBy("nth")
    used = told.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).withColumn("k", F.row_number().over(order))
    kept = used.where((F.col("before") < characters) & (F.col("k") <= most_chunks)).withColumn("part", F.expr(f"substring(text, 1, cast({characters} - before as int))"))
    joined = kept.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"), F.array_sort(F.collect_list("chunk_idx")).alias("chunks"))
    return joined.select("paper_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"), "chunks")


_NAME = r"[A-Z][A-Za-z0-9-+.]{1,30}"
# Families of named things in a text, and words that start none.
SPAN_FAMILIES = {
    "capitalised": r"(?<![A-Za-z])([A-Z][A-Za-z0-9]*(?:[\s-][A-Z][A-Za-z0-9]+){1,5})(?![A-Za-z])",
    "capitalised_particle": r"(?<![A-Za-z])([A-Z][A-Za-z]+(?:\s+(?:of|de|del|della?|du|von|van|der|al-|el-|le|la|den|den|y|e)\s+[A-Z][A-Za-z]+){1,3})(?![A-Za-z])",
    "camelcase": r"(?<![A-Za-z])([A-Z][a-z]{1,}[A-Z][A-Za-z0-9]*|[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)(?![A-Za-z])",
    "acronym": r"(?<![A-Za-z])([A-Z]{2,10}(?:[-+][A-Za-z0-9]+)?)(?![A-Za-z])",
    "hyphenated": r"(?<![A-Za-z])([A-Za-z][A-Za-z0-9]*(?:[-+][A-Za-z0-9.]+){1,3})(?![A-Za-z])",
    "versioned": r"(?<![A-Za-z])([A-Z][A-Za-z]{1,15}[-_]?(?:[0-9]+(?:\.[0-9]+)?|[IVX]{1,4}|base|large|small|tiny|xl|xxl)\b)",
    "pattern:library": rf"\b(?:the\s+)?({_NAME}(?:\s+{_NAME}){{0,3}})\s+(?:library|toolkit|package|framework)\b",
    "pattern:dataset": rf"\b(?:the\s+)?({_NAME}(?:\s+{_NAME}){{0,3}})\s+(?:dataset|corpus|benchmark|test\s?set|collection)\b",
    "pattern:attack": rf"\b(?:[Tt]he\s+)?({_NAME}(?:[\s-]{_NAME}){{0,2}})\s+(?:[Aa]ttack|[Ee]xploit|[Ss]ide[- ][Cc]hannel|[Cc]overt\s+[Cc]hannel|[Ff]ault\s+[Ii]njection)\b",
    "pattern:model": rf"\b(?:the\s+)?({_NAME}(?:\s+{_NAME}){{0,3}})\s+(?:model|encoder|decoder|transformer|classifier)\b",
    "pattern:called": rf"""\b(?:called|named|known\s+as|termed)\s+["']?({_NAME}(?:\s+{_NAME}){{0,3}})["']?""",
    "pattern:paren_abbr": r"\b([A-Z][A-Za-z0-9-+.\s]{3,60})\s*\(([A-Z]{2,10})\)",
}
NO_ACRONYMS = frozenset(
    """THE AND FOR BUT NOT ALL ANY SOME THIS THAT THESE THOSE WE OUR THEIR ITS HIS HER HIM SHE HE IT IS ARE WAS WERE BE BEEN BEING HAS HAVE HAD DO DOES DID DONE
    WILL WOULD SHALL SHOULD CAN COULD MAY MIGHT MUST IN ON AT TO OF BY UP DOWN OUT OFF A AN AS IF OR SO NO YES I II III IV V VI VII VIII IX X
    FIG FIG. TBL TABLE EQ EQS SEC SECT REF REFS APP APPX ETC EG IE VS VIZ CF PER""".split()
)
NO_HEADS = frozenset(
    """we our this these those the their its an a from to in on section sect chapter figure fig table tbl example for also however
    furthermore moreover meanwhile therefore hence thus indeed additionally first second third fourth last recent previous prior related""".split()
)
DETERMINERS = frozenset("the a an this these those our we".split())
EDGE = " \t\n\r\f\v,.;:!?(){}[]\"'`"
SHORTEST_SPAN, LONGEST_SPAN = 2, 80
_COMPILED = {k: re.compile(v) for k, v in SPAN_FAMILIES.items()}


def spans_of(text: str) -> list[tuple[str, int, int, list[str]]]:
    """(span, start, end, families) of a text, by start: stripped of marks and determiners, one for each text and start."""
    found: dict[tuple[str, int], list] = {}

    def add(raw: str, start: int, family: str) -> None:
        if not SHORTEST_SPAN <= len(raw) <= LONGEST_SPAN:
            return
        span = raw.lstrip(EDGE)
        start += len(raw) - len(span)
        span = span.rstrip(EDGE)
        end = start + len(span)
        while len(span) >= SHORTEST_SPAN and (head := span.partition(" "))[1] and head[0].lower() in DETERMINERS:
            start, span = start + len(head[0]) + 1, head[2]
        if len(span) < SHORTEST_SPAN or (family == "acronym" and span.upper() in NO_ACRONYMS) or (family == "capitalised" and re.split(r"[\s-]", span)[0].lower() in NO_HEADS):
            return
        row = found.setdefault((span.lower(), start), [span, start, end, []])
        if family not in row[3]:
            row[3].append(family)

    for family, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            add(m[1], m.start(), family) if family.startswith("pattern") else add(m[1], m.start(1), family)
            if family == "pattern:paren_abbr":
                add(m[2], text.index(m[2], m.start()), "acronym")
    return sorted((tuple(v) for v in found.values()), key=lambda r: (r[1], r[0]))


def proposed_spans(chunks: DataFrame) -> DataFrame:
    """(chunk_id, span, start, stop, families) of chunks (chunk_id, text). Offsets are of characters, from 0; after an anchor pattern, of the whole match."""

    def run(batches):
        for b in batches:
            rows = [(c, *s) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s in spans_of(t)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["chunk_id", "span", "start", "stop", "families"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {kind}, span string, start int, stop int, families array<string>")


# Words that join a metric to its value.
JOINING = "score|value|metric|of|=|:|is|reaches|achieves|achieving|hits|reached|reaching|attains|equal[ing]*|approximately|about"


def mined_results(sentences: DataFrame, metrics: dict[str, list[str]], datasets: DataFrame, most: float = 1000.0) -> DataFrame:
    """(paper_id, sentence_idx, nth, metric, value, dataset, split) of sentences (paper_id, sentence_idx, sentence).

    metrics: each canonical name's other forms, a vocabulary given by hand. A form followed by a number, joined by at most one word, is a result; of forms that
    start alike the longest counts. The dataset is the first of the paper's (paper_id, ord, canonical, raw) that the sentence holds.
    """
    of_form = {f.lower(): canonical for canonical, forms in reversed(metrics.items()) for f in [canonical, *forms]}
    forms = "|".join(re.escape(f) for f in sorted(of_form, key=lambda f: (-len(f), f)))
    pattern = rf"(?i)\b({forms})\b(?:\s+(?:{JOINING}))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%?"
    part = lambda g: F.regexp_extract_all("sentence", F.lit(pattern), F.lit(g))
    names = F.create_map(*[x for f, c in of_form.items() for x in (F.lit(f), F.lit(c))])
    each = sentences.select("paper_id", "sentence_idx", "sentence", F.posexplode(F.arrays_zip(part(1).alias("form"), part(2).alias("value"))).alias("nth", "r"))
    found = each.select("paper_id", "sentence_idx", "sentence", "nth", names[F.lower("r.form")].alias("metric"), F.col("r.value").cast("double").alias("value")).where(F.col("value").between(0, most))
    d = datasets.where("raw <> ''").select("paper_id", "ord", "canonical", F.lower("raw").alias("raw"))
    where_ = found.select("paper_id", "sentence_idx", "sentence").distinct().join(d, "paper_id")
    low = F.lower("sentence")
    held = low.contains(F.col("raw")) | ((F.length("canonical") >= 3) & low.contains(F.lower("canonical")))
    named = where_.where(held).groupBy("paper_id", "sentence_idx").agg(F.min_by("canonical", "ord").alias("dataset"))
    return found.join(named, ["paper_id", "sentence_idx"], "left").select("paper_id", "sentence_idx", "nth", "metric", "value", "dataset", T.split_kind(F.col("sentence")).alias("split"))


def validated_quotes(quotes: DataFrame, passages: DataFrame, shortest: int = 12, head: int = 80) -> DataFrame:
    """(paper_id, quote_id, passage_idx, by): the paper's first passage that holds a quote, both in plain characters and lower case.

    Where none holds the whole quote, one that holds its first ``head`` characters counts. Quotes shorter than ``shortest`` are never valid; those not found are left out.
    """
    plain = lambda c: F.lower(T.normalise_pdf(F.col(c)))
    q = quotes.select("paper_id", "quote_id", plain("quote").alias("q")).where(F.length("q") >= shortest)
    p = passages.select("paper_id", "passage_idx", plain("text").alias("t"))
    start = F.substring("q", 1, head)
    met = q.join(p, "paper_id").withColumn("by", F.when(F.col("t").contains(F.col("q")), 0).when((F.length("q") > head) & F.col("t").contains(start), 1)).where("by is not null")
    first = met.groupBy("paper_id", "quote_id").agg(F.min(F.struct("by", "passage_idx")).alias("m"))
    return first.select("paper_id", "quote_id", "m.passage_idx", F.when(F.col("m.by") == 0, "whole").otherwise("head").alias("by"))


def grouped_contexts(contexts: DataFrame, key: str = "reference_id", text: str = "context") -> DataFrame:
    """One row for each reference and trimmed text, with the ids that share it: what a model has to be asked once."""
    return contexts.groupBy(key, F.trim(F.col(text)).alias(text)).agg(F.array_sort(F.collect_list("marker_id")).alias("markers"))


def spread_answers(groups: DataFrame, answers: DataFrame, key: str = "reference_id", text: str = "context") -> DataFrame:
    """(marker_id, answer): the answers (key, text, answer) back at each marker of :func:`grouped_contexts`."""
    return groups.join(answers, [key, text]).select(F.explode("markers").alias("marker_id"), "answer")
