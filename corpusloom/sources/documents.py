"""Structured documents: TEI and HTML as one table of blocks, and text files as pages and lines."""

from __future__ import annotations

import re
import xml.etree.ElementTree as X
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id long, block_idx int, kind string, level int, text string, target string"


def _words(text: str) -> str:
    return " ".join(text.split())


def tei_blocks(xml: str | None) -> list[tuple]:
    """(kind, level, text, target) in document order: title, author, abstract, head, p, ref, bibl, table and figure; none from what does not parse.

    A head's level counts the divisions around it. A ref carries the id of the reference it
    points to, and a bibl its own id.
    """
    try:
        root = X.fromstring(xml or "")
    except X.ParseError:
        return []
    out: list[tuple] = []
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    text = lambda e: _words(" ".join(e.itertext()))
    key = lambda e: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)

    def walk(e, level: int, inside: str) -> None:
        tag = name(e)
        if tag == "title" and inside == "titleStmt":
            out.append(("title", 0, text(e), None))
        elif tag == "author" and inside != "biblStruct":
            out.append(("author", 0, text(e), None))
        elif tag == "abstract":
            out.append(("abstract", 0, text(e), None))
        elif tag == "biblStruct":
            out.append(("bibl", 0, text(e), key(e)))
        elif tag in ("table", "figure") and not (tag == "table" and inside == "figure"):
            out.append(("table" if e.get("type") == "table" else tag, level, text(e), key(e)))
        elif tag == "head":
            out.append(("head", max(1, level), text(e), None))
        elif tag == "p":
            out.append(("p", level, text(e), None))
            out.extend(("ref", level, text(r), (r.get("target") or "").lstrip("#") or None) for r in e.iter() if name(r) == "ref" and r.get("type") == "bibr")
        else:
            for child in e:
                walk(child, level + (tag == "div"), tag if tag in ("titleStmt", "biblStruct", "figure") else inside)

    walk(root, 0, "")
    return out


class _Html(HTMLParser):
    """Headings and paragraphs of a page; scripts, styles and comments are no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.open: tuple[str, int, list[str]] | None = None
        self.mute = 0

    def _close(self) -> None:
        if self.open is not None and _words("".join(self.open[2])):
            self.out.append((self.open[0], self.open[1], _words("".join(self.open[2])), None))
        self.open = None

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "title", "li"):
            self._close()
            self.open = ("head", int(tag[1]), []) if tag[0] == "h" else (tag, 0, [])
        elif tag == "br" and self.open is not None:
            self.open[2].append(" ")

    def handle_endtag(self, tag):
        self.mute = max(0, self.mute - (tag in ("script", "style")))
        if self.open is not None and (tag in ("p", "title", "li", "article", "body") or re.fullmatch("h[1-6]", tag)):
            self._close()

    def handle_data(self, data):
        if self.open is not None and not self.mute:
            self.open[2].append(data)


def html_blocks(html: str | None) -> list[tuple]:
    """(kind, level, text, target): title, head, p and li of a page."""
    parser = _Html()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return parser.out


def blocks(docs: DataFrame, markup: str = "html") -> DataFrame:
    """BLOCKS of rows (doc_id, body), body in ``html`` or ``tei``."""
    read = {"html": html_blocks, "tei": tei_blocks}[markup]

    def run(batches):
        for b in batches:
            rows = [(d, i, *x) for d, body in zip(b["doc_id"], b["body"]) for i, x in enumerate(read(body))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "kind", "level", "text", "target"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "body").mapInPandas(run, BLOCKS)


def page_lines(pieces: DataFrame, gap: float = 4.0) -> DataFrame:
    """(doc_id, page, line_idx, text) from placed text pieces (doc_id, page, idx, y, text), as a PDF reader gives them.

    A piece whose y is more than ``gap`` from the one before starts a line; blank lines go.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id", "page").orderBy("idx")
    p = pieces.withColumn("new", (F.abs(F.col("y") - F.lag("y").over(order)) > gap).cast("int"))
    p = p.withColumn("line", F.sum(F.coalesce("new", F.lit(0))).over(order))
    joined = p.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"))
    lines = joined.select("doc_id", "page", "line", F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda s: s["text"]), " "), r"\s+", " ")).alias("text")).where("text <> ''")
    return lines.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line")) - 1).alias("line_idx"), "text")
