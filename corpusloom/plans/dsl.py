"""The boolean query language: lexer, parser, and a compiler to DataFrames.

``field op value`` clauses and free text, joined by AND and OR; no parentheses,
OR binds weaker. Each clause on a table of many rows for a paper becomes its
own semi-join, as a flag, so clauses on one field do not interfere.
"""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = (">=", "<=", "!=", ">", "<", "=", ":")
#: Columns of papers that a query may name.
DIRECT = ("paper_id", "title", "year", "venue", "doi", "abstract", "triage_label", "lang")
#: Names of entity kinds in queries.
KINDS = {"dataset": "dataset", "datasets": "dataset", "system": "system", "systems": "system", "framework": "framework", "frameworks": "framework"}
RESULT_COLUMNS = ("metric", "dataset", "split", "value")
ORDERS = {"year_desc": ("year", False), "year_asc": ("year", True), "title": ("title", True), "paper_id": ("paper_id", True)}
MAX_ROWS = 1000


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass(frozen=True)
class Clause:
    key: str
    op: str
    value: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple


def tokenise(query: str) -> list[tuple[str, str]]:
    """(kind, text) with kind word, text (quoted) or op; a backslash escapes inside quotes."""
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "\"'":
            j, part = i + 1, []
            while j < len(query) and query[j] != c:
                if query[j] == "\\" and j + 1 < len(query):
                    j += 1
                part.append(query[j])
                j += 1
            if j >= len(query):
                raise QueryError("a quote is not closed")
            out.append(("text", "".join(part)))
            i = j + 1
        elif op := next((o for o in OPERATORS if query.startswith(o, i)), None):
            out.append(("op", op))
            i += len(op)
        else:
            m = re.compile(r"(?:(?!!=)[^\s\"'<>=:])+").match(query, i)
            out.append(("word", m[0]))
            i = m.end()
    return out


def parse(query: str) -> Node | Clause | Text | None:
    """OR of ANDs of leaves; None for an empty query. A leaf keeps its first three tokens."""
    groups: list[list[list]] = [[[]]]
    for token in tokenise(query):
        if token[0] == "word" and token[1].upper() == "OR":
            groups.append([[]])
        elif token[0] == "word" and token[1].upper() == "AND":
            groups[-1].append([])
        else:
            groups[-1][-1].append(token)
    ors = []
    for group in groups:
        leaves = [leaf for part in group if (leaf := _leaf(part)) is not None]
        if leaves:
            ors.append(leaves[0] if len(leaves) == 1 else Node("and", tuple(leaves)))
    return None if not ors else ors[0] if len(ors) == 1 else Node("or", tuple(ors))


def _leaf(tokens: list[tuple[str, str]]) -> Clause | Text | None:
    if not tokens:
        return None
    if len(tokens) >= 3 and tokens[0][0] == "word" and tokens[1][0] == "op":
        if len(tokens) > 3:
            warnings.warn(f"ignored after {tokens[2][1]!r}: join clauses with AND or OR", stacklevel=3)
        return Clause(tokens[0][1], "=" if tokens[1][1] == ":" else tokens[1][1], tokens[2][1])
    if tokens[1:] and tokens[1][0] == "op":
        raise QueryError(f"nothing to compare {tokens[0][1]!r} with")
    return Text(" ".join(t[1] for t in tokens))


def number(column: Column) -> Column:
    """The number that a text starts with, 0 if none, as SQLite casts."""
    return F.coalesce(F.regexp_extract(F.trim(column.cast("string")), r"^([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|[+-]?\.\d+)", 1).try_cast("double"), F.lit(0.0))


def compare(column: Column, op: str, value: str) -> Column:
    """Case-insensitive equality, or numeric order; null is never true."""
    if op in ("=", "!="):
        same = F.lower(column.cast("string")) == value.lower()
        return same if op == "=" else ~same
    try:
        limit = float(value)
    except ValueError:
        limit = math.nan
    if not math.isfinite(limit):
        raise QueryError(f"{op} needs a number, not {value!r}")
    n = number(column)
    return F.when(column.isNotNull(), {">": n > limit, ">=": n >= limit, "<": n < limit, "<=": n <= limit}[op])


def run(query: str, tables: dict[str, DataFrame], order: str = "year_desc", limit: int = 100, only: DataFrame | None = None) -> DataFrame:
    """Papers that a query finds: the table's columns, each once, with n_categories and n_results.

    tables: papers, and of authors (paper_id, author), categories (paper_id,
    category), usage (paper_id, kind, canonical), results (paper_id, metric, dataset,
    split, value), fields (paper_id, field_name, field_value) those that the query uses.
    Nulls come last in any order, ties by paper_id. only, if given, filters after the
    limit by its paper_id.
    """
    papers = tables["papers"]
    flags: list[tuple[str, DataFrame]] = []

    def has(rows: DataFrame, condition: Column) -> Column:
        name = f"clause_{len(flags)}"
        flags.append((name, rows.where(condition).select("paper_id").distinct().withColumn(name, F.lit(True))))
        return F.coalesce(F.col(name), F.lit(False))

    def clause(c: Clause) -> Column:
        key = c.key.lower()
        if key in papers.columns and key in DIRECT:
            return F.coalesce(compare(F.col(key), c.op, c.value), F.lit(False))
        if key in ("author", "authors"):
            return has(tables["authors"], compare(F.col("author"), c.op, c.value))
        if key in ("category", "categories"):
            return has(tables["categories"], compare(F.col("category"), c.op, c.value))
        if key in KINDS:
            return has(tables["usage"], (F.lower("kind") == KINDS[key]) & compare(F.col("canonical"), c.op, c.value))
        if key.startswith("kind."):
            return has(tables["usage"], (F.lower("kind") == key[5:]) & compare(F.col("canonical"), c.op, c.value))
        if key.startswith("results."):
            name = key[8:]
            if name in RESULT_COLUMNS:
                return has(tables["results"], compare(F.col(name), c.op, c.value))
            return has(tables["results"], (F.lower("metric") == name) & compare(F.col("value"), c.op, c.value))
        return has(tables["fields"], (F.col("field_name") == c.key) & compare(F.col("field_value"), c.op, c.value))

    def build(x) -> Column:
        if isinstance(x, Clause):
            return clause(x)
        if isinstance(x, Text):
            found = [F.lower(c).contains(x.value.lower()) for c in ("title", "abstract") if c in papers.columns]
            return F.coalesce(reduce(Column.__or__, found), F.lit(False)) if found else F.lit(False)
        parts = [build(p) for p in x.parts]
        return reduce(Column.__and__ if x.kind == "and" else Column.__or__, parts)

    tree = parse(query)
    condition = build(tree) if tree is not None else F.lit(True)
    rows = papers
    for _, flag in flags:
        rows = rows.join(flag, "paper_id", "left")
    found = rows.where(condition).select(*papers.columns).distinct()
    for name in ("categories", "results"):
        if name in tables:
            found = found.join(tables[name].groupBy("paper_id").agg(F.count("*").alias(f"n_{name}")), "paper_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    column, up = ORDERS[order]
    by = F.col(column).asc_nulls_last() if up else F.col(column).desc_nulls_last()
    out = found.orderBy(by, "paper_id").limit(max(1, min(MAX_ROWS, limit)))
    return out if only is None else out.join(only.select("paper_id").distinct(), "paper_id", "left_semi")
