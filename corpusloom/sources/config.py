"""Project files that a person writes: the topic and the query bank. They are small and read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpusloom.sources.notes import read_front_matter

PLACEHOLDER = "replace_with"
MANUAL_FIELDS = ("title", "authors", "year", "venue", "doi", "url", "pdf_url", "reason")


@dataclass
class Topic:
    title: str = ""
    description: str = ""
    contact_email: str = ""
    year_min: int = 2018
    year_max: str = "present"
    categories: list[str] = field(default_factory=list)
    method_families: list[str] = field(default_factory=list)
    entity_types: list[str] = field(default_factory=list)
    theoretical_kinds: list[str] = field(default_factory=list)
    target_includes: int | None = None
    minimum_includes: int | None = None


def read_topic(markdown: str | None) -> Topic:
    """A topic from ``key: value`` lines, ``key:`` followed by a list, and a ``description: |`` block; whatever is absent keeps its default."""
    topic, lines = Topic(), (markdown or "").split("\n")

    def value(key: str) -> str | None:
        return next((m[1].strip() for x in lines if (m := re.search(rf"{key}:[ \t]*(\S.*)", x))), None)

    def items(key: str) -> list[str]:
        at = next((i for i, x in enumerate(lines) if re.search(rf"{key}:\s*$", x)), None)
        out = []
        for x in lines[at + 1 :] if at is not None else ():
            m = re.match(r"\s*-\s*(\S.*)", x)
            if not m:
                break
            out.append(m[1].strip())
        return out

    topic.title = value("title") or ""
    email = (value("contact_email") or "").split(" ")[0]
    topic.contact_email = "" if email.upper().startswith("REPLACE") else email
    for key in ("year_min", "target_includes", "minimum_includes"):
        if (m := re.match(r"\d+", value(key) or "")) is not None:
            setattr(topic, key, int(m[0]))
    topic.year_max = (value("year_max") or topic.year_max).split(" ")[0]
    at = next((i for i, x in enumerate(lines) if re.search(r"description:\s*\|\s*$", x)), None)
    if at is not None:
        kept = []
        for x in lines[at + 1 :]:
            if not re.match(r"[ \t]+", x):
                break
            kept.append(re.sub(r"^[ \t]{2}", "", x))
        topic.description = "\n".join(kept).strip()
    topic.categories = [c for c in items("categories") if not c.startswith(PLACEHOLDER)]
    topic.entity_types = [c for c in items("entity_types") if not c.startswith(PLACEHOLDER)]
    topic.method_families, topic.theoretical_kinds = items("method_families"), items("theoretical_kinds")
    return topic


@dataclass
class QueryBank:
    queries: list[str] = field(default_factory=list)
    additions: list[dict] = field(default_factory=list)


def read_query_bank(markdown: str | None) -> QueryBank:
    """Queries from the fenced block below ``## Query bank``, and rows from YAML lists below ``## Manual additions``; a malformed block gives nothing."""
    bank, sections = QueryBank(), {}
    for part in re.split(r"^##\s+", markdown or "", flags=re.M)[1:]:
        heading, _, body = part.partition("\n")
        sections.setdefault(heading.strip().lower(), body)
    fences = lambda name: re.findall(r"```\w*\n(.*?)```", next((b for h, b in sections.items() if h.startswith(name)), ""), re.S)
    for block in fences("query bank")[:1]:
        bank.queries = [x.strip() for x in block.split("\n") if x.strip() and not x.strip().startswith("#") and not x.strip().lower().startswith("example topic")]
    for block in fences("manual additions"):
        try:
            rows = read_front_matter(block)
        except ValueError:
            continue
        for row in rows if isinstance(rows, list) else ():
            if isinstance(row, dict) and (row.get("title") or row.get("doi")):
                bank.additions.append({k: "" if row.get(k) is None else row[k] for k in MANUAL_FIELDS})
    return bank
