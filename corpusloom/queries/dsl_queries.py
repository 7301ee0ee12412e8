"""The query language over the test tables."""

from __future__ import annotations

from corpusloom.catalog import register
from corpusloom.fixtures import view, with_views
from corpusloom.plans import dsl

_ALL = ("papers", "authors", "categories", "usage", "results", "fields")


def _sql(condition: str, order: str = "year DESC NULLS LAST", limit: int = 100) -> str:
    return with_views(*_ALL) + f""" SELECT p.paper_id, p.year, p.venue, p.triage_label,
    (SELECT count(*) FROM categories c WHERE c.paper_id = p.paper_id) AS n_categories, (SELECT count(*) FROM results r WHERE r.paper_id = p.paper_id) AS n_results
FROM papers p WHERE {condition} ORDER BY {order}, p.paper_id LIMIT {limit}"""


def _exists(table: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} x WHERE x.paper_id = p.paper_id AND {condition})"


_CASES = {
    "dsl_empty": ("", "true", {}),
    "dsl_direct": ("venue:'1-URGENT' AND year>=2000", "lower(venue) = '1-urgent' AND year >= 2000", {}),
    "dsl_not_equal": ("triage_label!=include AND year=1996", "lower(triage_label) <> 'include' AND year = 1996", {}),
    "dsl_author": ("author:'Customer#000000007'", _exists("authors", "lower(author) = 'customer#000000007'"), {}),
    "dsl_category": ("category:'{a}' AND category:'{b}'", _exists("categories", "lower(category) = '{a}'") + " AND " + _exists("categories", "lower(category) = '{b}'"), {}),
    "dsl_entity": ("kind.promo:'{a}'", _exists("usage", "lower(kind) = 'promo' AND lower(canonical) = '{a}'"), {}),
    "dsl_results": ("results.A>0.98 OR results.dataset:'Brand#11' AND year:1999", f"({_exists('results', chr(108) + 'ower(metric) = ' + chr(39) + 'a' + chr(39) + ' AND value > 0.98')} OR ({_exists('results', 'lower(dataset) = ' + chr(39) + 'brand#11' + chr(39))} AND year = 1999))", {}),
    "dsl_field": ("system_domain:BUILDING AND total_price>250000", _exists("fields", "field_name = 'system_domain' AND lower(field_value) = 'building'") + " AND " + _exists("fields", "field_name = 'total_price' AND field_value::DOUBLE > 250000"), {}),
    "dsl_or_of_ands": ("year:1995 AND venue:'5-LOW' OR year:1997 AND triage_label:maybe OR paper_id:7", "(year = 1995 AND venue = '5-LOW') OR (year = 1997 AND triage_label = 'maybe') OR paper_id = 7", {"order": "year_asc", "limit": 500}),
}


def _register(name: str, query: str, condition: str, options: dict) -> None:
    # two part names
    names = {"a": "blue anvil", "b": "blue bolt"}
    q, c = (x.replace("{a}", names["a"]).replace("{b}", names["b"]) for x in (query, condition))
    order = "year ASC NULLS LAST" if options.get("order") == "year_asc" else "year DESC NULLS LAST"

    @register(name, _sql(c, order, options.get("limit", 100)))
    def found(spark, sf_dir):
        tables = {t: view(spark, sf_dir, t) for t in _ALL}
        return dsl.run(q, tables, **options).select("paper_id", "year", "venue", "triage_label", "n_categories", "n_results")


for _name, (_query, _condition, _options) in _CASES.items():
    _register(_name, _query, _condition, _options)


@register(
    "dsl_text",
    with_views("texts") + "SELECT paper_id, year, venue FROM texts WHERE (contains(lower(title), 'license') OR contains(lower(abstract), 'license')) OR lower(lang) = 'es' AND year >= 2020 ORDER BY year ASC NULLS LAST, paper_id LIMIT 1000",
)
def dsl_text(spark, sf_dir):
    return dsl.run("license OR lang:es AND year>=2020", {"papers": view(spark, sf_dir, "texts")}, order="year_asc", limit=1000).select("paper_id", "year", "venue")
