"""Queries against DuckDB on the smallest tables, and the entry point."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from corpusloom import catalog
from corpusloom.fixtures import TABLES

SF = Path("/root/testdata/sf0.001")
CHECKED = [
    "gap_evidence", "gap_knowledge", "gap_practical", "gap_run_all", "p4_run_all", "net_coupling", "net_triangulation", "trend_temporal", "dsl_results", "report_matrix", "report_prisma", "txt_bm25", "txt_chunks", "txt_ngram_novelty",
    "txt_contained_quotes", "txt_section_tree", "txt_mined_results", "er_canonicalise", "dec_bool_signals", "vec_lof", "vec_recommend", "ing_paper_view", "src_notes", "src_openalex_works", "src_tei_blocks", "str_resumed", "reg_coherence",
]


def canon(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if not isinstance(x, (str, bool)) else x


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(got.columns)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(canon(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(canon(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_entry(spark):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) >= 60
    assert "gap_evidence" in names
