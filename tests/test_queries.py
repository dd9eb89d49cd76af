"""Every registered query runs; those with an oracle are compared with DuckDB.

A quick selection by default; set FULL_CHECK=1 for all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels", "pages", "lineitem"]
QUICK = ["noise_lines", "register_between_lines", "mentions_by_operation", "perturbation_summaries", "markers_by_tradition", "parse_by_tradition", "pair_study_by_meaning", "redline_unified",
         "clean_documents", "parse_clauses", "resolve_jurisdiction", "compare_summary",
         "align_semantic", "match_in_rounds", "search_library", "library_store",
         "register_amendments", "localisation_sweep", "matrix_scores", "term_rates",
         "redline_edits", "export_csv", "compare_frame_encoder", "annotation_sheet", "append_curve",
         "encode_model", "encode_weighted_terms", "search_indexed", "list_versions_in_country", "pool_vectors",
         "nearest_by_pivots", "reading_order", "backfill_ordinals", "change_spine"]
CHOSEN = sorted(entry_point.queries()) if os.environ.get("FULL_CHECK") else QUICK


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert rows == wanted


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
