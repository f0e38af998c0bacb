"""The registered queries themselves."""

import __spark_entry__ as entry_points
from checks.compare import compare
from checks.views import TABLES

import duckdb
import pytest


def test_entry_gives_one_row_per_file(spark):
    rows = entry_points.entry(spark)
    assert rows.count() > 100 and "risk_score" in rows.columns


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", [
    "flagship_corpus_rollup", "r14_static_findings", "r15_scan_findings", "u2_merge", "w2_rank_in_file", "snk1_json_report",
    "src8_reply_findings", "t4_file_progress", "j6_fan_back", "snk3_cache_upsert", "x1_call_sites", "src1_source_pieces", "w2_sorted", "a10_findings_list", "snk3_cache_latest", "t2_scan_stream_cache"])
def test_query_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    count, verdict = compare(spark, con, sf_dir, name)
    assert verdict is True, verdict
