"""Registered queries against their DuckDB oracles on the smallest scale factor."""
import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import rows_of
from sigspark.sources.tables import TABLES

FAST = ["ft_byte_summary", "agg_split_overview", "agg_field_coverage", "agg_numeric_summary", "agg_stage2_summary",
        "agg_label_map", "agg_family_coverage", "join_full_counts", "win_stratified_split", "win_time_series_split",
        "met_roc_auc", "met_pr_auc", "met_best_f1_threshold", "met_multiclass_report", "csc_predict",
        "ft_string_iocs", "ft_header_vec", "csc_scan", "stm_label_counts"]


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_has_a_callable():
    qs, sq = entry.queries(), entry.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 130


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    b, bc = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert ac == bc
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
