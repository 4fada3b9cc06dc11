"""Registered queries against their SQL, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import catalogue

SOME = ["churn_truth", "spend_avg_min_max", "list_status", "last_status", "inline_filter_cols", "where_mixed", "pk_pin_found", "fn_least_greatest", "horizons_step", "hist_mean", "hurdle", "rank_topk_hist", "multi_entity_anchor", "ctx_bfs2", "assume_count_add", "two_tables", "ctx_bfs1", "ctx_report", "ablation_report", "token_rows", "col_stats", "rank_scores", "class_domain_own_anchor", "peer_class_own_anchor", "peer_mean_own_anchor", "classify_counts", "inferred_population", "clauses_in_any_order", "lookup_as_of", "scan_as_of"]


def plain(value):
    return round(float(value), 4) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    names = sorted(want.columns)
    got = catalogue.queries()[name](spark, sf).select(*names).collect()
    rows = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in rows), key=key)


def test_every_query_has_sql_but_those_that_cannot():
    without = {k for k in entry.queries() if k not in entry.oracle_sql()}
    assert all(k == "pipeline" or k.startswith("op") and k[2].isdigit() for k in without)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_id", "label"] and df.count() > 0
