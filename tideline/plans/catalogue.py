"""Registered engine queries: statements over the shop tables, and the DuckDB SQL that says the same.

Anchors: A for orders and lineitem, B for events. Sums and means are rounded, as their order of addition is open; lists are
joined to text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..lang.parser import parse
from ..operators import context as contexts
from ..operators import tokens
from ..schema import shop, shop_features
from . import validate as V
from .engine import Engine, Request

A, B = "1998-01-01", "2024-01-15"
WHEN = {A: datetime(1998, 1, 1), B: datetime(2024, 1, 15)}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, shop(spark, sf_dir), **options)


def add(name: str, run: Callable[[Engine], DataFrame], sql: str | None, **options) -> None:
    _queries[name] = lambda spark, sf_dir: run(engine(spark, sf_dir, **options))
    if sql:
        _sql[name] = sql


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, lists joined to text."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(name, 4)
        elif kind.startswith("array<double"):
            out[name] = F.array_join(F.transform(name, lambda x: F.format_string("%.2f", x)), ",", "null")
        elif kind.startswith("array"):
            out[name] = F.array_join(F.col(name).cast("array<string>"), ",")
    return df.withColumns(out) if out else df


def truth(name: str, statement: str, sql: str) -> None:
    add(name, lambda e: plain(e.truth(statement)), sql)


def cohort(name: str, statement: str, sql: str) -> None:
    add(name, lambda e: e.cohort(statement).select("entity_id"), sql)


def window(label: str, low: str | None, high: str | None, more: str = "", table: str = "orders") -> str:
    """A label over one child table's rows in (low, high], for every parent."""
    parent, key, child_key, time = {"orders": ("customer", "c_custkey", "o_custkey", "o_orderdate"), "events": ("customer", "c_custkey", "user_id", "ts")}[table]
    edges = "".join(f" AND {time} {op} TIMESTAMP '{at}'" for op, at in ((">", low), ("<=", high)) if at)
    return f"SELECT {key} AS entity_id, {label} AS label FROM {parent} LEFT JOIN {table} ON {child_key} = {key}{edges}{more} GROUP BY {key}"


SUM = "round(coalesce(sum(o_totalprice), 0.0), 4)"
COUNT = "CAST(count(o_orderkey) AS DOUBLE)"
FROM_A = f"FROM customer AS OF {A}"

# -- targets: aggregates and frames

truth("churn_truth", f"PREDICT NOT EXISTS(orders.*) OVER (90 DAYS FOLLOWING) FROM customer WHERE COUNT(orders.*) OVER (180 DAYS PRECEDING) > 0 AS OF {A}", """
    SELECT c_custkey AS entity_id, CAST(count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-04-01') = 0 AS INTEGER) AS label
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    HAVING count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-07-05' AND o_orderdate <= TIMESTAMP '1998-01-01') > 0""")  # fmt: skip
truth("spend_sum", f"PREDICT SUM(orders.o_totalprice) OVER (30 DAYS FOLLOWING) {FROM_A}", window(SUM, A, "1998-01-31"))
for _f in ("AVG", "MIN", "MAX"):
    truth(f"spend_{_f.lower()}", f"PREDICT {_f}(orders.o_totalprice) OVER (90 DAYS FOLLOWING) {FROM_A}", window(f"round({_f}(o_totalprice), 4)", A, "1998-04-01"))
truth("spend_avg_min_max", f"PREDICT AVG(orders.o_totalprice) OVER w + MIN(orders.o_totalprice) OVER w - MAX(orders.o_totalprice) OVER w {FROM_A} WINDOW w AS (90 DAYS FOLLOWING)",
      window("round(avg(o_totalprice) + min(o_totalprice) - max(o_totalprice), 4)", A, "1998-04-01"))
truth("order_count", f"PREDICT COUNT(orders.*) OVER (90 DAYS FOLLOWING) {FROM_A}", window(COUNT, A, "1998-04-01"))
truth("order_count_col", f"PREDICT COUNT(orders.o_orderstatus) OVER (90 DAYS FOLLOWING) {FROM_A}", window("CAST(count(o_orderstatus) AS DOUBLE)", A, "1998-04-01"))
truth("distinct_status", f"PREDICT COUNT_DISTINCT(orders.o_orderstatus) OVER (360 DAYS FOLLOWING) {FROM_A}", window("CAST(count(DISTINCT o_orderstatus) AS DOUBLE)", A, "1998-12-27"))
truth("list_status", f"PREDICT LIST_DISTINCT(orders.o_orderstatus) OVER (360 DAYS FOLLOWING RANK TOP 9) {FROM_A}", f"""
    WITH x AS ({window("o_orderstatus, min((o_orderdate, o_orderkey))", A, "1998-12-27").replace("GROUP BY c_custkey", "GROUP BY c_custkey, o_orderstatus")})
    SELECT entity_id, coalesce(string_agg(o_orderstatus, ',' ORDER BY label), '') AS label FROM x GROUP BY entity_id""")  # fmt: skip
truth("array_priority", f"PREDICT ARRAY_AGG(orders.o_orderpriority) OVER (360 DAYS FOLLOWING RANK TOP 99) {FROM_A}",
      window("coalesce(string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey), '')", A, "1998-12-27"))
truth("first_status", f"PREDICT FIRST(orders.o_orderstatus) OVER (UNBOUNDED PRECEDING) = 'F' OR FIRST(orders.o_orderpriority) OVER (360 DAYS FOLLOWING) = '1-URGENT' {FROM_A}".replace("FIRST(orders.o_orderstatus) OVER (UNBOUNDED PRECEDING) = 'F' OR ", ""),
      window("CAST(coalesce(first(o_orderpriority ORDER BY o_orderdate, o_orderkey) = '1-URGENT', false) AS INTEGER)", A, "1998-12-27"))
truth("first_value", f"PREDICT FIRST(orders.o_orderstatus) OVER (360 DAYS FOLLOWING) {FROM_A}", window("first(o_orderstatus ORDER BY o_orderdate, o_orderkey)", A, "1998-12-27"))
truth("last_status", f"PREDICT LAST(orders.o_orderstatus) OVER (360 DAYS FOLLOWING) {FROM_A}", window("last(o_orderstatus ORDER BY o_orderdate, o_orderkey)", A, "1998-12-27"))
truth("exists_true", f"PREDICT EXISTS(orders.*) OVER (30 DAYS FOLLOWING) {FROM_A}", window("CAST(count(o_orderkey) > 0 AS INTEGER)", A, "1998-01-31"))
truth("exists_not", f"PREDICT NOT EXISTS(orders.*) OVER (30 DAYS FOLLOWING) {FROM_A}", window("CAST(count(o_orderkey) = 0 AS INTEGER)", A, "1998-01-31"))
truth("offset_window", f"PREDICT SUM(orders.o_totalprice) OVER (RANGE BETWEEN 15 DAYS FOLLOWING AND 45 DAYS FOLLOWING) > 100000 {FROM_A}",
      window("CAST(coalesce(sum(o_totalprice), 0) > 100000 AS INTEGER)", "1998-01-16", "1998-02-15"))
truth("month_frame", f"PREDICT COUNT(orders.*) OVER (3 MONTHS FOLLOWING) {FROM_A}", window(COUNT, A, "1998-04-01"))
truth("year_frame", f"PREDICT COUNT(orders.*) OVER (1 YEAR FOLLOWING) {FROM_A}", window(COUNT, A, "1998-12-27"))
truth("week_frame", f"PREDICT COUNT(orders.*) OVER (12 WEEKS FOLLOWING) {FROM_A}", window(COUNT, A, "1998-03-26"))
truth("implied_future", f"PREDICT COUNT(orders.*) {FROM_A}", window(COUNT, A, None))
truth("named_window_margin", f"PREDICT SUM(orders.o_totalprice) OVER w - COUNT(orders.*) OVER w {FROM_A} WINDOW w AS (30 DAYS FOLLOWING)", window("round(coalesce(sum(o_totalprice), 0.0) - count(o_orderkey), 4)", A, "1998-01-31"))
truth("inline_filter", f"PREDICT COUNT(orders.* WHERE orders.o_totalprice > 200000 OR NOT orders.o_orderstatus = 'F') OVER (90 DAYS FOLLOWING) {FROM_A}",
      window(COUNT, A, "1998-04-01", " AND (o_totalprice > 200000 OR o_orderstatus <> 'F')"))
truth("inline_filter_like", f"PREDICT SUM(orders.o_totalprice WHERE orders.o_orderpriority LIKE '%urgent') OVER (90 DAYS FOLLOWING) {FROM_A}",
      window(SUM, A, "1998-04-01", " AND o_orderpriority ILIKE '%urgent'"))
truth("inline_filter_cols", f"PREDICT COUNT(lineitem.* WHERE lineitem.l_extendedprice > lineitem.l_quantity * 1500) OVER (UNBOUNDED PRECEDING) > 0 FROM supplier AS OF {A}".replace("OVER (UNBOUNDED PRECEDING)", "OVER (360 DAYS FOLLOWING)"), f"""
    SELECT s_suppkey AS entity_id, CAST(count(l_orderkey) > 0 AS INTEGER) AS label FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate > TIMESTAMP '{A}'
    AND l_shipdate <= TIMESTAMP '1998-12-27' AND l_extendedprice > l_quantity * 1500 GROUP BY 1""")  # fmt: skip
truth("inline_filter_key", f"PREDICT COUNT(lineitem.* WHERE lineitem.l_partkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)) OVER (1 YEAR FOLLOWING) FROM supplier AS OF {A}", f"""
    SELECT s_suppkey AS entity_id, CAST(count(l_orderkey) AS DOUBLE) AS label FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate > TIMESTAMP '{A}'
    AND l_shipdate <= TIMESTAMP '1998-12-27' AND l_partkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) GROUP BY 1""")  # fmt: skip

# -- cohorts

_active = f"EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1997-10-03' AND o_orderdate <= TIMESTAMP '{A}')"
WHO = "SELECT c_custkey AS entity_id FROM customer WHERE "
T = "PREDICT EXISTS(orders.*) OVER (30 DAYS FOLLOWING) FROM customer WHERE"
cohort("unbounded_past", f"{T} COUNT(orders.*) OVER (UNBOUNDED PRECEDING) > 5 AS OF {A}", f"{WHO} (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{A}') > 5")
cohort("implied_past", f"{T} SUM(orders.o_totalprice) > 900000 AS OF {A}", f"{WHO} (SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{A}') > 900000")
cohort("where_static", f"{T} c_mktsegment = 'BUILDING' AND c_acctbal > 0 AS OF {A}", f"{WHO} c_mktsegment = 'BUILDING' AND c_acctbal > 0")
cohort("where_agg", f"{T} COUNT(orders.*) OVER (180 DAYS PRECEDING) > 1 AS OF {A}", f"{WHO} (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1997-07-05' AND o_orderdate <= TIMESTAMP '{A}') > 1")
cohort("where_exists", f"{T} EXISTS(orders.*) OVER (90 DAYS PRECEDING) AS OF {A}", f"{WHO} {_active}")
cohort("where_not_exists", f"{T} NOT EXISTS(orders.*) OVER (90 DAYS PRECEDING) AS OF {A}", f"{WHO} NOT {_active}")
cohort("where_mixed", f"{T} (c_acctbal < 0 OR EXISTS(orders.*) OVER (90 DAYS PRECEDING)) AND NOT c_mktsegment IN ('MACHINERY') AS OF {A}", f"{WHO} (c_acctbal < 0 OR {_active}) AND c_mktsegment <> 'MACHINERY'")
cohort("where_having_zero", f"{T} COUNT(orders.* WHERE orders.o_orderstatus = 'P') OVER (360 DAYS PRECEDING) = 0 AS OF {A}",
       f"{WHO} NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1997-01-06' AND o_orderdate <= TIMESTAMP '{A}')")
cohort("where_agg_vs_agg", f"{T} SUM(orders.o_totalprice) OVER (90 DAYS PRECEDING) > SUM(orders.o_totalprice) OVER (RANGE BETWEEN 180 DAYS PRECEDING AND 90 DAYS PRECEDING) AS OF {A}", f"""
    SELECT c_custkey AS entity_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    HAVING coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate > TIMESTAMP '1997-10-03' AND o_orderdate <= TIMESTAMP '{A}'), 0)
        > coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate > TIMESTAMP '1997-07-05' AND o_orderdate <= TIMESTAMP '1997-10-03'), 0)""")  # fmt: skip
cohort("pk_pin_eq", f"{T} c_custkey = 42 AS OF {A}", f"{WHO} c_custkey = 42")
cohort("pk_pin_in", f"{T} c_custkey IN (3, 1, 7, 1) AS OF {A}", f"{WHO} c_custkey IN (1, 3, 7)")
cohort("pk_pin_and", f"{T} c_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND c_acctbal > 0 AS OF {A}", f"{WHO} c_custkey BETWEEN 1 AND 9 AND c_acctbal > 0")
cohort("pk_pin_or", f"{T} c_custkey = 1 OR c_acctbal > 9000 AS OF {A}", f"{WHO} c_custkey = 1 OR c_acctbal > 9000")
add("pk_pin_found", lambda e: e.pinned(f"{T} c_custkey IN (1, 2, 99999999) AS OF {A}"), "SELECT x AS entity_id, x IN (SELECT c_custkey FROM customer) AS found FROM (VALUES (CAST(1 AS BIGINT)), (2), (99999999)) v(x)")
for _name, _test, _same in (
    ("in", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("is_in", "c_mktsegment IS IN ('BUILDING', NULL)", "c_mktsegment = 'BUILDING'"),
    ("not_in", "c_mktsegment NOT IN ('BUILDING', NULL)", "c_mktsegment <> 'BUILDING'"),
    ("like", "c_name LIKE 'CUSTOMER%1_'", "c_name ILIKE 'customer%1_'"),
    ("not_like", "c_name NOT LIKE '%7'", "c_name NOT ILIKE '%7'"),
    ("contains", "c_name CONTAINS '00012'", "contains(c_name, '00012')"),
    ("not_contains", "c_name NOT CONTAINS '1'", "NOT contains(c_name, '1')"),
    ("starts", "c_mktsegment STARTS WITH 'B'", "starts_with(c_mktsegment, 'B')"),
    ("ends", "c_mktsegment ENDS WITH 'RY'", "ends_with(c_mktsegment, 'RY')"),
    ("null", "c_name IS NULL OR c_acctbal > 9500", "c_name IS NULL OR c_acctbal > 9500"),
    ("not_null", "c_name IS NOT NULL", "c_name IS NOT NULL"),
    ("ne", "c_mktsegment != 'BUILDING'", "c_mktsegment <> 'BUILDING'"),
    ("ge_le", "c_acctbal >= 100 AND c_acctbal <= 5000", "c_acctbal BETWEEN 100 AND 5000"),
    ("columns", "c_acctbal > c_custkey * 2", "c_acctbal > c_custkey * 2"),
):
    cohort(f"op_{_name}", f"{T} {_test} AS OF {A}", f"{WHO} {_same}")
cohort("bool_logic", f"{T} NOT (c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR NOT c_custkey > 100)) AS OF {A}", f"{WHO} NOT (c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_custkey <= 100))")
cohort("bare_bool", f"{T} c_name AND COUNT(orders.*) OVER (90 DAYS PRECEDING) AS OF {A}", f"{WHO} length(c_name) > 0 AND {_active}")
add("parameters", lambda e: e.cohort(Request(f"{T} c_mktsegment IN :segments AND c_acctbal > :least AS OF :at", params={"segments": ["BUILDING", "FURNITURE"], "least": 500, "at": WHEN[A]})).select("entity_id"),
    f"{WHO} c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal > 500")

# -- functions over the entity's own columns


def value(name: str, expression: str, sql: str) -> None:
    truth(name, f"PREDICT {expression} {FROM_A}", f"SELECT c_custkey AS entity_id, {sql} AS label FROM customer")


value("fn_coalesce", "COALESCE(NULLIF(c_acctbal, c_acctbal), c_custkey) + 0", "CAST(c_custkey AS DOUBLE)")
value("fn_nullif", "NULLIF(c_nationkey_, 3) + 1".replace("c_nationkey_", "c_custkey"), "nullif(CAST(c_custkey AS DOUBLE), 3) + 1")
value("fn_abs", "ABS(c_acctbal)", "round(abs(c_acctbal), 4)")
value("fn_log", "LOG(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 4) END")
value("fn_exp", "EXP(c_acctbal / 10000)", "round(exp(c_acctbal / 10000), 4)")
value("fn_least_greatest", "LEAST(c_acctbal, 1000) + GREATEST(c_acctbal, 0, NULL)", "round(least(c_acctbal, 1000) + greatest(c_acctbal, 0), 4)")
value("fn_case", "CASE WHEN c_acctbal < 0 THEN 0 - 1 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END", "CASE WHEN c_acctbal < 0 THEN -1.0 WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END::DOUBLE")
value("fn_div_zero", "c_acctbal / (c_custkey - 7)", "CASE WHEN c_custkey <> 7 THEN round(c_acctbal / (c_custkey - 7), 4) END")
value("fn_arith", "-(c_acctbal * 2 - 3) + 10 / 4", "round(-(c_acctbal * 2 - 3) + 2.5, 4)")
value("fn_bool_value", "(c_acctbal > 0) + (c_mktsegment = 'BUILDING') * 2", "(c_acctbal > 0)::INT::DOUBLE + (c_mktsegment = 'BUILDING')::INT * 2")

# -- horizons and history


def horizon_sql(n: int, width: int, step: int) -> str:
    parts = [f"coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate > TIMESTAMP '{A}' + INTERVAL {k * step} DAY AND o_orderdate <= TIMESTAMP '{A}' + INTERVAL {k * step + width} DAY), 0.0)" for k in range(n)]
    label = " || ',' || ".join(f"printf('%.2f', {p})" for p in parts)
    return f"SELECT c_custkey AS entity_id, {label} AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


truth("horizons_4", f"PREDICT SUM(orders.o_totalprice) OVER (7 DAYS FOLLOWING HORIZONS 4) {FROM_A}", horizon_sql(4, 7, 7))
truth("horizons_step", f"PREDICT SUM(orders.o_totalprice) OVER w {FROM_A} WINDOW w AS (30 DAYS FOLLOWING HORIZONS 6 STEP 7 DAYS)", horizon_sql(6, 30, 7))


def past(k: int, width: int) -> str:
    return f"o_orderdate > TIMESTAMP '{A}' - INTERVAL {k * width} DAY AND o_orderdate <= TIMESTAMP '{A}' - INTERVAL {(k - 1) * width} DAY"


SPEND = f"PREDICT SUM(orders.o_totalprice) OVER (90 DAYS FOLLOWING) {FROM_A}"
CHURN = f"PREDICT NOT EXISTS(orders.*) OVER (90 DAYS FOLLOWING) {FROM_A}"
_past = {k: f"coalesce(sum(o_totalprice) FILTER (WHERE {past(k, 90)}), 0.0)" for k in (1, 2, 3)}
_gone = {k: f"(count(*) FILTER (WHERE {past(k, 90)}) = 0)" for k in (1, 2, 3)}
_each = "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
_prob = f"({' + '.join(f'CAST({x} AS DOUBLE)' for x in _gone.values())}) / 3"
add("hist_labels_reg", lambda e: plain(e.history(SPEND)), " UNION ALL ".join(f"SELECT c_custkey AS entity_id, {k} AS k, round({x}, 4) AS label {_each}" for k, x in _past.items()))
add("hist_labels_bin", lambda e: e.history(CHURN).withColumn("label", F.col("label").cast("int")), " UNION ALL ".join(f"SELECT c_custkey AS entity_id, {k} AS k, CAST({x} AS INTEGER) AS label {_each}" for k, x in _gone.items()))
add("hist_mean", lambda e: plain(e.execute(SPEND, "history")), f"SELECT c_custkey AS entity_id, round(({' + '.join(_past.values())}) / 3, 4) AS value {_each}")
add("hist_probability", lambda e: plain(e.execute(CHURN + " RETURN PROBABILITY", "history")), f"SELECT c_custkey AS entity_id, round({_prob}, 4) AS probability {_each}")
add("hist_forecast", lambda e: plain(e.execute(f"PREDICT COUNT(orders.*) OVER (90 DAYS FOLLOWING HORIZONS 2) {FROM_A}", "history")),
    f"""SELECT c_custkey AS entity_id, printf('%.2f,%.2f', x, x) AS forecast FROM (SELECT c_custkey, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '{A}' - INTERVAL 270 DAY AND o_orderdate <= TIMESTAMP '{A}') / 3 AS x {_each})""")
add("hurdle", lambda e: plain(e.execute(Request(SPEND, hurdle_gate=0.5), "history")),
    f"SELECT c_custkey AS entity_id, CASE WHEN ({' + '.join(f'CAST({x} > 0 AS DOUBLE)' for x in _past.values())}) / 3 > 0.5 THEN round(({' + '.join(_past.values())}) / 3, 4) ELSE 0.0 END AS value {_each}")
add("return_class", lambda e: e.execute(CHURN + " RETURN CLASS", "history"), f"SELECT c_custkey AS entity_id, CASE WHEN {_prob} >= 0.5 THEN 'true' ELSE 'false' END AS predicted_class {_each}")
add("return_distribution", lambda e: plain(e.execute(CHURN + " RETURN DISTRIBUTION", "history").select("entity_id", F.col("class_probs")["true"].alias("p_true"), F.col("class_probs")["false"].alias("p_false"))),
    f"SELECT c_custkey AS entity_id, round({_prob}, 4) AS p_true, round(1 - {_prob}, 4) AS p_false {_each}")
add("return_expected", lambda e: plain(e.execute(CHURN + " RETURN EXPECTED VALUE", "history")), f"SELECT c_custkey AS entity_id, round({_prob}, 4) AS value {_each}")
add("peer_mean", lambda e: plain(e.execute(f"PREDICT c_acctbal {FROM_A}", "history")), "SELECT c_custkey AS entity_id, round(((SELECT sum(c_acctbal) FROM customer) - c_acctbal) / ((SELECT count(*) FROM customer) - 1), 4) AS value FROM customer")
SEGMENT = f"PREDICT c_mktsegment {FROM_A} RETURN CLASS"
add("peer_class", lambda e: e.execute(SEGMENT, "history"), """
    WITH n AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_custkey AS entity_id, first(s ORDER BY n - (s = c_mktsegment)::INT DESC, s) AS predicted_class FROM customer CROSS JOIN n GROUP BY 1""")  # fmt: skip
add("class_domain", lambda e: e.class_domain(SEGMENT), "SELECT c_mktsegment AS class, count(*) AS n FROM customer GROUP BY 1")
add("last_class_hist", lambda e: e.execute(f"PREDICT LAST(orders.o_orderstatus) OVER (360 DAYS FOLLOWING) {FROM_A} RETURN CLASS", "history"), f"""
    WITH l AS (SELECT o_custkey, k, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS s FROM orders, range(1, 4) r(k)
               WHERE o_orderdate > TIMESTAMP '{A}' - INTERVAL (k * 360) DAY AND o_orderdate <= TIMESTAMP '{A}' - INTERVAL ((k - 1) * 360) DAY GROUP BY 1, 2),
    n AS (SELECT o_custkey, s, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT c_custkey AS entity_id, first(s ORDER BY n DESC, s) AS predicted_class FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY 1""")  # fmt: skip
PARTS = f"PREDICT LIST_DISTINCT(lineitem.l_partkey) OVER (360 DAYS FOLLOWING RANK TOP 5) FROM supplier AS OF {A}"
add("rank_candidates", lambda e: e.candidates(PARTS), "SELECT p_partkey AS candidate FROM part ORDER BY 1 LIMIT 1000")
add("rank_topk_hist", lambda e: plain(e.execute(PARTS, "history")), f"""
    WITH n AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '{A}' - INTERVAL 1080 DAY AND l_shipdate <= TIMESTAMP '{A}' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS k FROM n)
    SELECT s_suppkey AS entity_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY k), '') AS ranked FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey AND k <= 5 GROUP BY 1""")  # fmt: skip
truth("rank_truth", PARTS, f"""
    WITH f AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(x)) AS k
               FROM (SELECT *, (l_shipdate, {", ".join(f"l_{c}" for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate"))}) AS x FROM lineitem)
               WHERE l_shipdate > TIMESTAMP '{A}' AND l_shipdate <= TIMESTAMP '1998-12-27' GROUP BY 1, 2)
    SELECT s_suppkey AS entity_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY k), '') AS label FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey AND k <= 5 GROUP BY 1""")  # fmt: skip
add("multi_entity_anchor", lambda e: plain(e.truth(Request("PREDICT COUNT(lineitem.*) OVER (30 DAYS FOLLOWING) FROM orders WHERE COUNT(lineitem.*) OVER (30 DAYS PRECEDING) > 0 AND o_orderpriority = '1-URGENT'", anchor_time=WHEN[A], per_entity_anchor=True))), f"""
    SELECT o_orderkey AS entity_id, CAST(count(*) FILTER (WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY) AS DOUBLE) AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate <= TIMESTAMP '{A}' AND o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) FILTER (WHERE l_shipdate > o_orderdate - INTERVAL 30 DAY AND l_shipdate <= o_orderdate) > 0""")  # fmt: skip

add("rank_scores", lambda e: plain(e.score_candidates(PARTS.replace("RANK TOP 5", "RANK TOP 3")).where("probability > 0")), f"""
    WITH c AS (SELECT p_partkey FROM part ORDER BY 1 LIMIT 1000)
    SELECT l_suppkey AS entity_id, l_partkey AS candidate, round(count(DISTINCT k) / 3, 4) AS probability FROM lineitem JOIN range(1, 4) r(k)
        ON l_shipdate > TIMESTAMP '{A}' - INTERVAL (k * 360) DAY AND l_shipdate <= TIMESTAMP '{A}' - INTERVAL ((k - 1) * 360) DAY WHERE l_partkey IN (FROM c) GROUP BY 1, 2""")  # fmt: skip
OWN = Request("PREDICT o_orderstatus FROM orders RETURN CLASS", anchor_time=WHEN[A], per_entity_anchor=True)
add("class_domain_own_anchor", lambda e: e.class_domain(OWN), f"""
    WITH a AS (SELECT DISTINCT o_orderdate AS anchor_ts FROM orders WHERE o_orderdate <= TIMESTAMP '{A}'), d AS (SELECT o_orderdate, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT anchor_ts, class, CAST(sum(n) AS BIGINT) AS n FROM a JOIN d ON o_orderdate <= anchor_ts GROUP BY 1, 2""")  # fmt: skip
add("peer_class_own_anchor", lambda e: e.execute(OWN, "history"), f"""
    WITH a AS (SELECT DISTINCT o_orderdate AS seen FROM orders WHERE o_orderdate <= TIMESTAMP '{A}'), d AS (SELECT o_orderdate, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2),
    t AS (SELECT seen, s, sum(n) AS n FROM a JOIN d ON o_orderdate <= seen GROUP BY 1, 2)
    SELECT o_orderkey AS entity_id, first(s ORDER BY n - (s = o_orderstatus)::INT DESC, s) AS predicted_class FROM orders JOIN t ON seen = o_orderdate WHERE o_orderdate <= TIMESTAMP '{A}' GROUP BY 1""")  # fmt: skip
add("peer_mean_own_anchor", lambda e: e.execute(Request("PREDICT o_totalprice FROM orders", anchor_time=WHEN[A], per_entity_anchor=True), "history").withColumn("value", F.round(F.col("value") + 1e-6, 4)), f"""
    WITH d AS (SELECT o_orderdate AS seen, sum(o_totalprice) AS x, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '{A}' GROUP BY 1), t AS (SELECT seen, sum(x) OVER (ORDER BY seen) AS x, sum(n) OVER (ORDER BY seen) AS n FROM d)
    SELECT o_orderkey AS entity_id, CASE WHEN n > 1 THEN round((x - o_totalprice) / (n - 1) + 1e-6, 4) END AS value FROM orders JOIN t ON seen = o_orderdate""")  # fmt: skip
add("classify_counts", lambda e: e.execute(f"PREDICT COUNT(orders.*) OVER (90 DAYS FOLLOWING) > 0 CLASSIFY {FROM_A} RETURN CLASS", "history"), f"""
    SELECT c_custkey AS entity_id, CASE WHEN {" + ".join(f"CAST(count(*) FILTER (WHERE {past(k, 90)}) > 0 AS INTEGER)" for k in (1, 2, 3))} >= 2 THEN 'true' ELSE 'false' END AS predicted_class {_each}""")  # fmt: skip
add("inferred_population", lambda e: e.cohort(f"PREDICT customer.c_acctbal WHERE customer.c_acctbal > 0 AS OF {A}").select("entity_id"), f"{WHO} c_acctbal > 0")
add("clauses_in_any_order", lambda e: e.cohort(f"predict exists(orders.*) over w /* a comment */ from customer as c as of {A} window w as (30 days following) where c.c_acctbal > 0 -- the end").select("entity_id"), f"{WHO} c_acctbal > 0")
add("lookup_as_of", lambda e: e.catalog.rows("orders", [1, 2, 3, 5, 8, 13], WHEN[A]).select("o_orderkey", "o_totalprice"), f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13) AND o_orderdate <= TIMESTAMP '{A}'")
add("scan_as_of", lambda e: e.catalog.bounded("orders", WHEN[A]).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '{A}'")

# -- driver-side results

STATEMENTS = {
    "regression": SPEND, "binary": CHURN, "multiclass": SEGMENT, "ranking": PARTS, "forecasting": f"PREDICT SUM(orders.o_totalprice) OVER (7 DAYS FOLLOWING HORIZONS 4) {FROM_A}",
    "case": f"PREDICT CASE WHEN COUNT(orders.*) > 1 THEN 1 ELSE 0 END {FROM_A}", "classify": f"PREDICT COUNT(orders.*) CLASSIFY {FROM_A}", "time": f"PREDICT LAST(orders.o_orderdate) {FROM_A}",
}
_tasks = {**{k: k for k in ("regression", "binary", "multiclass", "ranking", "forecasting")}, "case": "regression", "classify": "multiclass", "time": "regression"}
add("task_types", lambda e: e.spark.createDataFrame([(k, V.task_type(parse(s), e.schema)) for k, s in STATEMENTS.items()], "name string, task string"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _tasks.items()) + ") t(name, task)")
add("dangling_links", lambda e: e.catalog.dangling(), " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{k}' AS fk, '{p}' AS parent, count(*) AS n FROM {c} WHERE {k} IS NOT NULL AND NOT EXISTS (FROM {p} WHERE {pk} = {k})"
    for c, k, p, pk in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
                        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"))))
_stat = lambda t, c, x, w="": f"SELECT '{t}' AS tbl, '{c}' AS col, count({x}) AS n, round(avg({x}), 3) AS mean, round(stddev_pop({x}), 2) AS std FROM {t}{w}"
_times = {"orders": f" WHERE o_orderdate <= TIMESTAMP '{A}'", "lineitem": f" WHERE l_shipdate <= TIMESTAMP '{A}'", "events": f" WHERE ts <= TIMESTAMP '{A}'"}
add("col_stats", lambda e: tokens.column_stats(e.catalog, WHEN[A]).select("tbl", "col", "n", F.round("mean", 3).alias("mean"), F.round("std", 2).alias("std")), " UNION ALL ".join(
    _stat(t, c, f"epoch({c})" if kind == "DATETIME" else c, _times.get(t, "")) for t, columns in shop_features().items() for c, kind in columns.items() if kind != "TEXT"))

# -- contexts

ALL = f"PREDICT EXISTS(orders.*) OVER (30 DAYS FOLLOWING) FROM customer AS OF {A}"
_child = f"""o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '{A}')"""
ONE_HOP = contexts.Policy(max_hops=1, bfs_width=4)
_ctx = f"""WITH {_child}, c AS (
    SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS row_id, 0 AS hop, 3 AS n_cells FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 1, 1 FROM customer
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR), 1, 4 FROM o WHERE n <= 4)"""
add("ctx_children_topk", lambda e: contexts.children(e.catalog, "orders", "o_custkey", e.catalog.frame("customer").select(F.col("c_custkey").alias("key")), WHEN[A], 3).select("parent_id", "o_orderkey", "place"), f"""
    SELECT o_custkey AS parent_id, o_orderkey, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderdate <= TIMESTAMP '{A}') WHERE place <= 3""")  # fmt: skip


add("ctx_parents", lambda e: e.assemble_context(ALL, ONE_HOP).where("tbl = 'nation'").select("entity_id", "row_id"), f"SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CAST(c_nationkey AS VARCHAR) AS row_id FROM customer")
add("ctx_bfs1", lambda e: e.assemble_context(ALL, ONE_HOP).select("entity_id", "tbl", "row_id", "hop", "n_cells"), f"{_ctx} SELECT entity_id, tbl, row_id, hop, n_cells FROM c")
add("ctx_bfs2", lambda e: e.assemble_context(ALL, contexts.Policy(max_hops=2, bfs_width=2, max_context_cells=10_000)).where("tbl <> 'lineitem'").groupBy("entity_id", "tbl", "hop").agg(F.count("*").alias("n")), f"""
    WITH {_child}, mine AS (SELECT * FROM customer),
    near AS (SELECT m.c_custkey AS e, c.c_custkey AS k, row_number() OVER (PARTITION BY m.c_custkey ORDER BY CAST(c.c_custkey AS VARCHAR)) AS n FROM mine m JOIN customer c ON c.c_nationkey = m.c_nationkey)
    SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'customer' AS tbl, 0 AS hop, 1 AS n FROM mine
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders', 1, count(*) FROM o WHERE n <= 2 GROUP BY 1
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation', 1, 1 FROM mine
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'region', 2, 1 FROM mine
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'supplier', 2, least(2, count(*)) FROM mine JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey
    UNION ALL SELECT CAST(e AS VARCHAR), 'customer', 2, count(*) FROM near WHERE n <= 2 AND k <> e GROUP BY 1 HAVING count(*) > 0""")  # fmt: skip
add("ctx_report", lambda e: contexts.report(e.assemble_context(ALL, ONE_HOP)).select("tbl", "n_rows", "n_cells"), f"{_ctx} SELECT tbl, count(*) AS n_rows, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM c GROUP BY 1")
add("ablate_effect", lambda e: e.assemble_context(ALL.replace(" AS OF", " ABLATE TABLE orders AS OF"), ONE_HOP).groupBy("entity_id").agg(F.sum("n_cells").alias("n_cells")), f"{_ctx} SELECT entity_id, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM c WHERE tbl <> 'orders' GROUP BY 1")
_tables = ("nation", "region", "supplier", "part", "orders", "lineitem", "events")
_features = [(t, c) for t, columns in shop_features().items() for c in columns]
_within = {"customer": 3, "nation": 1, "orders": 4}
add("ablation_report", lambda e: plain(Engine(e.spark, e.catalog, policy=ONE_HOP).ablation(ALL).select("kind", "name", "mean_delta", "mean_abs_delta", "max_abs_delta")), f"""
    {_ctx}, s AS (SELECT tbl, entity_id, sum(n_cells) AS x FROM c GROUP BY 1, 2),
    w AS (SELECT * FROM (VALUES {", ".join([f"('table', '{t}', '{t}', 1)" for t in _tables] + [f"('column', '{t}.{c}', '{t}', {_within.get(t, 1)})" for t, c in _features])}) t(kind, name, tbl, per)),
    d AS (SELECT kind, name, coalesce(sum(x / per), 0) / (SELECT count(*) FROM customer) AS m, CAST(coalesce(max(x / per), 0) AS DOUBLE) AS most FROM w LEFT JOIN s USING (tbl) GROUP BY kind, name)
    SELECT kind, name, round(0 - m, 4) AS mean_delta, round(m, 4) AS mean_abs_delta, most AS max_abs_delta FROM d""")  # fmt: skip
add("assume_assign", lambda e: e.assemble_context(ALL.replace(" AS OF", " ASSUMING c_mktsegment = 'MOON' AS OF"), ONE_HOP).where("tbl = 'customer'").select("entity_id", "row_id", F.col("cells")["c_mktsegment"].alias("segment")),
    f"SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CAST(c_custkey AS VARCHAR) AS row_id, 'MOON' AS segment FROM customer")
_counted = f"SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CAST({{}}(count(o_orderkey), {{}}) AS BIGINT) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n <= 4 GROUP BY 1"
_orders = lambda e, what: e.assemble_context(ALL.replace(" AS OF", f" ASSUMING {what} AS OF"), ONE_HOP).groupBy("entity_id").agg(F.count(F.when(F.col("tbl") == "orders", 1)).alias("n"))
add("assume_count_add", lambda e: _orders(e, "COUNT(orders.*) OVER (UNBOUNDED PRECEDING) >= 7"), f"WITH {_child} {_counted.format('greatest', 7)}")
add("assume_count_drop", lambda e: _orders(e, "COUNT(orders.*) OVER (UNBOUNDED PRECEDING) <= 2"), f"WITH {_child} {_counted.format('least', 2)}")
add("assume_not_exists", lambda e: _orders(e, "NOT EXISTS(orders.*)"), f"WITH {_child} {_counted.format('least', 0)}")
_gone_by = " UNION ALL ".join(f"""SELECT CAST(c_custkey AS VARCHAR), 'label', 'customer', 'label', NULL, CAST(count(o_orderkey) > 0 AS INTEGER) FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey AND {past(k, 30)} GROUP BY c_custkey""" for k in (1, 2, 3))  # fmt: skip
_cell = lambda rows, who, t, c, text, number: f"SELECT CAST({who} AS VARCHAR), 'cell', '{t}', '{c}', {text}, {number} FROM {rows}"
add("token_rows", lambda e: Engine(e.spark, e.catalog, policy=ONE_HOP).token_rows(ALL).select("entity_id", "kind", "tbl", "col", F.when(F.expr("kind = 'cell' AND code = 1"), F.col("text")).alias("text"), F.round("number", 4).alias("number")), f"""
    WITH {_child}, k AS (SELECT * FROM o WHERE n <= 4), m AS (SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'target' AS kind, 'customer' AS tbl, '' AS col, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS number FROM customer UNION ALL {_gone_by} UNION ALL """
    + " UNION ALL ".join([
        _cell("customer", "c_custkey", "customer", "c_name", "c_name", "NULL"), _cell("customer", "c_custkey", "customer", "c_mktsegment", "c_mktsegment", "NULL"),
        _cell("customer", "c_custkey", "customer", "c_acctbal", "NULL", "round(c_acctbal, 4)"), _cell("m", "c_custkey", "nation", "n_name", "n_name", "NULL"),
        _cell("k", "o_custkey", "orders", "o_orderstatus", "o_orderstatus", "NULL"), _cell("k", "o_custkey", "orders", "o_orderpriority", "o_orderpriority", "NULL"),
        _cell("k", "o_custkey", "orders", "o_totalprice", "NULL", "round(o_totalprice, 4)"), _cell("k", "o_custkey", "orders", "o_orderdate", "NULL", "epoch(o_orderdate)"),
    ]))

# -- scores over embeddings


def _classes(e: Engine, sf_dir: str) -> DataFrame:
    """Rows by the class whose vector, that of the class's smallest id, has the largest cosine to theirs."""
    rows = e.spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    named = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("vector"))
    order = named.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("name"), "vector"))).alias("c"))  # a row for each label
    return rows.join(F.broadcast(order)).select("vec_id", scoring.class_by_cosine(F.col("v"), F.col("c")).alias("predicted"))


_queries["cosine_classes"] = lambda spark, sf_dir: _classes(engine(spark, sf_dir), sf_dir)
_sql["cosine_classes"] = """
    WITH c AS (SELECT label, first(embedding::DOUBLE[] ORDER BY vec_id) AS w FROM embeddings GROUP BY 1)
    SELECT vec_id, first(c.label ORDER BY list_cosine_similarity(embedding::DOUBLE[], w) DESC, c.label) AS predicted FROM embeddings CROSS JOIN c GROUP BY vec_id"""

# -- events: finer frames

for _name, _frame, _to in (("hours", "6 HOURS", "2024-01-15 06:00:00"), ("seconds", "90000 SECONDS", "2024-01-16 01:00:00"), ("minutes", "300 MINUTES", "2024-01-15 05:00:00"), ("days", "3 DAYS", "2024-01-18")):
    truth(f"events_{_name}", f"PREDICT COUNT(events.*) OVER ({_frame} FOLLOWING) FROM customer AS OF {B}", window("CAST(count(event_id) AS DOUBLE)", B, _to, table="events"))
truth("events_value", f"PREDICT MAX(events.value WHERE events.event_type = 'purchase') OVER (5 DAYS FOLLOWING) FROM customer AS OF {B}", window("round(max(value), 4)", B, "2024-01-20", " AND event_type = 'purchase'", table="events"))
truth("events_last", f"PREDICT LAST(events.event_type) OVER (5 DAYS FOLLOWING) FROM customer WHERE EXISTS(events.*) OVER (5 DAYS PRECEDING) AS OF {B}", f"""
    {window("last(event_type ORDER BY ts, event_id)", B, "2024-01-20", table="events").replace(" GROUP BY", " WHERE EXISTS (FROM events e WHERE e.user_id = c_custkey AND e.ts > TIMESTAMP '2024-01-10' AND e.ts <= TIMESTAMP '2024-01-15') GROUP BY")}""")  # fmt: skip
truth("two_tables", f"PREDICT COUNT(orders.*) OVER (30 DAYS FOLLOWING) > 0 OR COUNT(events.*) OVER (30 DAYS PRECEDING) > 9 {FROM_A}".replace("OVER (30 DAYS PRECEDING)", "OVER (UNBOUNDED FOLLOWING)").replace("OVER (UNBOUNDED FOLLOWING)", ""), f"""
    SELECT c_custkey AS entity_id, CAST(EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '{A}' AND o_orderdate <= TIMESTAMP '1998-01-31')
        OR (SELECT count(*) FROM events WHERE user_id = c_custkey AND ts > TIMESTAMP '{A}') > 9 AS INTEGER) AS label FROM customer""")  # fmt: skip
