"""Two-valued logic and window aggregates against a row-at-a-time evaluator."""

import itertools
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.lang import ast as A
from tideline.lang import parse
from tideline.operators.aggregates import row_reader
from tideline.functions.expressions import Expressions
from tideline.plans.engine import Engine, Request
from tideline.schema import Catalog, infer

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def odd(spark):
    numbers, texts = [None, 0.0, -1.5, 3.0, float("nan")], [None, "", "a%c", "A_C\nx", "abc"]
    rows = [(k, x, y, s, b) for k, (x, y, s, b) in enumerate(itertools.product(numbers, [None, 3.0, 0.0], texts, [None, True, False]))]
    df = spark.createDataFrame(rows, "id long, x double, y double, s string, b boolean").cache()
    return Catalog(infer({"e": df}, {"e": "id"}, {}, []), {"e": df}), [dict(zip(("id", "x", "y", "s", "b"), r)) for r in rows]


def value(node, row):
    match node:
        case A.Lit(v):
            return v
        case A.Col(_, name):
            return row[name]
        case A.Arith(op, left, right):
            a, b = (float(v) if isinstance(v, (int, float)) else None for v in (value(left, row), value(right, row)))
            if a is None or b is None or (op == "/" and b == 0):
                return None
            return {"+": a + b, "-": a - b, "*": a * b}[op] if op != "/" else a / b
        case A.Func(name, args):
            vals = [value(a, row) for a in args]
            if name == "COALESCE":
                return next((v for v in vals if v is not None), None)
            if name == "NULLIF":
                return None if vals[0] == vals[1] else vals[0]
            if name in ("LEAST", "GREATEST"):
                real = [float(v) for v in vals if v is not None and v == v]
                return (min if name == "LEAST" else max)(real) if real else None
            v = vals[0]
            if v is None:
                return None
            return {"ABS": abs, "EXP": math.exp, "LOG": lambda z: math.log(z) if z > 0 else None}[name](v)
        case A.Case(whens, otherwise):
            return next((value(v, row) for c, v in whens if holds(c, row)), None if otherwise is None else value(otherwise, row))
    return holds(node, row)


def holds(node, row):
    match node:
        case A.And(parts):
            return all(holds(p, row) for p in parts)
        case A.Or(parts):
            return any(holds(p, row) for p in parts)
        case A.Not(part):
            return not holds(part, row)
        case A.Compare(op, left, right):
            a = value(left, row)
            if op in ("IS NULL", "IS NOT NULL"):
                return (a is None) == (op == "IS NULL")
            if a is None:
                return False
            if op.endswith("IN"):
                inside = any(v.value is not None and type(v.value) is not str and type(a) is not str and float(a) == float(v.value) or a == v.value for v in right.values)
                return inside == (op == "IN")
            b = value(right, row)
            if op.removeprefix("NOT ") in ("LIKE", "CONTAINS", "STARTS WITH", "ENDS WITH"):
                if op.endswith("LIKE"):
                    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in b)
                    inside = re.fullmatch(pattern, a, re.IGNORECASE) is not None
                else:
                    inside = {"CONTAINS": b in a, "STARTS WITH": a.startswith(b), "ENDS WITH": a.endswith(b)}[op.removeprefix("NOT ")]
                return inside != op.startswith("NOT ")
            if b is None:
                return op == "!="
            if op in ("=", "!="):
                return (a == b) == (op == "=")
            return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    v = value(node, row)
    return bool(v)


CONDITIONS = [
    "x > 0", "NOT x > 0", "x >= y", "NOT (x >= y)", "x != y", "NOT x != y", "x = y", "NOT x = y", "x = NULL", "NOT x = NULL", "x != NULL", "NOT x != NULL", "x IN (3, NULL)", "NOT x IN (3, NULL)",
    "x NOT IN (0, 3, NULL)", "NOT x NOT IN (0)", "s LIKE 'a%c'", "NOT s LIKE 'a_c'", "s NOT LIKE '%x'", "NOT s NOT LIKE '%b%'", "s CONTAINS '%'", "NOT s CONTAINS 'b'", "s NOT CONTAINS 'b'", "s STARTS WITH 'a'",
    "NOT s ENDS WITH 'c'", "s", "NOT s", "x", "NOT x", "b", "NOT b", "b = TRUE", "b > x", "NOT (x > 0 AND (s = 'abc' OR NOT b))", "x IS NULL OR NOT y IS NOT NULL", "x / y > 1", "NOT x / y > 1", "LOG(x) < 2", "NOT LOG(x) < 2",
    "COALESCE(x, y, 7) > 2", "NULLIF(x, 3) IS NULL", "LEAST(x, y) < 1", "NOT GREATEST(x, y, 1) > 2", "CASE WHEN x > 0 THEN x ELSE y END > 1", "(x > 0) + (y > 0) = 2", "s = 5", "s != 5", "NOT s = 5", "x IN ('a')", "x NOT IN ('a')",
]


@pytest.mark.parametrize("text", CONDITIONS)
def test_two_valued_logic(odd, text):
    catalog, rows = odd
    node = parse(f"PREDICT {text} FROM e").target
    compiled = Expressions(row_reader(catalog, "e"))
    df = catalog.frame("e")
    want = {r["id"] for r in rows if holds(node, r)}
    assert {r["id"] for r in df.where(compiled.filter(node)).select("id").collect()} == want
    assert {r["id"] for r in df.select("id", compiled.truth(node).alias("t")).where("t").collect()} == want


@pytest.fixture(scope="module")
def family(spark):
    rng = random.Random(4)
    stamps = [None, *(T0 + k * DAY / 2 for k in range(-8, 9))]
    kids = [(k, rng.choice([None, *range(7)]), rng.choice(stamps), rng.choice([None, 1.0, 2.0, 2.0, -3.0]), rng.choice([None, "p", "q", "r"])) for k in range(160)]
    parents = [(k, float(k)) for k in range(8)]
    frames = {"p": spark.createDataFrame(parents, "id long, size double").cache(), "c": spark.createDataFrame(kids, "cid long, pid long, ts timestamp_ntz, v double, tag string").cache()}
    return Catalog(infer(frames, {"p": "id", "c": "cid"}, {"c": "ts"}, [("c", "pid", "p")]), frames), parents, kids


def aggregate(agg, kids, parent, anchor):
    rows = [dict(zip(("cid", "pid", "ts", "v", "tag"), k)) for k in kids if k[1] == parent and k[2] is not None]
    f = agg.frame
    rows = [r for r in rows if f.start < (r["ts"] - anchor).total_seconds() <= f.end and (agg.where is None or holds(agg.where, r))]
    rows.sort(key=lambda r: (r["ts"], r["cid"]))
    if agg.func == "EXISTS":
        return bool(rows)
    if agg.column == "*":
        return float(len(rows))
    vals = [r[agg.column] for r in rows if r[agg.column] is not None]
    return {
        "COUNT": lambda: float(len(vals)), "COUNT_DISTINCT": lambda: float(len(set(vals))), "SUM": lambda: float(sum(vals)), "AVG": lambda: sum(vals) / len(vals) if vals else None,
        "MIN": lambda: min(vals, default=None), "MAX": lambda: max(vals, default=None), "FIRST": lambda: vals[0] if vals else None, "LAST": lambda: vals[-1] if vals else None,
        "LIST_DISTINCT": lambda: list(dict.fromkeys(vals)), "ARRAY_AGG": lambda: vals,
    }[agg.func]()


FRAMES = ["(2 DAYS FOLLOWING)", "(RANGE BETWEEN 12 HOURS FOLLOWING AND 3 DAYS FOLLOWING)", "(RANGE BETWEEN NOW AND UNBOUNDED FOLLOWING)"]
AGGS = ["COUNT(c.*)", "COUNT(c.v)", "SUM(c.v)", "AVG(c.v)", "MIN(c.v)", "MAX(c.v)", "COUNT_DISTINCT(c.tag)", "FIRST(c.tag)", "LAST(c.v)", "EXISTS(c.*)", "LIST_DISTINCT(c.tag)", "ARRAY_AGG(c.v)", "COUNT(c.* WHERE NOT c.tag = 'p')", "SUM(c.v WHERE v > 0 OR tag IS NULL)"]


@pytest.mark.parametrize("own_anchor", [False, True])
def test_aggregates(spark, family, own_anchor):
    from tideline.operators.aggregates import ANCHOR, attach

    catalog, parents, kids = family
    wanted = {f"a{k}": parse(f"PREDICT {a} OVER {f} FROM p").target for k, (a, f) in enumerate(itertools.product(AGGS, FRAMES))}
    cohort, at = catalog.frame("p"), {k: T0 for k, _ in parents}
    if own_anchor:
        at = {k: T0 + (k - 3) * DAY for k, _ in parents}
        cohort = cohort.join(spark.createDataFrame(list(at.items()), f"id long, {ANCHOR} timestamp_ntz"), "id")
    got = attach(cohort, catalog, "p", wanted, None if own_anchor else T0).collect()
    assert len(got) == len(parents)
    for row in got:
        for alias, agg in wanted.items():
            want = aggregate(agg, kids, row["id"], at[row["id"]])
            assert row[alias] == (pytest.approx(want) if isinstance(want, float) else want), (agg, row["id"])


def test_random_cohorts(spark, family):
    catalog, parents, kids = family
    engine, rng = Engine(spark, catalog), random.Random(9)
    for _ in range(12):
        parts = [f"{rng.choice(['COUNT(c.*)', 'SUM(c.v)', 'MAX(c.v)', 'COUNT_DISTINCT(c.tag)'])} OVER ({rng.randint(1, 4)} DAYS PRECEDING) {rng.choice(['>', '<=', '!='])} {rng.randint(0, 3)}" for _ in range(2)]
        parts += ["NOT EXISTS(c.*) OVER (1 DAY PRECEDING)", "size > 2"]
        rng.shuffle(parts)
        text = f"PREDICT COUNT(c.*) FROM p WHERE {rng.choice(['', 'NOT '])}({parts[0]} {rng.choice(['AND', 'OR'])} {parts[1]}) AND {parts[2]} AS OF 2024-01-01"
        where = parse(text).where

        def put(row, node=where):
            return A.rebuild(node, lambda n: A.Lit(aggregate(n, kids, row["id"], T0)) if isinstance(n, A.Agg) else n)

        want = {k for k, size in parents if holds(put({"id": k, "size": size}), {"id": k, "size": size})}
        assert {r["entity_id"] for r in engine.cohort(text).collect()} == want, text


def test_deleting_the_future_changes_nothing(spark, family):
    catalog, _, _ = family
    text = "PREDICT SUM(c.v) OVER (2 DAYS FOLLOWING) FROM p AS OF 2024-01-01"
    cut = Catalog(catalog.schema, {**catalog.frames, "c": catalog.frame("c").where((F.col("ts") <= F.lit("2024-01-01").cast("timestamp_ntz")) | F.col("ts").isNull())})
    rows = [sorted(map(tuple, Engine(spark, c).execute(text, "history").collect())) for c in (catalog, cut)]
    assert rows[0] == rows[1]
    contexts = [sorted((r["entity_id"], r["tbl"], r["row_id"]) for r in Engine(spark, c).assemble_context(text).collect()) for c in (catalog, cut)]
    assert contexts[0] == contexts[1]


def test_hull_reaches_the_scan(spark, sf):
    from tideline.plans.catalogue import A as AT
    from tideline.schema import shop

    df = Engine(spark, shop(spark, sf)).truth(Request(f"PREDICT SUM(orders.o_totalprice) OVER (30 DAYS FOLLOWING) FROM customer WHERE NOT c_custkey > 100 AS OF {AT}"))
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(o_orderdate", plan) and "Or(LessThanOrEqual(c_custkey" in plan
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate", plan)
