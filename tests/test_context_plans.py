"""Contexts read what they can reach, once."""

from __future__ import annotations

from datetime import datetime

import pytest

from tideline.operators import context, tokens
from tideline.plans import catalogue
from tideline.plans.engine import Engine
from tideline.schema import Catalog, shop

AT = datetime(1998, 1, 1)
SMALL = "/root/testdata/sf0.001"


def scans(df, table: str) -> int:
    """How often a plan's leaves name the file of a table."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").count(f"{catalogue_column(table)}#")


def catalogue_column(table: str) -> str:
    return {"orders": "o_custkey", "customer": "c_nationkey"}[table]


def only(spark, *tables: str) -> Catalog:
    """The shop without data for all other tables: to ask for one is an error."""
    whole = shop(spark, SMALL)
    return Catalog(whole.schema, {t: whole.frame(t) for t in tables})


def test_a_hop_reads_no_table_beyond_its_reach(spark):
    near = only(spark, "customer", "nation", "orders", "events")
    made = context.assemble(near.frame("customer"), near, "customer", AT, catalogue.ONE_HOP)
    whole = shop(spark, SMALL)
    every = context.assemble(whole.frame("customer"), whole, "customer", AT, catalogue.ONE_HOP)
    rows = lambda df: sorted(map(str, df.select("entity_id", "tbl", "row_id", "hop", "n_cells", "truncated").collect()))
    assert rows(made) == rows(every)
    assert context.reached(whole, "customer", 2)[2] == {"customer", "lineitem", "region", "supplier"}


@pytest.mark.parametrize("what", ["COUNT(orders.*) OVER (UNBOUNDED PRECEDING) <= 2", "NOT EXISTS(orders.*)"])
def test_an_assumed_count_assembles_contexts_once(spark, what):
    e = Engine(spark, shop(spark, SMALL), policy=catalogue.ONE_HOP)
    plain = e.assemble_context(catalogue.ALL)
    made = e.assemble_context(catalogue.ALL.replace(" AS OF", f" ASSUMING {what} AS OF"))
    assert scans(made, "orders") == scans(plain, "orders")
    assert scans(made, "customer") == scans(plain, "customer")


def test_copies_of_an_assumed_count_come_with_the_rows_that_were_there(spark):
    e = Engine(spark, shop(spark, SMALL), policy=catalogue.ONE_HOP)
    made = e.assemble_context(catalogue.ALL.replace(" AS OF", " ASSUMING COUNT(orders.*) OVER (UNBOUNDED PRECEDING) = 7 AS OF"))
    before = {tuple(r) for r in e.assemble_context(catalogue.ALL).select("entity_id", "tbl", "row_id").collect()}
    after = [tuple(r) for r in made.select("entity_id", "tbl", "row_id").collect()]
    copies = [x for x in after if x[2].startswith("assumed:")]
    assert len(after) == len(set(after)) and set(after) - set(copies) == before
    people = {x[0] for x in before}
    assert {who: sum(x[0] == who and x[1] == "orders" for x in after) for who in people} == dict.fromkeys(people, 7)
    assert all(r["is_focal"] and r["hop"] == 1 and r["parents"]["o_custkey"] == r["entity_id"] for r in made.where("row_id LIKE 'assumed:%'").collect())


def test_tokens_assemble_contexts_once(spark):
    e = Engine(spark, shop(spark, SMALL), policy=catalogue.ONE_HOP)
    p = e.prepare(catalogue.ALL)
    plain = e.assemble_context(p.request)
    made = tokens.tokens(plain, e.catalog, p.statement)
    assert scans(made, "orders") == scans(plain, "orders")
    counts = {r["kind"]: r["n"] for r in made.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert counts["target"] == p.cohort.count() and counts["cell"] == plain.agg({"n_cells": "sum"}).first()[0]


def test_fan_outs_of_every_hop_are_counted(spark):
    """Cut-off children of both hops, against a count by hand: a customer of 1 order of 3, the nation's customers beyond the first."""
    schema = shop(spark, SMALL).schema
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    day = lambda d: datetime(1997, 1, d)
    whole = shop(spark, SMALL)
    catalog = Catalog(schema, {t: whole.frame(t).limit(0) for t in schema.tables} | {
        "nation": frame([(1, "n", 9)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": frame([(1, "a", 1, 0.0, "x"), (2, "b", 1, 0.0, "x")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": frame([(k, 1, "O", 1.0, day(k), "p") for k in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    })
    got = context.assemble(catalog.frame("customer"), catalog, "customer", AT, context.Policy(max_hops=2, bfs_width=1))
    rows = {(r["entity_id"], r["tbl"], r["row_id"], r["hop"], r["truncated"]) for r in got.collect()}
    assert rows == {
        ("1", "customer", "1", 0, 2), ("1", "nation", "1", 1, 2), ("1", "orders", "3", 1, 2),
        ("2", "customer", "2", 0, 1), ("2", "nation", "1", 1, 1), ("2", "customer", "1", 2, 1),
    }
