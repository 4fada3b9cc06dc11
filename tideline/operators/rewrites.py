"""Counterfactual contexts: tables ablated, counts assumed, columns assigned. WHERE comes before all of these."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExecutionFault
from ..functions.expressions import literal
from ..lang import ast as A
from ..schema import Catalog
from .aggregates import all_of, bounds
from .cohort import conjuncts

MIRROR = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "=": "="}


def ablate(context: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    return context.where(~F.col("tbl").isin(*tables)) if tables else context


def drop_column(context: DataFrame, table: str, column: str) -> DataFrame:
    """Without the cells of one column."""
    cells = F.when(F.col("tbl") == table, without(column)).otherwise(F.col("cells"))
    return context.withColumn("cells", cells).withColumn("n_cells", F.size("cells").cast("long"))


def split(assuming: Any, entity: str) -> tuple[list[tuple[A.Agg, str, int]], list[tuple[str, str, Any]]]:
    """(bounds on counts, assignments) of an ASSUMING clause; what cannot be built is refused."""
    counts, assigned = [], []
    for part in conjuncts(assuming):
        negated = isinstance(part, A.Not)
        inner = part.part if negated else part
        if isinstance(inner, A.Agg):
            if inner.func != "EXISTS":
                raise ExecutionFault("ASSUMING takes COUNT bounds and EXISTS")
            counts.append((inner, "=" if negated else ">=", 0 if negated else 1))
            continue
        if negated or not isinstance(part, A.Compare):
            raise ExecutionFault("ASSUMING takes AND of assignments, COUNT bounds and EXISTS")
        left, op, right = part.left, part.op, part.right
        if isinstance(right, A.Agg) and isinstance(left, A.Lit) and op in MIRROR:
            left, op, right = right, MIRROR[op], left
        if isinstance(left, A.Col):
            if op != "=" or not isinstance(right, A.Lit):
                raise ExecutionFault("a column can only be assumed equal to a value")
            assigned.append((left.table, left.name, right.value))
        elif isinstance(left, A.Agg) and left.func == "COUNT" and op in MIRROR and isinstance(right, A.Lit):
            n = right.value
            if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n < 0:
                raise ExecutionFault("a count can only be assumed against a whole number that is not negative")
            if op == "<" and n == 0:
                raise ExecutionFault("no count is below 0")
            counts.append((left, op, int(n)))
        else:
            raise ExecutionFault(f"ASSUMING cannot build this: {part.op}")
    for agg, _, _ in counts:
        if agg.where is not None:
            raise ExecutionFault("a filtered count cannot be assumed")
        if agg.table == entity:
            raise ExecutionFault("a count of the population's own table cannot be assumed")
    return counts, assigned


def without(column: str) -> Column:
    return F.map_filter("cells", lambda k, _: k != column)


def assign(context: DataFrame, entity: str, assigned: list[tuple[str, str, Any]]) -> DataFrame:
    """Cells set to values: on the entity's own row, or on every row of another table. NULL takes the cell away."""
    for table, column, value in assigned:
        where = F.col("tbl") == table
        if table == entity:
            where = where & (F.col("row_id") == F.col("entity_id"))
        rest = without(column)
        made = rest if value is None else F.map_concat(rest, F.create_map(F.lit(column), literal(value).cast("string")))
        context = context.withColumn("cells", F.when(where, made).otherwise(F.col("cells")))
    return context.withColumn("n_cells", F.size("cells").cast("long")) if assigned else context


def assume_count(context: DataFrame, catalog: Catalog, entity: str, n: int, agg: A.Agg, op: str, bound: int, anchor: datetime | None) -> DataFrame:
    """Contexts in which the entity's own rows of a table in the frame number as assumed.

    Missing ones are copies of the newest row in the frame, else of the entity's newest, else of the newest in the context, else
    of the newest in the database, a second apart before the frame's end; of too many the oldest go.
    """
    if anchor is None:
        raise ExecutionFault("assuming a count needs an anchor")
    table = agg.table
    link = next(iter(catalog.schema.links_between(table, entity)), None)
    time = catalog.schema.tables[table].time
    mine = (F.col("tbl") == table) & F.col("is_focal")
    usable = F.lit(True) if agg.column == "*" else F.map_contains_key("cells", F.lit(agg.column))
    inside = mine & usable & all_of(bounds(agg.frame, F.col("ts"), anchor))
    keys = ["entity_id", "anchor_ts"]
    most_rows = {"=": bound, "<=": bound, "<": bound - 1}.get(op)
    if most_rows is not None:
        order = Window.partitionBy(*keys, "__inside").orderBy(F.col("ts").desc_nulls_last(), "row_id")
        ranked = context.withColumn("__inside", F.coalesce(inside, F.lit(False))).withColumn("__n", F.row_number().over(order))
        context = ranked.where(~F.col("__inside") | (F.col("__n") <= most_rows)).select(*context.columns)
    want = {">=": bound, ">": bound + 1, "=": bound}.get(op, 0)
    if not want:
        return context
    # what is copied is found by windows within an entity, as contexts are partitioned, and copies leave from the entity's first row
    each = Window.partitionBy(*keys)
    newest = F.struct(F.coalesce("ts", literal(datetime(1, 1, 1))).alias("t"), "row_id")
    found = {
        x: F.max_by(F.when(w & usable, F.struct("cells", "parents", "hop", "row_id")), F.when(w & usable, newest)).over(each)
        for x, w in (("__in", inside), ("__own", mine), ("__any", F.col("tbl") == table))
    }
    counted = context.withColumns({"__c": F.count(F.when(inside, 1)).over(each), **found, "__first": F.row_number().over(each.orderBy("hop", "tbl", "row_id")) == 1})
    from .context import nodes

    stored = nodes(catalog, table).where(usable & (F.col("ts").isNull() | (F.col("ts") <= literal(anchor))))
    pick = stored.agg(F.max_by(F.struct("cells", "parents", F.lit(1).alias("hop"), "row_id"), newest).alias("__db"))
    counted = counted.join(F.broadcast(pick))  # one row
    short = F.col("__first") & (F.col("__c") < want)
    counted = counted.withColumn("__from", F.when(short, F.coalesce("__in", "__own", "__any", "__db")))
    high = anchor if agg.frame.end in (float("inf"),) else anchor + timedelta(seconds=agg.frame.end)
    most = float("inf") if agg.frame.start == float("-inf") else (high - anchor).total_seconds() - agg.frame.start
    failed = F.col("__from").isNull() | (want - F.col("__c") >= F.lit(most))
    message = F.lit(f"no row of {table} to copy, or the frame is too narrow for the assumed count")
    places = F.when(short, F.when(failed, F.raise_error(message).cast("array<int>")).otherwise(F.sequence(F.lit(1), (want - F.col("__c")).cast("int"))))
    # place 0 is the row itself
    made = counted.withColumn("__i", F.explode(F.concat(F.array(F.lit(0)), F.coalesce(places, F.array().cast("array<int>")))))
    ts = literal(high) - F.make_dt_interval(secs=F.col("__i").cast("double"))
    cells = F.col("__from.cells")
    if time:
        cells = F.transform_values(cells, lambda k, v: F.when(k == time, ts.cast("string")).otherwise(v))
    parents = F.col("__from.parents")
    if link:
        own = F.create_map(F.lit(link.fk), F.col("entity_id"))
        parents = F.map_concat(F.map_filter(parents, lambda k, _: k != link.fk), own)
    copy = {
        "tbl": F.lit(table), "row_id": F.concat(F.lit(f"assumed:{table}:{n}:"), F.col("__i")), "hop": F.col("__from.hop"), "ts": ts, "is_focal": F.lit(True),
        "cells": cells, "parents": parents, "n_cells": F.size(cells).cast("long"), "truncated": F.lit(0).cast("long"),
    }
    return made.select(*(F.when(F.col("__i") == 0, F.col(c)).otherwise(copy[c]).alias(c) if c in copy else F.col(c) for c in context.columns))


def rewritten(context: DataFrame, catalog: Catalog, s: A.Statement, anchor: datetime | None) -> DataFrame:
    """Ablations, then assumed counts, then assignments."""
    context = ablate(context, s.ablate)
    if s.assuming is None:
        return context
    counts, assigned = split(s.assuming, s.table)
    for n, (agg, op, bound) in enumerate(counts):
        context = assume_count(context, catalog, s.table, n, agg, op, bound, anchor)
    return assign(context, s.table, assigned)


def inert(catalog: Catalog, s: A.Statement, context: DataFrame) -> list[str]:
    """Warnings about assumptions that change nothing."""
    if s.assuming is None:
        return []
    counts, assigned = split(s.assuming, s.table)
    out = [f"{t}.{c} is no declared feature: assuming it changes no cell" for t, c, _ in assigned if c not in catalog.schema.tables[t].columns]
    present = {r["tbl"] for r in context.select("tbl").distinct().collect()}
    out += [f"no context holds a row of {t}: assuming {t}.{c} changes nothing" for t, c, _ in assigned if t not in present]
    return out + [f"the count of {a.table} is assumed and {a.table} is ablated" for a, _, _ in counts if a.table in s.ablate]
