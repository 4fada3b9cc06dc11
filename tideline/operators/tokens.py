"""Contexts as typed tokens in long form, and the column statistics that normalise them.

A token is a cell: the target's first, then the past labels', then the context's by (hop, newest, table, row, column). The
entity row's own target columns are left out, so the answer does not leak; keys are never tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lang import ast as A
from ..schema import BOOLEAN, DATETIME, NUMBER, TEXT, Catalog
from .context import MOST_PARENTS  # noqa: F401

#: Codes of the types.
CODES = {NUMBER: 0, TEXT: 1, DATETIME: 2, BOOLEAN: 3}


def column_stats(catalog: Catalog, anchor: object | None) -> DataFrame:
    """(tbl, col, n, mean, std) of number, time and boolean columns as of the anchor; times in seconds, std of the population.
    One pass over each table."""
    parts = []
    for name, spec in catalog.schema.tables.items():
        cols = {c: k for c, k in spec.columns.items() if k != TEXT and c != spec.pk}
        if not cols:
            continue
        df = catalog.bounded(name, anchor)
        numbers = {c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if k == DATETIME else F.col(c).cast("double") for c, k in cols.items()}
        row = df.agg(*(f(x).alias(f"{c}__{n}") for c, x in numbers.items() for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))))
        parts += [row.select(F.lit(name).alias("tbl"), F.lit(c).alias("col"), *(F.col(f"{c}__{x}").alias(x) for x in ("n", "mean", "std"))) for c in cols]
    return reduce(DataFrame.union, parts)


def tokens(context: DataFrame, catalog: Catalog, s: A.Statement, labels: DataFrame | None = None, stats: DataFrame | None = None, max_len: int = 2048) -> DataFrame:
    """(entity_id, pos, kind, tbl, col, code, text, number, z): at most ``max_len`` tokens of each entity.

    ``labels``: (entity_id, k, label double) past labels. ``z`` is the number over the column's mean and deviation, 0 for a
    constant column; without ``stats`` those of the entity's own context.
    """
    kinds = [(t, c, CODES[k]) for t, spec in catalog.schema.tables.items() for c, k in spec.columns.items()]
    types = context.sparkSession.createDataFrame(kinds, "tbl string, col string, code int")
    hidden = {c.name for c in A.columns(s.target)} if s.target is not None else set()
    # the target's token leaves from the entity's first row, so that contexts are made once; their windows are within an entity already
    first = F.row_number().over(Window.partitionBy("entity_id").orderBy("hop", "tbl", "row_id")) == 1
    entry = lambda order, col, text: F.struct(F.lit(order).alias("order"), col.alias("col"), text.alias("text"))
    none = F.lit(None).cast("string")
    held = F.transform(F.map_entries("cells"), lambda x: entry(2, x["key"], x["value"]))
    made = context.withColumn("__first", first).select(
        "entity_id", "hop", "ts", "tbl", "row_id", F.explode(F.concat(F.when(F.col("__first"), F.array(entry(0, F.lit(""), none))).otherwise(F.array()), held)).alias("x"),
    )
    made = made.select("entity_id", "hop", "ts", "tbl", "row_id", F.col("x.order").alias("__order"), F.col("x.col").alias("col"), F.col("x.text").alias("text"))
    target = F.col("__order") == 0
    own = (F.col("tbl") == s.table) & (F.col("row_id") == F.col("entity_id")) & F.col("col").isin(*hidden) if hidden else F.lit(False)
    made = made.where(target | ~own)
    at = {"hop": F.lit(0), "ts": F.lit(None).cast("timestamp_ntz"), "row_id": F.lit(""), "tbl": F.lit(s.table)}
    made = made.withColumns({c: F.when(target, x).otherwise(F.col(c)) for c, x in at.items()}).join(F.broadcast(types), ["tbl", "col"], "left")
    made = made.withColumn("code", F.when(target, F.lit(CODES[NUMBER])).otherwise(F.coalesce("code", F.lit(CODES[TEXT]))))
    number = (
        F.when(F.col("code") == CODES[NUMBER], F.expr("try_cast(text AS double)"))
        .when(F.col("code") == CODES[BOOLEAN], F.expr("try_cast(text AS boolean)").cast("double"))
        .when(F.col("code") == CODES[DATETIME], F.unix_micros(F.expr("try_cast(text AS timestamp)")) / 1e6)
    )
    rows = made.withColumn("number", number).withColumn("kind", F.when(target, F.lit("target")).otherwise(F.lit("cell")))
    if labels is not None:
        past = labels.select(
            F.col("entity_id").cast("string").alias("entity_id"), F.col("k").alias("hop"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("").alias("row_id"), F.lit(s.table).alias("tbl"),
            F.lit("label").alias("col"), F.col("label").cast("string").alias("text"), F.lit(CODES[NUMBER]).alias("code"), F.col("label").cast("double").alias("number"), F.lit("label").alias("kind"), F.lit(1).alias("__order"),
        )
        rows = rows.unionByName(past)
    if stats is None:
        w = Window.partitionBy("entity_id", "tbl", "col")
        rows = rows.withColumn("__m", F.avg("number").over(w)).withColumn("__s", F.stddev_pop("number").over(w))
    else:
        rows = rows.join(F.broadcast(stats.select("tbl", "col", F.col("mean").alias("__m"), F.col("std").alias("__s"))), ["tbl", "col"], "left")
    rows = rows.withColumn("z", F.when(F.col("number").isNotNull(), F.when(F.coalesce("__s", F.lit(0.0)) > 0, (F.col("number") - F.col("__m")) / F.col("__s")).otherwise(0.0)))
    order = Window.partitionBy("entity_id").orderBy("__order", "hop", F.col("ts").desc_nulls_last(), "tbl", "row_id", "col")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < max_len)
    return rows.select("entity_id", "pos", "kind", "tbl", "col", "code", "text", "number", "z")
