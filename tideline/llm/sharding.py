"""Hilbert-curve sharding: quantise metadata, sort by curve index, cut the order into runs of equal counts.

Every dimension is cut at its own quantiles: numbers by ``percentile_approx``, other types by exact quantiles of their distinct
values in order. The cell's index on the Hilbert curve comes from a table of ``CELLS ** 3`` entries, a fixed size.

Statistics are taken of a narrow table (ids and dimensions, no text). Rows are counted by curve index, and the curve is cut into
runs of about equal weight in rows and bytes, one or two for each shuffle partition; an index beyond that is cut further by a hash. A row's
run follows from its own columns, so texts are shuffled once, each run to its own task; the rank of a row is its place in its run
plus the rows of the runs before it, and shard and slot follow from the rank.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, release, require, written

BITS = 5
CELLS = 1 << BITS


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``coords`` (n rows, d axes of ``bits`` bits).

    Bits are taken from the top. A cell's orthant is read in the frame of the sub-cube that the curve has entered; its
    Gray rank is the next digit, and the frame turns by the entry point and direction of that sub-cube.
    """
    n, d = coords.shape
    mask = (1 << d) - 1
    out, entry, turn = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by % d
        return ((x >> by) | (x << (d - by))) & mask

    for level in range(bits - 1, -1, -1):
        orthant = sum((((coords[:, k] >> level) & 1) << k for k in range(d)), np.zeros(n, np.int64))
        gray = rotate(orthant ^ entry, turn + 1)
        digit = gray.copy()
        shift = 1
        while shift < d:
            digit ^= digit >> shift
            shift <<= 1
        out = (out << d) | digit
        base = np.where(digit == 0, 0, 2 * ((digit - 1) // 2))
        start = base ^ (base >> 1)
        entry ^= rotate(start, d - (turn + 1) % d)
        odd = np.where(digit % 2 == 0, digit - 1, digit)  # the direction: trailing ones of digit - 1 or of digit
        odd = np.where(digit == 0, 0, odd)
        ones = np.zeros(n, np.int64)
        rest = odd.copy()
        for _ in range(d):
            ones += rest & 1
            rest = np.where(rest & 1, rest >> 1, 0)
        turn = (turn + ones % d + 1) % d
    return out


def curve_table(spark: SparkSession) -> DataFrame:
    """(cell, curve) for each of the CELLS ** 3 cells."""
    axes = np.indices((CELLS, CELLS, CELLS)).reshape(3, -1).T
    index = hilbert_index(axes, BITS)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(index)], "cell int, curve int")


def is_number(df: DataFrame, name: str) -> bool:
    kind = dict(df.dtypes)[name]
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def value_of(df: DataFrame, name: str) -> Column:
    """A column as it is ordered: numbers as doubles, the rest as strings by their bytes."""
    return F.col(name).cast("double" if is_number(df, name) else "string")


def string_cuts(narrow: DataFrame, name: str) -> list[str]:
    """The values at the marks k / CELLS of all rows in order of a string column, null left out: at most CELLS - 1 values.

    Distinct values are counted, range-partitioned and given running counts in each part, so neither the distinct values nor
    one value's rows come to one task.
    """
    spark = narrow.sparkSession
    counted = narrow.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ordered = written(counted.repartitionByRange(partitions(spark), "v").withColumn("part", F.spark_partition_id()), "shard-values")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, before, starts = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    if not total:
        return []
    offsets = spark.createDataFrame(starts, "part int, before long")  # a row for each partition
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    spans = ordered.join(F.broadcast(offsets), "part").withColumn("upto", upto)
    first = lambda x: F.floor(x * CELLS / total)
    found = spans.where(first(F.col("upto")) > first(F.col("upto") - F.col("n"))).select("v", "upto").collect()
    release(ordered)
    return sorted(r["v"] for r in found if r["upto"] < total)


def cuts_of(narrow: DataFrame, dims: tuple[str, ...]) -> list[list]:
    numbers = [d for d in dims if is_number(narrow, d)]
    marks = [k / CELLS for k in range(1, CELLS)]
    found = narrow.agg(*(F.percentile_approx(value_of(narrow, d), marks, 10_000).alias(f"q{k}") for k, d in enumerate(numbers)), F.count("*").alias("n")).first()
    quantiles = {d: sorted(set(found[f"q{k}"] or [])) for k, d in enumerate(numbers)}
    return [quantiles[d] if d in quantiles else string_cuts(narrow, d) for d in dims]


def below(edges: Column, value: Column) -> Column:
    """How many of ``edges`` are less than the value."""
    return F.size(F.filter(edges, lambda e: e < value))


@dataclass
class Layout:
    """How the curve is cut: ``curves`` (curve, cuts, run) and the rows before each run; ``total`` rows."""

    curves: list[tuple[int, int, int]]
    before: list[int]
    total: int


def layout(counts: dict[int, tuple[int, float]], within: dict[tuple[int, int], int], hot: dict[int, int], bound: float) -> Layout:
    """Runs of a weight of at most ``bound`` in curve order. ``counts``: rows and weight of each index; ``hot``: into how many
    runs an index is cut, of ``within`` rows each."""
    curves, before, at, filled = [], [0], 0, 0.0
    for curve, (n, weight) in sorted(counts.items()):
        alone = curve in hot
        if at > before[-1] and (alone or filled + weight > bound):
            before.append(at)
            filled = 0.0
        curves.append((curve, hot.get(curve, 1), len(before) - 1))
        if not alone:
            at, filled = at + n, filled + weight
            continue
        for k in range(hot[curve]):
            at += within.get((curve, k), 0)
            before.append(at)
    return Layout(curves, before, at)


def shard(
    docs: DataFrame, n_shards: int = 16, dims: tuple[str, str, str] = ("source", "lang", "size"),
    id_col: str = "doc_id", text_col: str | None = "text",
) -> DataFrame:
    """``docs`` with curve, size, shard and slot columns; law ``rows``: shard counts differ by one at most.

    ``size`` is the UTF-8 length of the text plus 1 (null: 1); with no ``text_col``, ``docs`` brings it. Ranks order by curve
    index, then id (null first; within an index of very many rows by a hash of id and dimensions first), then a hash of all
    columns; rows with one id, or none, get different slots. Columns of ``docs`` named size, curve, shard or slot are replaced;
    names that start with two underscores are reserved. Null metadata sorts first. An empty table gives an empty result. Rows
    come out in files that are runs of the curve.
    """
    require(docs, id_col, text_col or "size", *(d for d in dims if d != "size"))
    spark = docs.sparkSession
    base = docs.drop("curve", "shard", "slot")
    if text_col:
        base = base.withColumn("size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)
    narrow = written(base.select(id_col, *dict.fromkeys(d for d in (*dims, "size") if d != id_col)), "shard-rows")
    cuts = cuts_of(narrow, dims)

    def cell(df: DataFrame) -> Column:
        out = F.lit(0)
        for name, edges in zip(dims, cuts, strict=True):
            value = value_of(df, name)
            kind = "double" if is_number(df, name) else "string"
            place = below(F.array(*map(F.lit, edges)).cast(f"array<{kind}>"), value)
            # 0 is for null, which sorts first; equal values have one place
            out = out * CELLS + F.when(value.isNull(), 0).otherwise(place)
        return out.cast("int")

    at = narrow.withColumn("__cell", cell(narrow)).join(F.broadcast(curve_table(spark)).withColumnRenamed("cell", "__cell"), "__cell")
    found = at.groupBy("curve").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # CELLS ** 3 rows at most
    rows, size = (max(1, sum(r[x] or 0 for r in found)) for x in ("n", "size"))
    counts = {r["curve"]: (r["n"], r["n"] / rows + (r["size"] or 0) / size) for r in found}
    bound = 2 / partitions(spark, docs)
    hot = {c: min(n, ceil(w / bound)) for c, (n, w) in counts.items() if w > bound and n > 1}
    deal = F.xxhash64(*dict.fromkeys([id_col, *dims]))
    within: dict[tuple[int, int], int] = {}
    if hot:  # of a weight of 2 in all, so at most 2 / bound of them in 4 / bound pieces
        shares = spark.createDataFrame(sorted(hot.items()), "curve int, k int")
        pieces = at.join(F.broadcast(shares), "curve").groupBy("curve", F.pmod(deal, F.col("k")).cast("int").alias("piece")).agg(F.count("*").alias("n"))
        within = {(r["curve"], r["piece"]): r["n"] for r in pieces.collect()}
    release(narrow)
    plan = layout(counts, within, hot, bound)

    n_runs = len(plan.before)
    runs = spark.createDataFrame(plan.curves, "curve int, __k int, __first int").join(F.broadcast(curve_table(spark)), "curve").withColumnRenamed("cell", "__cell")
    starts = spark.createDataFrame(list(enumerate(plan.before)), "__run int, __before long")
    row_hash = F.xxhash64(*(c for c, kind in base.dtypes if "map<" not in kind))
    placed = base.withColumn("__cell", cell(base)).join(F.broadcast(runs), "__cell").withColumn("__run", (F.col("__first") + F.pmod(deal, F.col("__k"))).cast("int"))
    dealt = placed.withColumn("__tie", row_hash).drop("__cell", "__k", "__first").repartitionById(max(1, n_runs), F.col("__run"))
    place = F.row_number().over(Window.partitionBy("__run").orderBy("curve", F.col(id_col).asc_nulls_first(), "__tie"))
    total = max(1, plan.total)
    return (
        dealt.withColumn("__place", place)
        .join(F.broadcast(starts), "__run")
        .withColumn("__rank", F.col("__before") + F.col("__place") - 1)
        .withColumn("__shard", F.expr(f"(__rank * {n_shards}) div {total}"))
        .withColumn("slot", F.col("__rank") - F.expr(f"(__shard * {total} + {n_shards - 1}) div {n_shards}"))
        .withColumn("shard", F.col("__shard").cast("int"))
        .drop("__run", "__before", "__place", "__rank", "__shard", "__tie")
    )
