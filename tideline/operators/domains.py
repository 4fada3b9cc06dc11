"""What was known at an anchor: running totals over time, for entities that have an anchor each.

Totals are made in two steps, by day and within a day, so that no task holds more than a day of one group's rows, or all days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Catalog
from .aggregates import ANCHOR


def time_of(catalog: Catalog, table: str) -> Column:
    spec = catalog.schema.tables[table]
    return F.col(spec.time).cast("timestamp_ntz") if spec.time else F.lit(None).cast("timestamp_ntz")


def anchors_of(cohort: DataFrame) -> DataFrame:
    return cohort.select(ANCHOR).distinct()


def totals_at(rows: DataFrame, anchors: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(``__anchor``, by, sums): totals of ``rows`` (``__t``, by, sums) whose time is not after the anchor, or missing.

    A null anchor sees all rows. Groups without a row by an anchor are left out.
    """
    grouped = rows.groupBy("__t", *by).agg(*(F.sum(x).alias(x) for x in sums))
    dated = grouped.where("__t is not null").select(F.col("__t").alias("__at"), *by, *sums, F.lit(False).alias("__ask"))
    static = grouped.where("__t is null").groupBy(*by).agg(*(F.sum(x).alias(f"{x}__0") for x in sums))
    groups = rows.select(*by).distinct() if by else None
    asked = anchors.where(F.col(ANCHOR).isNotNull()).select(F.col(ANCHOR).alias("__at"))
    asked = (asked.crossJoin(F.broadcast(groups)) if groups is not None else asked).select("__at", *by, *(F.lit(0).alias(x) for x in sums), F.lit(True).alias("__ask"))
    both = dated.unionByName(asked).withColumn("__day", F.date_trunc("DAY", "__at"))
    days = both.groupBy("__day", *by).agg(*(F.sum(x).alias(f"{x}__d") for x in sums))
    before = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({f"{x}__d": F.coalesce(F.sum(f"{x}__d").over(before), F.lit(0)) for x in sums})
    inside = Window.partitionBy("__day", *by).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = both.withColumns({x: F.sum(x).over(inside) for x in sums}).where("__ask").join(days, ["__day", *by])
    total = {x: F.col(x) + F.col(f"{x}__d") for x in sums}
    out = upto.select(F.col("__at").alias(ANCHOR), *by, *(c.alias(x) for x, c in total.items()))
    everything = rows.groupBy(*by).agg(*(F.sum(x).alias(x) for x in sums))
    timeless = anchors.where(F.col(ANCHOR).isNull()).join(F.broadcast(everything)).select(ANCHOR, *by, *sums)
    joined = out.join(static, by, "left") if by else out.join(F.broadcast(static))
    out = joined.select(ANCHOR, *by, *((F.col(x) + F.coalesce(f"{x}__0", F.lit(0))).alias(x) for x in sums)).unionByName(timeless)
    return out


def class_counts(catalog: Catalog, table: str, column: str, anchors: DataFrame, most: int) -> DataFrame:
    """(``__anchor``, class, n): the classes known at each anchor, the first ``most`` in byte order."""
    rows = catalog.frame(table).where(F.col(column).isNotNull()).select(time_of(catalog, table).alias("__t"), F.col(column).cast("string").alias("class"), F.lit(1).cast("long").alias("n"))
    # classes beyond the first ones of the whole table can only come into a domain where an earlier one is not yet known
    found = totals_at(rows, anchors, ["class"], ["n"]).where("n > 0")
    place = F.row_number().over(Window.partitionBy(ANCHOR).orderBy("class"))
    return found.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def candidates_at(catalog: Catalog, table: str, key: str, anchors: DataFrame, most: int) -> DataFrame:
    """(``__anchor``, candidate): the first ``most`` keys of the table's rows known at each anchor."""
    rows = catalog.frame(table).select(F.col(key).alias("candidate"), time_of(catalog, table).alias("__t"))
    if catalog.schema.tables[table].time is None:
        return anchors.join(F.broadcast(rows.select("candidate").orderBy("candidate").limit(most)))  # most rows
    known = anchors.join(rows, F.col("__t").isNull() | F.col(ANCHOR).isNull() | (F.col("__t") <= F.col(ANCHOR)))
    place = F.row_number().over(Window.partitionBy(ANCHOR).orderBy("candidate"))
    return known.withColumn("__n", place).where(F.col("__n") <= most).select(ANCHOR, "candidate")
