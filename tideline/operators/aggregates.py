"""Window aggregates relative to an anchor, one pass over a child table for all of them.

With one anchor for all entities the child is cut to the hull of the frames (literals, so they reach the Parquet scan),
grouped by its foreign key with conditional aggregates, and the small result is left-joined to the cohort. Aggregating before
the join keeps the shuffle to one partial row for each key and task. With an anchor for each entity the cohort's keys and
anchors are joined to the child by key and range first.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from math import isinf
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvaluationFault, ExecutionFault
from ..functions.expressions import ARRAY, Expressions, literal
from ..lang import ast as A
from ..schema import BOOLEAN, DATETIME, NUMBER, TEXT, Catalog, Link, value_type

ANCHOR = "__anchor"
#: Bounds of a frame beyond any calendar count as open.
OPEN = 86400 * 366 * 9000


def moved(anchor: datetime | Column, seconds: float) -> Column:
    if isinstance(anchor, datetime):
        return literal(anchor + timedelta(seconds=seconds))
    return anchor + F.make_dt_interval(secs=F.lit(float(seconds)))


def bounds(frame: A.Frame, time: Column, anchor: datetime | Column) -> list[Column]:
    """start < time - anchor <= end; a row without a time is in no frame."""
    low = [] if isinf(frame.start) else [time > moved(anchor, frame.start)]
    high = [] if isinf(frame.end) else [time <= moved(anchor, frame.end)]
    return low + high or [time.isNotNull()]


def all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def row_reader(catalog: Catalog, table: str, prefix: str = ""):
    """Columns of the table's own rows, for filters inside an aggregate."""
    spec, schema = catalog.schema.tables[table], catalog.frame(table).schema

    def read(node: Any) -> tuple[Column, str | None, bool]:
        if isinstance(node, A.Agg):
            raise EvaluationFault("an aggregate inside an aggregate's filter")
        kind = spec.columns.get(node.name) or value_type(schema[node.name].dataType)
        return F.col(prefix + node.name), kind, isinstance(schema[node.name].dataType, (T.DoubleType, T.FloatType))

    return read


def as_parent(agg: A.Agg, catalog: Catalog, entity: str, strict: bool) -> Link | None:
    """The link from the aggregated table to the entity; None: the entity's own rows."""
    found = catalog.schema.links_between(agg.table, entity)
    if not found:
        if agg.table == entity:
            return None
        raise ExecutionFault(f"{agg.table} has no direct link to {entity}")
    if strict and len(found) > 1:
        raise ExecutionFault(f"{agg.table} has several links to {entity}; labels need exactly one")
    return found[0]


def measure(agg: A.Agg, inside: Column, time: Column | None, ties: list[str], kind: str | None) -> Column:
    """The aggregate over rows where ``inside`` holds."""
    if agg.func == "EXISTS":
        inside = inside if agg.column == "*" else inside & F.col(agg.column).isNotNull()
        return F.coalesce(F.max(F.coalesce(inside, F.lit(False))), F.lit(False))
    if agg.column == "*":
        return F.count(F.when(inside, F.lit(1))).cast("double")
    v = F.col(agg.column)
    if agg.func == "COUNT":
        return F.count(F.when(inside, v)).cast("double")
    if agg.func == "COUNT_DISTINCT":
        return F.count_distinct(F.when(inside, v)).cast("double")
    number = F.when(inside, v.cast("double"))
    if agg.func == "SUM":
        return F.coalesce(F.sum(number), F.lit(0.0))
    if agg.func in ("AVG", "MIN", "MAX"):
        return {"AVG": F.avg, "MIN": F.min, "MAX": F.max}[agg.func](number)
    there = inside & v.isNotNull()
    key = F.struct(*([time.alias("__t")] if time is not None else []), *(F.col(c).alias(f"__k{k}") for k, c in enumerate(ties)))
    if agg.func in ("FIRST", "LAST"):
        pick = F.min_by if agg.func == "FIRST" else F.max_by
        return pick(F.when(there, v), F.when(there, key))
    rows = F.array_sort(F.collect_list(F.when(there, F.struct(key.alias("k"), v.alias("v")))))
    values = F.transform(rows, lambda x: x["v"])
    return F.array_distinct(values) if agg.func == "LIST_DISTINCT" else values


def default_of(agg: A.Agg, col: Column) -> Column:
    """What an entity without a row gets."""
    if agg.func in ("COUNT", "SUM", "COUNT_DISTINCT"):
        return F.coalesce(col, F.lit(0.0))
    if agg.func == "EXISTS":
        return F.coalesce(col, F.lit(False))
    return F.coalesce(col, F.array()) if agg.func in ("LIST_DISTINCT", "ARRAY_AGG") else col


def result_type(agg: A.Agg, catalog: Catalog) -> tuple[str | None, bool]:
    if agg.func == "EXISTS":
        return BOOLEAN, False
    if agg.func in ("LIST_DISTINCT", "ARRAY_AGG"):
        return ARRAY, False
    if agg.func in ("FIRST", "LAST"):
        return value_type(catalog.frame(agg.table).schema[agg.column].dataType), True
    return NUMBER, agg.func in ("SUM", "AVG", "MIN", "MAX")


def attach(
    cohort: DataFrame, catalog: Catalog, entity: str, requests: dict[str, A.Agg], anchor: datetime | None,
    strict: bool = False, static_rows: bool = False,
) -> DataFrame:
    """``cohort`` with a column for each request. ``anchor`` None: each row's own, in its column ``__anchor``.

    ``static_rows``: rows of a table without a time column count in implied frames; else they are in no frame.
    """
    if not requests:
        return cohort
    pk = catalog.schema.tables[entity].pk
    groups: dict[tuple[str, Link | None], dict[str, A.Agg]] = {}
    for alias, agg in requests.items():
        groups.setdefault((agg.table, as_parent(agg, catalog, entity, strict)), {})[alias] = agg
    for (table, link), wanted in groups.items():
        spec = catalog.schema.tables[table]
        rows = catalog.parents(link) if link else catalog.frame(table).withColumn("__parent", F.col(spec.pk))
        time = F.col(spec.time) if spec.time else None
        ties = catalog.order_of(table)
        condition = Expressions(row_reader(catalog, table))
        if anchor is None and ANCHOR in cohort.columns:
            keys = cohort.select(F.col(pk).alias("__parent"), ANCHOR).distinct()
            rows = rows.join(keys, "__parent")
            at: datetime | Column = F.col(ANCHOR)
        elif anchor is None:
            raise ExecutionFault("an aggregate needs an anchor: AS OF, or anchor_time")
        else:
            at = anchor
        if time is not None:
            frames = [a.frame for a in wanted.values()]
            hull = A.Frame(min(f.start for f in frames), max(f.end for f in frames))
            rows = rows.where(all_of(bounds(hull, time, at)))
        measures = []
        for alias, agg in wanted.items():
            if time is None:
                inside = [F.lit(static_rows and agg.frame.implied)]
            else:
                inside = bounds(agg.frame, time, at)
            if agg.where is not None:
                inside.append(condition.filter(agg.where))
            kind = spec.columns.get(agg.column)
            measures.append(measure(agg, all_of(inside), time, ties, kind).alias(alias))
        by = ["__parent", ANCHOR] if anchor is None else ["__parent"]
        found = rows.groupBy(*by).agg(*measures)
        if anchor is None:
            found = found.withColumnsRenamed({"__parent": pk})
            cohort = cohort.join(found, [pk, ANCHOR], "left")
        else:
            cohort = cohort.join(found, cohort[pk] == found["__parent"], "left").drop("__parent")
        cohort = cohort.withColumns({alias: default_of(agg, F.col(alias)) for alias, agg in wanted.items()})
    return cohort


def value_counts(cohort: DataFrame, catalog: Catalog, entity: str, aggs: list[A.Agg], anchor: datetime | None) -> DataFrame:
    """(entity_id, v, n, in_windows): for each of the aggregates' values how many rows hold it, and in how many of their frames.
    The aggregates differ in their frames alone. Rows are counted by entity and value before they meet the cohort."""
    agg, pk = aggs[0], catalog.schema.tables[entity].pk
    link = as_parent(agg, catalog, entity, strict=True)
    spec = catalog.schema.tables[agg.table]
    rows = catalog.parents(link) if link else catalog.frame(agg.table).withColumn("__parent", F.col(spec.pk))
    keys = cohort.select(F.col(pk).alias("__parent"), *([ANCHOR] if anchor is None else []))
    time, at = F.col(spec.time), F.col(ANCHOR) if anchor is None else anchor
    if agg.where is not None:
        rows = rows.where(Expressions(row_reader(catalog, agg.table)).filter(agg.where))
    if anchor is None:
        rows = rows.join(keys, "__parent")
    hull = A.Frame(min(a.frame.start for a in aggs), max(a.frame.end for a in aggs))
    rows = rows.where(all_of(bounds(hull, time, at))).where(F.col(agg.column).isNotNull())
    inside = [all_of(bounds(a.frame, time, at)).cast("int") for a in aggs]
    n = sum(inside[1:], inside[0])
    counted = rows.groupBy("__parent", F.col(agg.column).alias("v")).agg(F.sum(n).alias("n"), *(F.max(x).alias(f"__i{k}") for k, x in enumerate(inside))).where("n > 0")
    windows = sum((F.col(f"__i{k}") for k in range(1, len(inside))), F.col("__i0"))
    found = counted if anchor is None else counted.join(keys, "__parent", "left_semi")
    return found.select(F.col("__parent").alias("entity_id"), "v", "n", windows.alias("in_windows"))


def entity_reader(catalog: Catalog, entity: str, names: dict[A.Agg, str]):
    """Columns of the cohort: the entity's own, and the attached aggregates."""
    own = row_reader(catalog, entity)

    def read(node: Any) -> tuple[Column, str | None, bool]:
        if isinstance(node, A.Agg):
            return F.col(names[node]), *result_type(node, catalog)
        return own(node)

    return read
