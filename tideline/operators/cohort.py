"""Who a statement is about: the population, its pins, its filter and its anchors."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expressions
from ..lang import ast as A
from ..schema import Catalog
from .aggregates import ANCHOR, all_of, as_parent, attach, bounds, entity_reader, row_reader


def pins(where: Any, entity: str, pk: str) -> list | None:
    """Ids that the filter fixes by ``key = v`` or ``key IN (...)`` under AND, in order and once; None: no pin."""
    if isinstance(where, A.And):
        found = [p for part in where.parts if (p := pins(part, entity, pk)) is not None]
        if not found:
            return None
        rest = [set(p) for p in found[1:]]
        return [x for x in found[0] if all(x in s for s in rest)]
    if isinstance(where, A.Compare) and isinstance(where.left, A.Col) and (where.left.table, where.left.name) == (entity, pk):
        if where.op == "=" and isinstance(where.right, A.Lit) and where.right.value is not None:
            return [where.right.value]
        if where.op == "IN" and isinstance(where.right, A.Items):
            return list(dict.fromkeys(x.value for x in where.right.values if x.value is not None))
    return None


def conjuncts(where: Any) -> list[Any]:
    return [x for p in where.parts for x in conjuncts(p)] if isinstance(where, A.And) else [] if where is None else [where]


def population(catalog: Catalog, entity: str, anchor: datetime | None, per_entity: bool) -> DataFrame:
    """The entity's rows as of the anchor. ``per_entity``: each with its own anchor, its time or the anchor if that is earlier;
    a row without a time has the anchor."""
    df = catalog.bounded(entity, anchor)
    if not per_entity:
        return df
    time = catalog.schema.tables[entity].time
    own = F.col(time).cast("timestamp_ntz") if time else F.lit(None).cast("timestamp_ntz")
    declared = F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz") if anchor else F.lit(None).cast("timestamp_ntz")
    return df.withColumn(ANCHOR, F.least(own, declared))  # least() leaves NULLs out


def existence(agg: Any) -> tuple[A.Agg, bool] | None:
    """(aggregate, wanted) of a condition that is exactly EXISTS or NOT EXISTS."""
    if isinstance(agg, A.Not) and isinstance(agg.part, A.Agg) and agg.part.func == "EXISTS":
        return agg.part, False
    return (agg, True) if isinstance(agg, A.Agg) and agg.func == "EXISTS" else None


def filtered(cohort: DataFrame, catalog: Catalog, entity: str, where: Any, anchor: datetime | None, static_rows: bool = False) -> DataFrame:
    """The cohort rows for which ``where`` holds, on complete data. Existence tests become semi and anti joins; what needs only
    the entity's own columns is applied first, so that it reaches the scan."""
    pk = catalog.schema.tables[entity].pk
    own = Expressions(row_reader(catalog, entity))
    rest = []
    for part in conjuncts(where):
        if A.aggregates(part):
            rest.append(part)
        else:
            cohort = cohort.where(own.filter(part))
    left = []
    for part in rest:
        test = existence(part)
        spec = catalog.schema.tables[test[0].table] if test else None
        if test is None or anchor is None or spec.time is None:
            left.append(part)
            continue
        agg, wanted = test
        link = as_parent(agg, catalog, entity, False)
        rows = catalog.parents(link) if link else catalog.frame(agg.table).withColumn("__parent", F.col(spec.pk))
        inside = bounds(agg.frame, F.col(spec.time), anchor)
        if agg.where is not None:
            inside.append(Expressions(row_reader(catalog, agg.table)).filter(agg.where))
        if agg.column != "*":
            inside.append(F.col(agg.column).isNotNull())
        keys = rows.where(all_of(inside)).select("__parent")
        cohort = cohort.join(keys, cohort[pk] == keys["__parent"], "left_semi" if wanted else "left_anti")
    if left:
        names = {agg: f"__w{k}" for k, agg in enumerate(dict.fromkeys(a for p in left for a in A.aggregates(p)))}
        cohort = attach(cohort, catalog, entity, {n: a for a, n in names.items()}, anchor, static_rows=static_rows)
        test = Expressions(entity_reader(catalog, entity, names))
        cohort = cohort.where(all_of([test.filter(p) for p in left])).drop(*names.values())
    return cohort
