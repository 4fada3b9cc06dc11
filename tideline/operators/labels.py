"""What a target is worth at an anchor: the truth, its horizons, and the labels of past windows."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ARRAY, Expressions
from ..lang import ast as A
from ..schema import BOOLEAN, Catalog
from .aggregates import attach, entity_reader


def shifted(target: Any, seconds: float) -> Any:
    """The target with its frames moved."""
    return A.rebuild(target, lambda n: replace(n, frame=n.frame.shifted(seconds)) if isinstance(n, A.Agg) else n)


def horizon_shifts(target: Any) -> list[float]:
    frames = [a.frame for a in A.aggregates(target)]
    frame = max(frames, key=lambda f: f.horizons, default=None)
    return [k * frame.step for k in range(frame.horizons)] if frame else [0.0]


def span_of(target: Any) -> float | None:
    """Seconds between the windows that past labels come from: the width of the first bounded frame."""
    return next((a.frame.span for a in A.aggregates(target) if a.frame.span is not None), None)


def history_shifts(target: Any, windows: int) -> list[float]:
    span = span_of(target)
    return [] if span is None else [-k * span for k in range(1, windows + 1)]


def with_targets(
    cohort: DataFrame, catalog: Catalog, entity: str, target: Any, anchor: datetime | None, shifts: dict[str, float], static_rows: bool = False,
) -> DataFrame:
    """``cohort`` with a column for each named shift of the target; all shifts share one pass over each child table."""
    trees = {name: shifted(target, s) for name, s in shifts.items()}
    names = {agg: f"__t{k}" for k, agg in enumerate(dict.fromkeys(a for t in trees.values() for a in A.aggregates(t)))}
    cohort = attach(cohort, catalog, entity, {n: a for a, n in names.items()}, anchor, strict=True, static_rows=static_rows)
    compiled = Expressions(entity_reader(catalog, entity, names))
    return cohort.withColumns({name: compiled.value(tree)[0] for name, tree in trees.items()}).drop(*names.values())


def target_type(catalog: Catalog, entity: str, target: Any) -> str | None:
    names = {agg: "x" for agg in A.aggregates(target)}
    return Expressions(entity_reader(catalog, entity, names)).value(target)[1]


def as_number(col: Column, kind: str | None) -> Column:
    if kind == BOOLEAN:
        return F.coalesce(col, F.lit(False)).cast("double")
    return F.size(col).cast("double") if kind == ARRAY else col.cast("double")


def mean_of(cols: list[Column]) -> Column:
    """The mean of the values that are there; NULL if none is."""
    there = F.array_compact(F.array(*cols))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def long_labels(wide: DataFrame, pk: str, names: list[str]) -> DataFrame:
    """(entity_id, k, label) of a table of labels, k from 1."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(n).alias("label")) for k, n in enumerate(names, 1))))
    return wide.select(F.col(pk).alias("entity_id"), pairs.alias("x")).select("entity_id", "x.k", "x.label")
