"""The statement as a tree of frozen dataclasses. Durations are seconds: a month is 30 days, a year 12 months."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from math import inf, isinf
from typing import Any

#: Seconds of each unit.
UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "YEAR": 31104000}
CALENDAR = {"MONTH", "YEAR"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COUNT_DISTINCT", "LIST_DISTINCT", "ARRAY_AGG", "FIRST", "LAST", "EXISTS")
FUNCTIONS = ("COALESCE", "NULLIF", "ABS", "LOG", "EXP", "LEAST", "GREATEST")


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Items:
    values: tuple


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple
    otherwise: Any = None


@dataclass(frozen=True)
class Frame:
    """(anchor + start, anchor + end], and ``horizons`` of them, ``step`` seconds apart."""

    start: float
    end: float
    horizons: int = 1
    step: float = 0.0
    rank: int | None = None
    implied: bool = False

    @property
    def span(self) -> float | None:
        width = self.end - self.start
        return None if isinf(width) else width

    def shifted(self, seconds: float) -> Frame:
        return replace(self, start=self.start + seconds, end=self.end + seconds, horizons=1, step=0.0)


@dataclass(frozen=True)
class FrameName:
    name: str


@dataclass(frozen=True)
class Agg:
    func: str
    table: str
    column: str
    where: Any = None
    frame: Frame | FrameName | None = None


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Explain:
    mode: str = "PLAN"
    format: str = "TEXT"


@dataclass(frozen=True)
class Statement:
    target: Any
    table: str
    alias: str | None = None
    inferred: bool = False
    classify: bool = False
    where: Any = None
    assuming: Any = None
    as_of: Any = None
    ablate: tuple = ()
    returns: str | None = None
    explain: Explain | None = None
    text: str = field(default="", compare=False)

    @property
    def target_frames(self) -> list[Frame]:
        return [a.frame for a in aggregates(self.target)]

    @property
    def horizons(self) -> int:
        return max([1, *(f.horizons for f in self.target_frames)])

    @property
    def rank(self) -> int | None:
        return next((f.rank for f in self.target_frames if f.rank is not None), None)


def children(node: Any) -> Iterator[Any]:
    if isinstance(node, tuple):
        yield from node
    elif is_dataclass(node) and not isinstance(node, (Lit, Frame, FrameName, Explain)):
        for f in fields(node):
            value = getattr(node, f.name)
            if is_dataclass(value) or isinstance(value, tuple):
                yield value


def walk(node: Any) -> Iterator[Any]:
    """The node and all below it."""
    if not isinstance(node, tuple):
        yield node
    for child in children(node):
        yield from walk(child)


def rebuild(node: Any, change: Callable[[Any], Any]) -> Any:
    """The tree with ``change`` applied to every node, from below."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if not is_dataclass(node):
        return node
    if isinstance(node, (Lit, Frame, FrameName, Explain)):
        return change(node)
    made = {f.name: rebuild(getattr(node, f.name), change) for f in fields(node) if is_dataclass(getattr(node, f.name)) or isinstance(getattr(node, f.name), tuple)}
    return change(replace(node, **made))


def aggregates(node: Any) -> list[Agg]:
    """Distinct aggregates, in order of appearance."""
    return list(dict.fromkeys(x for x in walk(node) if isinstance(x, Agg)))


def columns(node: Any) -> list[Col]:
    """Columns outside aggregates."""
    if isinstance(node, Agg):
        return []
    if isinstance(node, Col):
        return [node]
    return [c for child in children(node) for c in columns(child)]


PAST, FUTURE = Frame(-inf, 0.0, implied=True), Frame(0.0, inf, implied=True)
