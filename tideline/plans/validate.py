"""Binding a statement to a schema: names, parameters, frames' directions, task type and output form."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields, is_dataclass, replace
from math import isinf
from typing import Any

from ..errors import MissingParameter, UnusedParameter, ValidationFault
from ..lang import ast as A
from ..lang.parser import parse
from ..lang.printer import show
from ..schema import BOOLEAN, DATETIME, NUMBER, TEXT, Schema

REGRESSION, BINARY, MULTICLASS, RANKING, FORECASTING = "regression", "binary", "multiclass", "ranking", "forecasting"
#: Task types that each output form goes with.
FORMS = {
    "EXPECTED VALUE": {REGRESSION, FORECASTING, BINARY},
    "PROBABILITY": {BINARY},
    "CLASS": {BINARY, MULTICLASS},
    "DISTRIBUTION": {BINARY, MULTICLASS},
    "MULTILABEL": {RANKING},
    "MULTICLASS": {MULTICLASS},
}
#: Aggregates that may read a foreign key.
READS_KEYS = {"COUNT", "COUNT_DISTINCT", "LIST_DISTINCT", "ARRAY_AGG", "EXISTS"}


@dataclass(frozen=True)
class Bound:
    statement: A.Statement
    task: str
    pk: str
    virtual: bool = False
    notes: tuple[str, ...] = ()

    @property
    def task_id(self) -> str:
        return task_id(self.statement, self.task)


def bind_parameters(s: A.Statement, params: dict[str, Any]) -> A.Statement:
    """Every parameter replaced by its value; a list only where a list can stand."""
    names = {x.name for part in (s.target, s.where, s.assuming, s.as_of) for x in A.walk(part) if isinstance(x, A.Param)}
    if missing := sorted(names - params.keys()):
        raise MissingParameter(f"no value for {', '.join(':' + x for x in missing)}")
    if unused := sorted(params.keys() - names):
        raise UnusedParameter(f"the statement has no {', '.join(':' + x for x in unused)}")

    def many(value: Any) -> bool:
        return isinstance(value, (list, tuple, set, frozenset))

    def change(node: Any) -> Any:
        if isinstance(node, A.Compare) and node.op in ("IN", "NOT IN") and isinstance(node.right, A.Param):
            value = params[node.right.name]
            if not many(value):
                raise ValidationFault(f":{node.right.name} has to be a list")
            return replace(node, right=A.Items(tuple(map(A.Lit, value))))
        return node

    def single(node: Any) -> Any:
        if isinstance(node, A.Param):
            if many(params[node.name]):
                raise ValidationFault(f":{node.name} is a list where one value is wanted")
            return A.Lit(params[node.name])
        return node

    def done(tree: Any) -> Any:
        if tree is None or isinstance(tree, str):
            return tree
        return A.rebuild(_lists(tree, change), single)

    return replace(s, target=done(s.target), where=done(s.where), assuming=done(s.assuming), as_of=done(s.as_of))


def _lists(tree: Any, change: Any) -> Any:
    return A.rebuild(tree, change)


def task_type(s: A.Statement, schema: Schema | None = None) -> str:
    """What kind of prediction a target asks for."""
    t = s.target
    if s.horizons > 1:
        return FORECASTING
    if s.rank is not None:
        return RANKING
    if s.classify:
        return MULTICLASS
    if isinstance(t, (A.Compare, A.And, A.Or, A.Not)):
        return BINARY
    if isinstance(t, A.Lit):
        return BINARY if isinstance(t.value, bool) else REGRESSION
    if isinstance(t, (A.Arith, A.Func, A.Case)):
        return REGRESSION
    if isinstance(t, A.Agg):
        if t.func == "EXISTS":
            return BINARY
        if t.func in ("LIST_DISTINCT", "ARRAY_AGG"):
            return RANKING
        if t.func not in ("FIRST", "LAST"):
            return REGRESSION
    table, name = (t.table, t.column) if isinstance(t, A.Agg) else (t.table, t.name)
    kind = schema.tables[table].columns.get(name) if schema and table in schema.tables else None
    if kind is None:
        return BINARY if isinstance(t, A.Col) else REGRESSION
    return {NUMBER: REGRESSION, DATETIME: REGRESSION, BOOLEAN: BINARY, TEXT: MULTICLASS}[kind]


def canonical(node: Any) -> Any:
    if isinstance(node, tuple):
        return [canonical(x) for x in node]
    if isinstance(node, A.Statement):
        raise TypeError("a statement has no canonical form; its target has")
    if is_dataclass(node):
        return {"node": type(node).__name__, **{f.name: canonical(getattr(node, f.name)) for f in fields(node)}}
    if isinstance(node, float) and isinf(node):
        return "inf" if node > 0 else "-inf"
    return node if node is None or isinstance(node, (bool, int, float, str)) else str(node)


def task_id(s: A.Statement, task: str) -> str:
    """A stable name of the task: a column's own name for a bare column, else a digest of table, target and type."""
    if isinstance(s.target, A.Col) and s.target.table == s.table:
        return f"column:{s.table}.{s.target.name}:{task}"
    text = json.dumps({"table": s.table, "target": canonical(s.target), "task": task}, sort_keys=True, separators=(",", ":"))
    return f"task:{hashlib.sha256(text.encode()).hexdigest()[:16]}"


class Checker:
    def __init__(self, s: A.Statement, schema: Schema) -> None:
        self.s, self.schema = s, schema

    def known(self, table: str, name: str, place: str, keys: bool) -> None:
        spec = self.schema.tables.get(table)
        if spec is None:
            raise ValidationFault(f"unknown table {table} in {place}")
        if name in spec.columns or name == spec.time or (name == spec.pk and place != "an aggregate"):
            return
        if name in self.schema.foreign_keys(table):
            if keys:
                return
            raise ValidationFault(f"{table}.{name} is a foreign key, which {place} cannot use")
        if name == spec.pk:
            raise ValidationFault(f"{table}.{name} is the key, which an aggregate cannot use")
        raise ValidationFault(f"unknown column {table}.{name} in {place}")

    def tree(self, node: Any, place: str) -> None:
        if isinstance(node, A.Agg):
            self.aggregate(node, place)
        elif isinstance(node, A.Col):
            self.known(node.table, node.name, place, keys=False)
            if node.table != self.s.table:
                raise ValidationFault(f"{node.table}.{node.name} has many values for one {self.s.table}; aggregate it")
        else:
            for child in A.children(node):
                self.tree(child, place)

    def aggregate(self, agg: A.Agg, place: str) -> None:
        spec = self.schema.tables.get(agg.table)
        if spec is None:
            raise ValidationFault(f"unknown table {agg.table} in an aggregate")
        if agg.column == "*":
            if agg.func not in ("COUNT", "EXISTS"):
                raise ValidationFault(f"{agg.func} needs a column, not *")
        else:
            self.known(agg.table, agg.column, "an aggregate", agg.func in READS_KEYS)
            kind = spec.columns.get(agg.column)
            if agg.func in ("SUM", "AVG", "MIN", "MAX") and kind not in (NUMBER, BOOLEAN):
                raise ValidationFault(f"{agg.func} needs numbers; {agg.table}.{agg.column} is {kind or 'a time or key'}")
        if agg.frame is not None and not agg.frame.implied and not spec.time:
            raise ValidationFault(f"a frame over {agg.table}, which has no time column")
        for col in A.columns(agg.where) if agg.where is not None else []:
            if col.table != agg.table:
                raise ValidationFault(f"an aggregate's filter reads only {agg.table}, not {col.table}")
            self.known(col.table, col.name, "an aggregate's filter", keys=True)
        if A.aggregates(agg.where):
            raise ValidationFault("an aggregate's filter holds no aggregate")
        frame = agg.frame
        if place == "PREDICT" and frame.start < 0:
            raise ValidationFault(f"the target's frame has to lie in the future: {show(agg)}")
        if place == "WHERE" and frame.end > 0:
            raise ValidationFault(f"a frame in WHERE has to lie in the past: {show(agg)}")
        if place != "PREDICT" and frame.horizons > 1:
            raise ValidationFault(f"HORIZONS belongs to the target, not to {place}")

    def run(self) -> tuple[str, bool]:
        spec = self.schema.tables.get(self.s.table)
        if spec is None:
            raise ValidationFault(f"unknown table {self.s.table}, {'inferred from the target' if self.s.inferred else 'named by FROM'}")
        if not spec.pk:
            raise ValidationFault(f"{self.s.table} has no key and so is no population")
        t = self.s.target
        real = {*spec.columns, *self.schema.foreign_keys(spec.name), spec.pk, spec.time}
        virtual = isinstance(t, A.Col) and t.table == spec.name and t.name not in real
        if not virtual:
            self.tree(t, "PREDICT")
        for place, tree in (("WHERE", self.s.where), ("ASSUMING", self.s.assuming)):
            if tree is not None:
                self.tree_assuming(tree) if place == "ASSUMING" else self.tree(tree, place)
        for name in self.s.ablate:
            if name not in self.schema.tables:
                raise ValidationFault(f"ABLATE names an unknown table {name}")
            if name == self.s.table:
                raise ValidationFault("the population's own table cannot be ablated")
        if any(f.horizons > 1 for f in self.s.target_frames) and len({(f.horizons, f.step) for f in self.s.target_frames}) > 1:
            raise ValidationFault("all frames of a target need the same HORIZONS")
        return spec.pk, virtual

    def tree_assuming(self, node: Any) -> None:
        for agg in A.aggregates(node):
            self.aggregate(agg, "ASSUMING")
        for col in A.columns(node):
            self.known(col.table, col.name, "ASSUMING", keys=False)


def validate(query: str | A.Statement, schema: Schema, params: dict[str, Any] | None = None) -> Bound:
    """A statement bound to ``schema``; with ``params`` its parameters are replaced, without they stay."""
    s = parse(query) if isinstance(query, str) else query
    if params is not None:
        s = bind_parameters(s, params)
    pk, virtual = Checker(s, schema).run()
    task = task_type(s, schema)
    if s.returns is not None and task not in FORMS[s.returns]:
        raise ValidationFault(f"RETURN {s.returns} does not go with a {task} task")
    t = s.target
    if task == RANKING and not (isinstance(t, A.Agg) and t.func in ("LIST_DISTINCT", "ARRAY_AGG")):
        raise ValidationFault("a ranking needs LIST_DISTINCT or ARRAY_AGG")
    notes = ("no RANK TOP: one candidate is returned",) if task == RANKING and s.rank is None else ()
    return Bound(s, task, pk, virtual, notes)
