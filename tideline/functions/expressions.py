"""Trees to columns under two-valued logic.

A comparison with NULL is false, not unknown, and NOT turns it into true. In a filter a positive leaf may stay as it is,
since a filter drops NULL; so NOT is pushed down to the leaves, whose complement is the opposite comparison or NULL. Both
forms reach a Parquet scan. Where a boolean is a value, NULL is made false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EvaluationFault
from ..lang import ast as A
from ..schema import BOOLEAN, DATETIME, NUMBER, TEXT

ARRAY = "ARRAY"
OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "=": "!=", "!=": "="}

#: (column, type, may be NaN) of a reference.
Reader = Callable[[Any], tuple[Column, str | None, bool]]


def literal_type(value: Any) -> str | None:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, (datetime, date)):
        return DATETIME
    return TEXT if isinstance(value, str) else None


def literal(value: Any) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


class Expressions:
    """Compiles trees; ``read`` gives the column of a Col or Agg."""

    def __init__(self, read: Reader) -> None:
        self.read = read

    # -- values

    def value(self, node: Any) -> tuple[Column, str | None, bool]:
        match node:
            case A.Lit(v):
                return literal(v), literal_type(v), isinstance(v, float) and v != v
            case A.Col() | A.Agg():
                return self.read(node)
            case A.Param(name):
                raise EvaluationFault(f":{name} has no value")
            case A.Arith(op, left, right):
                a, b = self.number(left), self.number(right)
                made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()
                return made, NUMBER, True
            case A.Func(name, args):
                return self.function(name, args)
            case A.Case(whens, otherwise):
                return self.case(whens, otherwise)
            case A.Compare() | A.And() | A.Or() | A.Not():
                return self.truth(node), BOOLEAN, False
        raise EvaluationFault(f"no value: {node!r}")

    def number(self, node: Any) -> Column:
        """As a double; booleans are 1 and 0, and what is no number is NULL."""
        col, kind, _ = self.value(node)
        return col.cast("double") if kind in (NUMBER, BOOLEAN) else F.lit(None).cast("double")

    def function(self, name: str, args: tuple) -> tuple[Column, str | None, bool]:
        if name == "COALESCE":
            return self.same_type(args, lambda cols: F.coalesce(*cols))
        if name == "NULLIF":
            _, kind, nan = self.value(args[0])
            first, second = self.alike(args)
            return F.when(self.compare("=", A.Func("__", ()), None, (first, kind, nan), (second, kind, nan))[0], F.lit(None)).otherwise(first), kind, nan
        numbers = [self.number(a) for a in args]
        if name in ("LEAST", "GREATEST"):
            real = [F.when(~F.isnan(x), x) for x in numbers]
            return (real[0] if len(real) == 1 else getattr(F, name.lower())(*real)), NUMBER, False
        x = numbers[0]
        if name == "ABS":
            return F.abs(x), NUMBER, True
        if name == "LOG":
            return F.when(x > 0, F.ln(x)), NUMBER, True
        return F.exp(x), NUMBER, True

    def alike(self, args: tuple) -> list[Column]:
        """The arguments' columns, numbers and booleans together as doubles."""
        found = [self.value(a) for a in args]
        kinds = {k for _, k, _ in found if k is not None}
        if len(kinds) > 1 and kinds <= {NUMBER, BOOLEAN}:
            return [self.number(a) for a in args]
        if len(kinds) > 1:
            raise EvaluationFault(f"values of different types: {', '.join(sorted(kinds))}")
        if kinds == {NUMBER}:
            return [c.cast("double") for c, _, _ in found]
        return [c for c, _, _ in found]

    def same_type(self, args: tuple, make: Callable[[list[Column]], Column]) -> tuple[Column, str | None, bool]:
        kinds = {k for _, k, _ in map(self.value, args) if k is not None}
        kind = kinds.pop() if len(kinds) == 1 else NUMBER if kinds else None
        return make(self.alike(args)), kind, kind == NUMBER

    def case(self, whens: tuple, otherwise: Any) -> tuple[Column, str | None, bool]:
        values = tuple(v for _, v in whens) + ((otherwise,) if otherwise is not None else ())

        def make(cols: list[Column]) -> Column:
            out = F.when(self.truth(whens[0][0]), cols[0])
            for (condition, _), col in zip(whens[1:], cols[1:]):
                out = out.when(self.truth(condition), col)
            return out.otherwise(cols[len(whens)]) if otherwise is not None else out

        return self.same_type(values, make)

    # -- conditions

    def filter(self, node: Any, negate: bool = False) -> Column:
        """For a filter: true where the condition holds (or, negated, where it does not); else false or NULL."""
        match node:
            case A.Not(part):
                return self.filter(part, not negate)
            case A.And(parts) | A.Or(parts):
                cols = [self.filter(p, negate) for p in parts]
                both = isinstance(node, A.And) != negate
                out = cols[0]
                for c in cols[1:]:
                    out = out & c if both else out | c
                return out
            case A.Compare(op, left, right):
                pos, neg = self.leaf(op, left, right)
                return neg if negate else pos
            case A.Lit(v):
                return F.lit(bool(v) != negate)
        col, kind, nan = self.value(node)
        pos = self.true_value(col, kind)
        return ~F.coalesce(pos, F.lit(False)) if negate else pos

    def truth(self, node: Any) -> Column:
        return F.coalesce(self.filter(node), F.lit(False))

    @staticmethod
    def true_value(col: Column, kind: str | None) -> Column:
        if kind == BOOLEAN:
            return col
        if kind == NUMBER:
            return col != 0
        if kind == TEXT:
            return F.length(col) > 0
        return F.size(col) > 0 if kind == ARRAY else col.isNotNull()

    def leaf(self, op: str, left: Any, right: Any) -> tuple[Column, Column]:
        """(condition, its complement)."""
        if op in ("IS NULL", "IS NOT NULL"):
            col = self.value(left)[0]
            pos, neg = col.isNull(), col.isNotNull()
            return (pos, neg) if op == "IS NULL" else (neg, pos)
        if op in ("IN", "NOT IN"):
            return self.member(op, left, right)
        if op in OPPOSITE:
            return self.compare(op, left, right, self.value(left), self.value(right))
        return self.text(op, left, right)

    def member(self, op: str, left: Any, right: Any) -> tuple[Column, Column]:
        col, kind, nan = self.value(left)
        if not isinstance(right, A.Items):
            raise EvaluationFault("IN needs a list")
        values = [x.value for x in right.values if x.value is not None]
        if kind in (NUMBER, BOOLEAN):
            col = col.cast("double") if kind == BOOLEAN else col
            values = [v for v in values if literal_type(v) in (NUMBER, BOOLEAN)]
            values = [float(v) if isinstance(v, bool) or kind == BOOLEAN else v for v in values]
        else:
            values = [v for v in values if literal_type(v) == kind]
        inside = col.isin(*map(literal, values)) if values else F.lit(False)
        if op == "IN":
            return inside, (~inside | col.isNull()) if values else F.lit(True)
        return (~inside & col.isNotNull()), (inside | col.isNull())

    def compare(self, op: str, left: Any, right: Any, a: tuple, b: tuple) -> tuple[Column, Column]:
        (x, kx, nan_x), (y, ky, nan_y) = a, b
        if isinstance(right, A.Lit) and right.value is None:
            if op == "=":
                return F.lit(False), F.lit(True)
            if op == "!=":
                return x.isNotNull(), x.isNull()
            raise EvaluationFault(f"{op} NULL has no answer; use IS NULL")
        if kx != ky and None not in (kx, ky):
            if {kx, ky} <= {NUMBER, BOOLEAN}:
                x, y = x.cast("double"), y.cast("double")
            elif op == "=":
                return F.lit(False), F.lit(True)
            elif op == "!=":
                return x.isNotNull(), x.isNull()
            else:
                raise EvaluationFault(f"{kx} and {ky} cannot be compared with {op}")
        test = {"=": lambda o: x == y, "!=": lambda o: x != y, ">": lambda o: x > y, ">=": lambda o: x >= y, "<": lambda o: x < y, "<=": lambda o: x <= y}
        pos, neg = test[op](None), test[OPPOSITE[op]](None)
        for col, kind, nan in ((x, kx, nan_x), (y, ky, nan_y)):
            if kind == NUMBER and nan:  # NaN is in no order and unequal to all
                odd = F.isnan(col.cast("double"))
                pos, neg = (pos | odd, neg & ~odd) if op == "!=" else (pos & ~odd, neg | odd)
        if not isinstance(right, A.Lit) and op == "!=":  # unlike a NULL on the left, one on the right is unequal to a value
            return pos | (x.isNotNull() & y.isNull()), neg | x.isNull()
        for node, col in ((left, x), (right, y)):
            if not isinstance(node, A.Lit):
                neg = neg | col.isNull()
        return pos, neg

    def text(self, op: str, left: Any, right: Any) -> tuple[Column, Column]:
        negated, base = op.startswith("NOT "), op.removeprefix("NOT ")
        col, kind, _ = self.value(left)
        if not isinstance(right, A.Lit) or not isinstance(right.value, str):
            if not (kind == ARRAY and isinstance(right, A.Lit)):
                raise EvaluationFault(f"{op} needs a text")
        what = right.value
        if kind == ARRAY:
            if base != "CONTAINS":
                raise EvaluationFault(f"{op} does not apply to a list")
            inside = F.array_contains(col, literal(what))
        else:
            text = col if kind == TEXT else col.cast("string")
            if base == "LIKE":
                inside = text.rlike(like_pattern(what))
            else:
                inside = {"CONTAINS": text.contains, "STARTS WITH": text.startswith, "ENDS WITH": text.endswith}[base](what)
        if negated:
            return (~inside & col.isNotNull()), (inside | col.isNull())
        return inside, (~inside | col.isNull())


def like_pattern(pattern: str) -> str:
    """A Java pattern: case does not count, ``%`` and ``_`` stop at line ends, all else stands for itself."""
    body = "".join({"%": ".*", "_": "."}.get(c) or (re.escape(c) if c.isascii() and not c.isalnum() and c != "_" else c) for c in pattern)
    return r"(?iu)\A" + body + r"\z"
