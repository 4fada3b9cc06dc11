"""Tokens to a Statement: recursive descent, then names and frames are settled."""

from __future__ import annotations

from dataclasses import replace
from math import inf
from typing import Any

from ..errors import SyntaxFault
from . import ast as A
from .lexer import Token, tokens

#: Words that cannot be names; every other keyword can.
RESERVED = {"PREDICT", "FROM", "WHERE", "ASSUMING", "AND", "OR", "NOT"}
CLAUSES = {"WHERE", "ASSUMING", "AS", "ABLATE", "RETURN", "WINDOW", "CLASSIFY", "FROM"}
RETURNS = ("EXPECTED VALUE", "PROBABILITY", "CLASS", "DISTRIBUTION", "MULTILABEL", "MULTICLASS")
SIGNS = {"=": "=", "==": "=", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
MODES = {"PLAN": "PLAN", "CONTEXT": "CONTEXT", "ANALYZE": "ANALYZE", "ABLATION": "ABLATION", "ABLATE": "ABLATION"}


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.k = text, tokens(text), 0
        self.frames: dict[str, A.Frame] = {}

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def fail(self, message: str) -> SyntaxFault:
        found = self.now.text or "the end"
        return SyntaxFault(f"{message}, found {found!r}", self.now.at, self.text)

    def at_words(self, *words: str) -> bool:
        return all(self.ahead(n).kind == "word" and self.ahead(n).key == w for n, w in enumerate(words))

    def take(self) -> Token:
        self.k += 1
        return self.tokens[self.k - 1]

    def words(self, *words: str) -> bool:
        """Take these words if they come next."""
        if not self.at_words(*words):
            return False
        self.k += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.words(*words):
            raise self.fail(f"expected {' '.join(words)}")

    def sign(self, *signs: str) -> str | None:
        return self.take().text if self.now.kind == "sign" and self.now.text in signs else None

    def need_sign(self, sign: str) -> None:
        if not self.sign(sign):
            raise self.fail(f"expected {sign!r}")

    def name(self, what: str) -> str:
        if self.now.kind != "word" or self.now.key in RESERVED:
            raise self.fail(f"expected {what}")
        return self.take().text

    def whole(self, what: str) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int):
            raise self.fail(f"expected a whole number for {what}")
        return self.take().value

    # -- statement

    def statement(self) -> A.Statement:
        explain = self.explain() if self.words("EXPLAIN") else None
        self.need("PREDICT")
        target = self.condition()
        classify = self.words("CLASSIFY")
        table = alias = None
        if self.words("FROM"):
            table = self.name("a table")
            if self.at_words("AS") and not self.at_words("AS", "OF"):
                self.take()
                alias = self.name("an alias")
            elif self.now.kind == "word" and self.now.key not in CLAUSES | RESERVED:
                alias = self.take().text
        found: dict[str, Any] = {"ablate": ()}

        def once(key: str, value: Any) -> None:
            if key in found:
                raise self.fail(f"{key.replace('_', ' ').upper()} is given twice")
            found[key] = value

        while self.now.kind != "end":
            if self.words("WHERE"):
                once("where", self.condition())
            elif self.words("ASSUMING"):
                once("assuming", self.condition())
            elif self.words("AS", "OF"):
                once("as_of", self.moment())
            elif self.words("ABLATE", "TABLE"):
                found["ablate"] += (self.name("a table"),)
            elif self.words("RETURN"):
                once("returns", self.returned())
            elif self.words("WINDOW"):
                name = self.name("a window's name")
                self.need("AS")
                if name in self.frames:
                    raise self.fail(f"window {name} is declared twice")
                self.frames[name] = self.frame()
            else:
                raise self.fail("expected a clause")
        draft = A.Statement(target, table or "", alias, table is None, classify, explain=explain, text=self.text, **found)
        return self.settled(draft)

    def explain(self) -> A.Explain:
        mode, form = "PLAN", "TEXT"
        if self.now.kind == "word" and self.now.key in MODES:
            mode = MODES[self.take().key]
        if self.words("FORMAT"):
            form = self.name("TEXT or JSON").upper()
            if form not in ("TEXT", "JSON"):
                raise self.fail("expected TEXT or JSON")
        return A.Explain(mode, form)

    def moment(self) -> Any:
        if self.now.kind == "param":
            return A.Param(self.take().text[1:])
        if self.now.kind == "date":
            return A.Lit(self.take().value)
        if self.words("NOW"):
            return "NOW"
        raise self.fail("expected a parameter, a date or NOW")

    def returned(self) -> str:
        for form in RETURNS:
            if self.words(*form.split()):
                return form
        if self.now.kind == "word" and self.now.key in ("QUANTILES", "INTERVAL"):
            raise self.fail(f"RETURN {self.now.key} is not available")
        raise self.fail("expected what to return")

    # -- conditions and values

    def condition(self) -> Any:
        parts = [self.conjunction()]
        while self.words("OR"):
            parts.append(self.conjunction())
        return A.Or(tuple(parts)) if len(parts) > 1 else parts[0]

    def conjunction(self) -> Any:
        parts = [self.negation()]
        while self.words("AND"):
            parts.append(self.negation())
        return A.And(tuple(parts)) if len(parts) > 1 else parts[0]

    def negation(self) -> Any:
        return A.Not(self.negation()) if self.words("NOT") else self.predicate()

    def predicate(self) -> Any:
        left = self.sum()
        if op := self.sign(*SIGNS):
            return A.Compare(SIGNS[op], left, self.sum())
        if self.words("IS"):
            if self.words("IN"):
                return A.Compare("IN", left, self.members())
            negated = self.words("NOT")
            self.need("NULL")
            return A.Compare("IS NOT NULL" if negated else "IS NULL", left)
        negated = "NOT " if self.at_words("NOT") and self.ahead().key in ("IN", "LIKE", "CONTAINS") and bool(self.take()) else ""
        if self.words("IN"):
            return A.Compare(negated + "IN", left, self.members())
        for op in ("LIKE", "CONTAINS"):
            if self.words(op):
                return A.Compare(negated + op, left, self.sum())
        for op in ("STARTS WITH", "ENDS WITH"):
            if self.words(*op.split()):
                return A.Compare(op, left, self.sum())
        return left

    def members(self) -> Any:
        if self.now.kind == "param":
            return A.Param(self.take().text[1:])
        self.need_sign("(")
        found = [self.member()]
        while self.sign(","):
            found.append(self.member())
        self.need_sign(")")
        return A.Items(tuple(found))

    def member(self) -> Any:
        value = self.unary()
        if not isinstance(value, (A.Lit, A.Param)):
            raise self.fail("a list holds literals and parameters")
        return value

    def sum(self) -> Any:
        left = self.product()
        while op := self.sign("+", "-"):
            left = A.Arith(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while op := self.sign("*", "/"):
            left = A.Arith(op, left, self.unary())
        return left

    def unary(self) -> Any:
        if not (op := self.sign("+", "-")):
            return self.primary()
        value = self.unary()
        if isinstance(value, A.Lit) and isinstance(value.value, (int, float)) and not isinstance(value.value, bool):
            return A.Lit(-value.value) if op == "-" else value
        return A.Arith("-", A.Lit(0), value) if op == "-" else value

    def primary(self) -> Any:
        token = self.now
        if token.kind in ("number", "string", "date"):
            return A.Lit(self.take().value)
        if token.kind == "param":
            return A.Param(self.take().text[1:])
        if self.sign("("):
            inner = self.condition()
            self.need_sign(")")
            return inner
        if token.kind != "word" or token.key in RESERVED:
            raise self.fail("expected a value")
        call = self.ahead().kind == "sign" and self.ahead().text == "("
        if call and token.key in A.AGGREGATES:
            return self.aggregate()
        if call and token.key in A.FUNCTIONS:
            return self.function()
        if call:
            raise self.fail("no such function")
        if token.key == "CASE" and self.ahead().key == "WHEN":
            return self.case()
        dotted = self.ahead().kind == "sign" and self.ahead().text == "."
        if not dotted and token.key in ("TRUE", "FALSE", "NULL"):
            self.take()
            return A.Lit({"TRUE": True, "FALSE": False, "NULL": None}[token.key])
        first = self.name("a column")
        return A.Col(first, self.name("a column")) if self.sign(".") else A.Col(None, first)

    def function(self) -> A.Func:
        name = self.take().key
        self.need_sign("(")
        args = [self.condition()]
        while self.sign(","):
            args.append(self.condition())
        self.need_sign(")")
        most = {"NULLIF": 2, "ABS": 1, "LOG": 1, "EXP": 1}.get(name, len(args))
        if len(args) != most:
            raise self.fail(f"{name} takes {most} argument{'s' * (most > 1)}")
        return A.Func(name, tuple(args))

    def case(self) -> A.Case:
        self.need("CASE")
        whens = []
        while self.words("WHEN"):
            condition = self.condition()
            self.need("THEN")
            whens.append((condition, self.condition()))
        otherwise = self.condition() if self.words("ELSE") else None
        self.need("END")
        return A.Case(tuple(whens), otherwise)

    def aggregate(self) -> A.Agg:
        func = self.take().key
        self.need_sign("(")
        table = self.name("a table")
        self.need_sign(".")
        column = "*" if self.sign("*") else self.name("a column or *")
        where = self.condition() if self.words("WHERE") else None
        self.need_sign(")")
        frame = None
        if self.words("OVER"):
            frame = self.frame() if self.now.text == "(" else A.FrameName(self.name("a window"))
        return A.Agg(func, table, column, where, frame)

    # -- frames

    def frame(self) -> A.Frame:
        self.need_sign("(")
        rank, implied = None, False
        if self.words("RANK", "TOP"):
            made, rank = A.Frame(0.0, inf), self.whole("RANK TOP")
        else:
            made = self.bounds()
            if self.words("HORIZONS"):
                n = self.whole("HORIZONS")
                if n < 1:
                    raise self.fail("HORIZONS has to be positive")
                step = made.span
                if self.words("STEP"):
                    step = self.duration()[0]
                if n > 1 and made.span is None:
                    raise self.fail("HORIZONS needs finite bounds")
                made = replace(made, horizons=n, step=step or 0.0)
            if self.words("RANK", "TOP"):
                rank = self.whole("RANK TOP")
        if rank is not None and rank < 1:
            raise self.fail("RANK TOP has to be positive")
        self.need_sign(")")
        return replace(made, rank=rank, implied=implied)

    def bounds(self) -> A.Frame:
        if self.words("RANGE"):
            self.need("BETWEEN")
            low, one = self.bound(True)
            self.need("AND")
            high, two = self.bound(False)
            if one and two and (one in A.CALENDAR) != (two in A.CALENDAR):
                raise self.fail("fixed and calendar units cannot be mixed")
        else:
            edge, _ = self.bound(None)
            low, high = (edge, 0.0) if edge < 0 else (0.0, edge)
        if not low < high:
            raise self.fail("a frame's lower bound has to be below its upper bound")
        return A.Frame(low, high)

    def bound(self, lower: bool | None) -> tuple[float, str | None]:
        if lower is not None and self.words("NOW"):
            return 0.0, None
        if self.words("UNBOUNDED"):
            if self.words("PRECEDING"):
                return -inf, None
            if lower is None or not self.words("FOLLOWING"):
                raise self.fail("expected PRECEDING")
            return inf, None
        seconds, unit = self.duration()
        if self.words("PRECEDING"):
            return -seconds, unit
        self.need("FOLLOWING")
        return seconds, unit

    def duration(self) -> tuple[float, str]:
        n = self.whole("a duration")
        key = self.now.key
        unit = key if key in A.UNITS else key.removesuffix("S")
        if self.now.kind != "word" or unit not in A.UNITS:
            raise self.fail("expected a unit of time")
        self.take()
        return float(n * A.UNITS[unit]), unit

    # -- what the clauses mean together

    def settled(self, draft: A.Statement) -> A.Statement:
        if draft.inferred:
            tables = {c.table for c in A.columns(draft.target)}
            if A.aggregates(draft.target) or len(tables) != 1 or None in tables:
                raise SyntaxFault("without FROM the target has to name exactly one table and no aggregate", 0, self.text)
            draft = replace(draft, table=tables.pop())

        def named(node: Any) -> Any:
            if isinstance(node, A.Col):
                table = node.table
                return A.Col(draft.table if table is None or table == draft.alias else table, node.name)
            if isinstance(node, A.Agg):
                return replace(node, table=draft.table if node.table == draft.alias else node.table)
            return node

        def framed(default: A.Frame, node: Any) -> Any:
            if not isinstance(node, A.Agg):
                return node
            if isinstance(node.frame, A.FrameName):
                if node.frame.name not in self.frames:
                    raise SyntaxFault(f"window {node.frame.name} is not declared", 0, self.text)
                return replace(node, frame=self.frames[node.frame.name])
            return replace(node, frame=node.frame or default)

        def inner(node: Any) -> Any:
            """Bare columns inside an aggregate's filter are the aggregated table's."""
            if isinstance(node, A.Agg) and node.where is not None:
                own = node.table
                return replace(node, where=A.rebuild(node.where, lambda x: A.Col(own, x.name) if isinstance(x, A.Col) and x.table is None else x))
            return node

        def done(tree: Any, default: A.Frame) -> Any:
            return None if tree is None else A.rebuild(A.rebuild(A.rebuild(tree, inner), named), lambda n: framed(default, n))

        if isinstance(draft.target, (A.Lit, A.Items)) or not (A.columns(draft.target) or A.aggregates(draft.target)):
            raise SyntaxFault("the target names no table", 0, self.text)
        # an assumption without a frame is about the past, which the context can show
        return replace(draft, target=done(draft.target, A.FUTURE), where=done(draft.where, A.PAST), assuming=done(draft.assuming, A.PAST))


def parse(text: str) -> A.Statement:
    """A statement's syntax tree; a SyntaxFault says where a text stops being one."""
    if not text.strip():
        raise SyntaxFault("an empty statement", 0, text)
    return Parser(text).statement()
