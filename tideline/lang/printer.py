"""A tree back to text that parses to the same tree."""

from __future__ import annotations

from datetime import datetime
from math import inf
from typing import Any

from . import ast as A


def show(node: Any) -> str:
    match node:
        case A.Lit(value):
            if value is None or isinstance(value, bool):
                return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
            if isinstance(value, datetime):
                return value.strftime("%Y-%m-%d %H:%M:%S")
            return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'" if isinstance(value, str) else format(value)
        case A.Items(values):
            return f"({', '.join(map(show, values))})"
        case A.Param(name):
            return f":{name}"
        case A.Col(table, name):
            return f"{table}.{name}" if table else name
        case A.Arith(op, left, right):
            return f"({show(left)} {op} {show(right)})"
        case A.Func(name, args):
            return f"{name}({', '.join(map(show, args))})"
        case A.Case(whens, otherwise):
            tail = "" if otherwise is None else f" ELSE {show(otherwise)}"
            return "CASE " + " ".join(f"WHEN {show(c)} THEN {show(v)}" for c, v in whens) + tail + " END"
        case A.Agg(func, table, column, where, frame):
            inner = "" if where is None else f" WHERE {show(where)}"
            over = "" if frame is None or frame.implied else f" OVER {show_frame(frame)}"
            return f"{func}({table}.{column}{inner}){over}"
        case A.Compare(op, left, None):
            return f"({show(left)} {op})"
        case A.Compare(op, left, right):
            return f"({show(left)} {op} {show(right)})"
        case A.And(parts):
            return "(" + " AND ".join(map(show, parts)) + ")"
        case A.Or(parts):
            return "(" + " OR ".join(map(show, parts)) + ")"
        case A.Not(part):
            return f"(NOT {show(part)})"
    raise TypeError(f"cannot print {node!r}")


def show_frame(frame: A.Frame) -> str:
    def edge(x: float) -> str:
        if x in (inf, -inf):
            return "UNBOUNDED " + ("FOLLOWING" if x > 0 else "PRECEDING")
        return "NOW" if x == 0 else f"{abs(int(x))} SECONDS {'FOLLOWING' if x > 0 else 'PRECEDING'}"

    out = f"RANGE BETWEEN {edge(frame.start)} AND {edge(frame.end)}"
    if frame.horizons > 1:
        out += f" HORIZONS {frame.horizons} STEP {int(frame.step)} SECONDS"
    return f"({out}{f' RANK TOP {frame.rank}' if frame.rank else ''})"


def show_statement(s: A.Statement) -> str:
    out = [f"EXPLAIN {s.explain.mode} FORMAT {s.explain.format}"] if s.explain else []
    out += [f"PREDICT {show(s.target)}", *["CLASSIFY"] * s.classify, f"FROM {s.table}"]
    out += [f"{word} {show(x)}" for word, x in (("WHERE", s.where), ("ASSUMING", s.assuming)) if x is not None]
    if s.as_of is not None:
        out.append("AS OF " + (s.as_of if isinstance(s.as_of, str) else show(s.as_of)))
    out += [f"ABLATE TABLE {t}" for t in s.ablate]
    return " ".join(out + ([f"RETURN {s.returns}"] if s.returns else []))
