"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from ..errors import SyntaxFault

PIECES = re.compile(
    r"""(?P<gap>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<date>\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2})?(?![\w.]))
      | (?P<number>\d+(?:\.\d+)?(?![\w]))
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      | (?P<param>:[A-Za-z_]\w*)
      | (?P<word>[A-Za-z_]\w*)
      | (?P<sign>==|!=|>=|<=|[=<>()+\-*/,.])""",
    re.VERBOSE | re.DOTALL,
)
#: Escapes in strings beside the doubled quote; any other escaped character stands for itself.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: Any
    at: int

    @property
    def key(self) -> str:
        return self.text.upper()


def unquoted(text: str) -> str:
    quote, inner = text[0], text[1:-1]
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), inner.replace(quote * 2, quote), flags=re.DOTALL)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = PIECES.match(text, at)
        if m is None:
            raise SyntaxFault(f"unexpected {text[at]!r}", at, text)
        kind, piece = m.lastgroup, m.group()
        if kind == "date":
            try:
                value: Any = datetime.fromisoformat(piece.replace(" ", "T"))
            except ValueError:
                raise SyntaxFault(f"no such date: {piece}", at, text) from None
        elif kind == "number":
            value = float(piece) if "." in piece else int(piece)
        elif kind == "string":
            value = unquoted(piece)
        else:
            value = piece
        if kind != "gap":
            found.append(Token(kind, piece, value, at))
        at = m.end()
    return [*found, Token("end", "", None, len(text))]
