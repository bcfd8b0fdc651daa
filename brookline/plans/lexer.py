"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

PATTERN = re.compile(
    r"""(?P<space>[ \t\r\n]+|--[^\n]*)
      | (?P<number>\d+\.\d+|\d+)
      | (?P<string>"[^"\n]*")
      | (?P<param>\$[A-Za-z_]\w*)
      | (?P<word>[A-Za-z_]\w*)
      | (?P<mark>\|>|\|\||&&|==|!=|<=|>=|[<>!+\-*/=(){}\[\],:.])""",
    re.VERBOSE | re.ASCII,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number string param word mark end
    text: str
    line: int
    col: int

    @property
    def pos(self) -> tuple[int, int]:
        return self.line, self.col


def tokenize(source: str) -> list[Token]:
    out, at, line, begin = [], 0, 1, 0
    while at < len(source):
        found = PATTERN.match(source, at)
        if not found:
            raise QueryError(f"unexpected character {source[at]!r}", "InvalidToken", "parse", "query", line, at - begin + 1)
        if found.lastgroup != "space":
            out.append(Token(found.lastgroup, found[0], line, at - begin + 1))
        if breaks := found[0].count("\n"):
            line += breaks
            begin = at + found[0].rindex("\n") + 1
        at = found.end()
    out.append(Token("end", "", line, at - begin + 1))
    return out
