"""Tokens of a SQL text, white space included, so that a text can be put together again."""

from __future__ import annotations

import re
from dataclasses import dataclass

from fathom.errors import SyntaxFailure

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<op>::|\|\||<>|!=|<=|>=|<<|>>|.)", re.S)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    for m in _TOKEN.finditer(sql):
        if m.start() != at:
            raise SyntaxFailure(f"can't read {sql[at : at + 20]!r}")
        at = m.end()
        if m["op"] in ("'", '"'):
            raise SyntaxFailure("a quote isn't closed")
        out.append(Token(m.lastgroup, m[0]))
    return out


def text(toks: list[Token]) -> str:
    return "".join(t.text for t in toks)


def split_statements(sql: str) -> list[str]:
    """At semicolons outside quotes and comments."""
    parts: list[list[Token]] = [[]]
    for t in tokens(sql):
        if t.text == ";" and t.kind == "op":
            parts.append([])
        else:
            parts[-1].append(t)
    return [s for p in parts if (s := text(p).strip()) and any(t.kind != "space" for t in p)]


def words(toks: list[Token]) -> list[int]:
    """Positions of what isn't white space."""
    return [i for i, t in enumerate(toks) if t.kind != "space"]


def closing(toks: list[Token], at: int) -> int:
    """Position of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(toks)):
        depth += (toks[i].text == "(") - (toks[i].text == ")")
        if depth == 0:
            return i
    raise SyntaxFailure("a parenthesis isn't closed")


def split_args(toks: list[Token]) -> list[list[Token]]:
    """At commas outside parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [] if len(out) == 1 and not text(out[0]).strip() else out
