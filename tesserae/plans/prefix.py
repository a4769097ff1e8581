"""The prefix dialect: `AND(GTE(size 10) EQ(brand "x"))`; terms side by side are OR-ed."""

from __future__ import annotations

import re

from tesserae.model import INT64_MAX, INT64_MIN
from tesserae.plans.nodes import And, BBox, Keyed, Not, Or, QuerySyntaxError, Value, flat

_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)")
_QUOTED = re.compile(r""""(?:\\.|[^"\\\n\r])*"|'(?:\\.|[^'\\\n\r])*'""")
_WORD = re.compile(r"""[^ \n\r"'()]+""")
_SPACE = re.compile(r"[ \n\r]+")
_FLOAT = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
_BOX = re.compile(rf"(?:([a-zA-Z]+:\d+):)?({_FLOAT})\s*,\s*({_FLOAT})\s*,\s*({_FLOAT})\s*,\s*({_FLOAT})")
LOGICAL, COMPARE = ("AND", "OR", "NOT"), ("EQ", "GTE", "GT", "LTE", "LT")
#: The escapes of a Java string literal.
JAVA_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) and INT64_MIN <= int(text) <= INT64_MAX else float(text)


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] == "u":
            return chr(int(x.lstrip("u"), 16))
        return chr(int(x, 8)) if x.isdigit() else JAVA_ESCAPES.get(x, x)

    return re.sub(r"\\(u+[0-9a-fA-F]{4}|[0-3]?[0-7]{1,2}|.)", one, body)


def tokens(query: str) -> list[tuple[str, object, int]]:
    """(kind, value, position); the longest match wins, a number before a word of its length."""
    out, i = [], 0
    while i < len(query):
        if query[i] in "()":
            out.append((query[i], None, i))
            i += 1
        elif m := _SPACE.match(query, i):
            out.append(("ws", None, i))
            i = m.end()
        elif query[i] in "\"'":
            if not (m := _QUOTED.match(query, i)):
                raise QuerySyntaxError("unterminated string", query, i)
            out.append(("str", unescape(m[0][1:-1]), i))
            i = m.end()
        else:
            word, num = _WORD.match(query, i), _NUMBER.match(query, i)
            if num and num.end() >= word.end():
                out.append(("num", number(num[0]), i))
            else:
                out.append(("kw" if word[0] in LOGICAL + COMPARE else "str", word[0], i))
            i = word.end()
    return out


def parse(query: str) -> object:
    """The surface tree; None for an empty query, which matches everything."""
    toks, i = tokens(query), 0

    def fail(what: str) -> None:
        raise QuerySyntaxError(what, query, toks[i][2] if i < len(toks) else len(query))

    def kind(k: int = 0) -> str:
        return toks[i + k][0] if i + k < len(toks) else "end"

    def skip() -> bool:
        nonlocal i
        before = i
        while kind() == "ws":
            i += 1
        return i > before

    def take(what: str) -> object:
        nonlocal i
        if kind() not in what.split("|"):
            fail(f"expected {what}")
        i += 1
        return toks[i - 1][1]

    def terms(closing: str) -> list:
        skip()
        found = [term()]
        while skip() and kind() != closing:
            found.append(term())
        if kind() != closing:
            fail(f"expected {closing}")
        return found

    def term() -> object:
        if kind() in ("num", "str"):
            return leaf(take("num|str"))
        word = take("kw")
        skip()
        take("(")
        if word in LOGICAL:
            parts = terms(")")
            take(")")
            return flat(And, parts) if word == "AND" else flat(Or, parts) if word == "OR" else Not(flat(Or, parts))
        skip()
        key = take("str")
        if not skip():
            fail("expected white space")
        value = take("num|str")
        skip()
        take(")")
        return Keyed(key, word.lower(), value)

    return flat(Or, terms("end")) if query.strip(" \r\n") else None


def leaf(value: object) -> object:
    """A bare value; one that looks like a box is only ever a box."""
    if isinstance(value, str) and (m := _BOX.fullmatch(value)):
        x1, y1, x2, y2 = map(float, m.groups()[1:])
        if m[1]:
            from tesserae.functions.crs import to_wgs84

            (x1, y1), (x2, y2) = to_wgs84(m[1], [(x1, y1), (x2, y2)])
        return BBox(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))
    return Value(value)
