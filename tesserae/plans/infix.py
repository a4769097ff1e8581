"""The infix dialect: `size >= 10 && !(bbox(8, 49, 9, 50) || "word")`."""

from __future__ import annotations

import regex

from tesserae.model import INT64_MAX, INT64_MIN
from tesserae.plans.nodes import And, BBox, Keyed, Not, Or, QuerySyntaxError, Value

_TOKENS = [
    ("or", regex.compile(r"(?i)\s+or(?=\s)|\|\|")),
    ("and", regex.compile(r"(?i)\s+and(?=\s)|&&")),
    ("not", regex.compile(r"!\s*\(")),
    ("neq", regex.compile(r"!={1,2}")),
    ("eq", regex.compile(r"={1,2}")),
    ("gte", regex.compile(r">=")),
    ("gt", regex.compile(r">")),
    ("lte", regex.compile(r"<=")),
    ("lt", regex.compile(r"<")),
    ("(", regex.compile(r"\(")),
    (")", regex.compile(r"\)")),
    (",", regex.compile(r",")),
    ("str", regex.compile(r'"([^"\\]|\\.)*"', regex.S)),
    ("quoted", regex.compile(r"`([^`\\]|\\.)*`", regex.S)),
    ("num", regex.compile(r"-?(\d+\.\d*|\d*\.\d+|\d+)([eE][+-]?\d*)?")),
    ("id", regex.compile(r"[_\p{L}][_\p{L}\d-]*")),
]
#: The one-letter escapes of a JSON string.
JSON_ESCAPES = {"\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = regex.compile(r"\\(?:u(?P<code>[[:xdigit:]]{4})|u(?P<short>[[:xdigit:]]*)|(?P<letter>.))", regex.S)
OPS = ("neq", "eq", "gte", "gt", "lte", "lt")


def unescape(query: str, start: int, end: int, quote: str) -> str:
    """The text between two quotes; errors point at the character that is wrong."""
    letters = JSON_ESCAPES | {quote: quote}

    def meant(m: regex.Match) -> str:
        if m["code"]:
            if 0xD800 <= (code := int(m["code"], 16)) < 0xE000:
                raise QuerySyntaxError("half of a surrogate pair", query, start + m.start(), "code_point")
            return chr(code)
        if m["short"] is not None:
            raise QuerySyntaxError("four hexadecimal digits are needed", query, start + m.end(), "hex_digit")
        if m["letter"] not in letters:
            raise QuerySyntaxError("no such escape", query, start + m.start("letter"), "escape")
        return letters[m["letter"]]

    return _ESCAPE.sub(meant, query[start:end])


def tokens(query: str) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(query):
        found = [(m.end(), -k, name) for k, (name, r) in enumerate(_TOKENS) if (m := r.match(query, i)) and m.end() > i]
        if found:
            end, _, name = max(found)
            out.append((name, i, end))
            i = end
        elif query[i].isspace():
            i += 1
        else:
            raise QuerySyntaxError("invalid token", query, i, "token")
    return out


def parse(query: str) -> object:
    """The surface tree. An empty query is an error in this dialect."""
    toks, i = tokens(query), 0
    if not toks:
        raise QuerySyntaxError("query must not be empty", query, 0, "empty")

    def peek(k: int = 0) -> str:
        return toks[i + k][0] if i + k < len(toks) else "end"

    def fail(what: str) -> None:
        raise QuerySyntaxError(what, query, toks[i][1] if i < len(toks) else len(query), "unexpected")

    def take(*kinds: str) -> tuple[str, int, int]:
        nonlocal i
        if peek() not in kinds:
            fail(f"expected {' or '.join(kinds)}")
        i += 1
        return toks[i - 1]

    def number() -> int | float:
        _, s, e = take("num")
        text = query[s:e]
        try:
            v = int(text)
            return v if INT64_MIN <= v <= INT64_MAX else float(text)
        except ValueError:
            try:
                return float(text)
            except ValueError:
                raise QuerySyntaxError("invalid number", query, s, "invalid_number") from None

    def literal() -> str | int | float:
        if peek() == "num":
            return number()
        _, s, e = take("str", "num")
        return unescape(query, s + 1, e - 1, '"')

    def chain(kind: str, make: type, below: object) -> object:
        parts = [below()]
        if isinstance(parts[0], make) and peek() == kind and grouped.get(id(parts[0])):
            parts = [*parts[0].parts]
        while peek() == kind:
            take(kind)
            parts.append(below())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    grouped: dict[int, object] = {}

    def any_of() -> object:
        return chain("or", Or, all_of)

    def all_of() -> object:
        return chain("and", And, one)

    def one() -> object:
        if peek() in ("id", "quoted"):
            kind, s, e = take("id", "quoted")
            name = query[s:e] if kind == "id" else unescape(query, s + 1, e - 1, "`")
            if kind == "id" and name.lower() in ("bbox", "rect") and peek() == "(":
                return box()
            op = take(*OPS)[0]
            value = literal()
            return Not(Keyed(name, "eq", value)) if op == "neq" else Keyed(name, op, value)
        if peek() == "not":
            take("not")
            part = any_of()
            take(")")
            return Not(part)
        if peek() == "(":
            take("(")
            part = any_of()
            take(")")
            grouped[id(part)] = part
            return part
        return Value(literal())

    def box() -> BBox:
        take("(")
        found = [float(number())]
        for _ in range(3):
            take(",")
            found.append(float(number()))
        take(")")
        x1, y1, x2, y2 = found
        return BBox(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))

    part = any_of()
    if peek() != "end":
        fail("unexpected token")
    return part
