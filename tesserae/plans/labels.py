"""Small languages of the metadata arguments: tags `a,'b c'` and properties `k:v,'k 2':3`."""

from __future__ import annotations

import re

from tesserae.plans.nodes import QuerySyntaxError
from tesserae.plans.prefix import _NUMBER, _QUOTED, number, unescape

_TAG = re.compile(r"""[^ ,\n\r"']+""")
_WORD = re.compile(r"""[^ ,:\n\r"']+""")


def _string(text: str, i: int, word: re.Pattern) -> tuple[str, int]:
    if m := _QUOTED.match(text, i):
        return unescape(m[0][1:-1]), m.end()
    if m := word.match(text, i):
        return m[0], m.end()
    raise QuerySyntaxError("expected a string", text, i)


def parse_tags(text: str) -> list[str]:
    out, i = [], 0
    while True:
        tag, i = _string(text, i, _TAG)
        out.append(tag)
        if i == len(text):
            return out
        if text[i] != ",":
            raise QuerySyntaxError("expected a comma", text, i)
        i += 1


def parse_properties(text: str) -> dict[str, str | int | float]:
    """Later keys replace earlier ones."""
    out: dict[str, str | int | float] = {}
    i = 0
    while True:
        key, i = _string(text, i, _WORD)
        if text[i : i + 1] != ":":
            raise QuerySyntaxError("expected a colon", text, i)
        i += 1
        n, w = _NUMBER.match(text, i), _WORD.match(text, i)
        if n and w and n.end() >= w.end():
            out[key], i = number(n[0]), n.end()
        else:
            out[key], i = _string(text, i, _WORD)
        if i == len(text):
            return out
        if text[i] != ",":
            raise QuerySyntaxError("expected a comma", text, i)
        i += 1
