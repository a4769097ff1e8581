"""Surface terms that both parsers give, and the predicates they are lowered to."""

from __future__ import annotations

from dataclasses import dataclass

Literal = str | int | float


class QuerySyntaxError(ValueError):
    """A query that can't be parsed; `pos` is a character offset."""

    def __init__(self, message: str, query: str, pos: int, kind: str = "syntax") -> None:
        super().__init__(f"{message} at {pos}\n{query}\n{' ' * pos}^")
        self.pos, self.kind = pos, kind


class StringRangeError(ValueError):
    """The infix dialect has no order on strings."""


@dataclass(frozen=True)
class Value:
    value: Literal


@dataclass(frozen=True)
class Keyed:
    key: str
    op: str  # eq gt gte lt lte
    value: Literal


@dataclass(frozen=True)
class BBox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class StartsWith:
    field: str
    prefix: str


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Literal


@dataclass(frozen=True)
class Contains:
    field: str
    value: Literal


@dataclass(frozen=True)
class ElemExists:
    """Some element of `field` has this value, under any key."""

    field: str
    value: Literal


@dataclass(frozen=True)
class ElemCompare:
    """Some element of `field` has this key and a value for which `op` holds."""

    field: str
    key: str
    op: str
    value: Literal
    strict: bool = False


@dataclass(frozen=True)
class Text:
    """Full text: one word, or words in a row."""

    text: str


def flat(kind: type, parts: list) -> object:
    """`kind` over parts, without a wrapper around a single one."""
    return parts[0] if len(parts) == 1 else kind(tuple(parts))
