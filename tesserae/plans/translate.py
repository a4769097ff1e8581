"""Predicates to native Spark columns: no UDFs, NULL-safe complements, range columns that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import LETTERS, words
from tesserae.plans.lower import ADDRESS_NAMES, FEATURE_ID_NAMES, GML_ID_NAMES
from tesserae.plans.nodes import All, And, BBox, Compare, Contains, ElemCompare, ElemExists, Not, Or, StartsWith, Text

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
#: Keys that other columns can answer too: a range column over attributes alone would lose rows.
ELSEWHERE = {*GML_ID_NAMES, *FEATURE_ID_NAMES, *ADDRESS_NAMES, "correlationId"}


def index_name(key: str, part: str) -> str:
    """Name of a range column of an indexed field; part: min, max (numbers), smin, smax (strings)."""
    return f"ix_{key}_{part}"


def index_columns(fields: list[str]) -> dict[str, Column]:
    """Least and greatest value by field, over attributes and properties, for row-group pruning."""
    out = {}
    for key in fields:
        found = _of_key(key)
        numbers = F.transform(found, lambda e: F.coalesce(e["d"], e["l"].cast("double")))
        strings = F.transform(found, lambda e: e["s"])
        for part, c in (("min", F.array_min(numbers)), ("max", F.array_max(numbers)), ("smin", F.array_min(strings)), ("smax", F.array_max(strings))):
            out[index_name(key, part)] = c
    return out


def _of_key(key: str) -> Column:
    return F.filter(F.concat("attrs", "props"), lambda e: e["key"] == key)


def holds(e: Column, op: str, v: object, strict: bool) -> Column:
    """op between a tagged element and a literal. Strict: of the literal's own type; else numbers compare across types."""
    f = OPS[op]
    if isinstance(v, str):
        return (e["t"] == "s") & f(e["s"], F.lit(v))
    if isinstance(v, int):
        own = (e["t"] == "l") & f(e["l"], F.lit(v).cast("bigint"))
        return own if strict else own | (e["t"] == "d") & f(e["d"], F.lit(float(v)))
    own = (e["t"] == "d") & f(e["d"], F.lit(v))
    return own if strict else own | (e["t"] == "l") & f(e["l"].cast("double"), F.lit(v))


def pruning(key: str, op: str, v: object) -> Column:
    """A necessary condition over the range columns, in a form that Parquet statistics can answer."""
    low, high = ("smin", "smax") if isinstance(v, str) else ("min", "max")
    x = F.lit(v if isinstance(v, str) else float(v))
    least, most = F.col(f"`{index_name(key, low)}`") <= x, F.col(f"`{index_name(key, high)}`") >= x
    return {"eq": least & most, "gt": most, "gte": most, "lt": least, "lte": least}[op]


def in_text(found: list[str]) -> Column:
    """A word or a phrase, looked for in the raw text. Only where a word too long to count may stand inside a phrase, the
    words themselves are made."""
    low = F.lower(F.col("text"))
    between = rf"[^{LETTERS}]+"
    direct = reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in sorted(set(found)))) & low.rlike(rf"(?<![{LETTERS}]){between.join(found)}(?![{LETTERS}])")
    if len(found) == 1:
        return direct
    long = low.rlike(rf"[{LETTERS}]{{10,}}{between}{found[-1]}(?![{LETTERS}])") & reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in found))
    return direct | long & F.contains(F.col("text_norm"), F.lit(f" {' '.join(found)} "))


def to_column(p: object, indexed: frozenset[str] = frozenset(), raw: bool = False) -> Column:
    """The filter for a predicate tree. `indexed`: fields for which `documents` has range columns; `raw`: it has texts."""
    match p:
        case All():
            return F.lit(True)
        case And(parts):
            return reduce(lambda a, b: a & b, (to_column(x, indexed, raw) for x in parts)) if parts else F.lit(True)
        case Or(parts):
            keys = {(x.key, x.op, x.value) for x in parts if isinstance(x, ElemCompare)}
            whole = reduce(lambda a, b: a | b, (to_column(x, indexed, raw) for x in parts)) if parts else F.lit(True)
            if len(keys) == 1 and all(isinstance(x, ElemCompare) for x in parts):
                key, op, v = next(iter(keys))
                if key in indexed and key not in ELSEWHERE:
                    return pruning(key, op, v) & whole
            return whole
        case Not(part):
            return ~F.coalesce(to_column(part, indexed, raw), F.lit(False))
        case StartsWith(field, prefix):
            return F.col(field).startswith(prefix)
        case Compare(field, op, value):
            return OPS[op](F.col(field), F.lit(value))
        case Contains(field, value):
            return F.array_contains(field, value)
        case ElemExists(field, value):
            return F.exists(field, lambda e: holds(e, "eq", value, False))
        case ElemCompare(field, key, op, value, strict):
            whole = F.exists(field, lambda e: (e["key"] == key) & holds(e, op, value, strict))
            return pruning(key, op, value) & whole if strict and key in indexed else whole
        case BBox(x1, y1, x2, y2):
            return (F.col("min_x") <= x2) & (F.col("max_x") >= x1) & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)
        case Text(text):
            found = words(text)
            if raw:
                return in_text(found)
            if len(found) == 1:
                return F.array_contains("tokens", found[0])
            return F.contains(F.col("text_norm"), F.lit(f" {' '.join(found)} "))
    raise TypeError(f"not a predicate: {p!r}")
