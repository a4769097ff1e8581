"""Surface terms to predicates. Each dialect has its own reading of a bare value and of a keyed comparison."""

from __future__ import annotations

from tesserae.model import normalize_layer
from tesserae.plans import infix, prefix
from tesserae.plans.nodes import (
    All,
    And,
    BBox,
    Compare,
    Contains,
    ElemCompare,
    ElemExists,
    Keyed,
    Not,
    Or,
    StartsWith,
    StringRangeError,
    Text,
    Value,
    flat,
)

#: Field names by which ids and address parts can be asked for.
GML_ID_NAMES = ("gmlId", "gml:id", "id")
FEATURE_ID_NAMES = ("id", "geoJsonFeatureId")
ADDRESS_NAMES = ("Country", "Locality", "Street", "Number")


def plan(query: str | object | None, dialect: str = "prefix", layer: str | None = None) -> object:
    """The predicate tree for a query text or surface tree, below `layer` if one is given."""
    if isinstance(query, str):
        query = prefix.parse(query) if dialect == "prefix" else infix.parse(query)
    body = All() if query is None else lower_prefix(query) if dialect == "prefix" else lower_infix(query)
    if body is None:
        body = All()
    if below := normalize_layer(layer):
        scope = StartsWith("layer", below)
        return scope if body == All() else And((body, scope))
    return body


#: Asked first about each term; see `tesserae.extensions`.
COMPILERS: list = []


def _compiled(q: object, dialect: str) -> object | None:
    return next((found for f in COMPILERS if (found := f(q, dialect)) is not None), None)


def lower_prefix(q: object) -> object:
    """Bare values are compared whole, over tags, properties, attributes, ids and address parts."""
    if (own := _compiled(q, "prefix")) is not None:
        return own
    match q:
        case And(parts) | Or(parts):
            return flat(type(q), [lower_prefix(p) for p in parts])
        case Not(part):
            return Not(lower_prefix(part))
        case Value(v):
            text = [Contains("tags", v)] if isinstance(v, str) else []
            ids = [Contains("gml_ids", v)] if isinstance(v, str) else []
            places = [Compare(f"address.{n}", "eq", v) for n in ADDRESS_NAMES] if isinstance(v, str) else []
            feature = [] if isinstance(v, float) else [ElemExists("geojson_ids", v)]
            return Or((*text, ElemExists("props", v), ElemExists("attrs", v), *ids, *feature, *places))
        case Keyed(key, op, v):
            parts: list = [ElemCompare("props", key, op, v), ElemCompare("attrs", key, op, v)]
            if op == "eq":
                if key == "correlationId" and isinstance(v, str):
                    parts.append(Compare("correlation_id", "eq", v))
                if key in GML_ID_NAMES and isinstance(v, str):
                    parts.append(Contains("gml_ids", v))
                if key in FEATURE_ID_NAMES and not isinstance(v, float):
                    parts.append(ElemExists("geojson_ids", v))
                if key in ADDRESS_NAMES and isinstance(v, str):
                    parts.append(Compare(f"address.{key}", "eq", v))
            return Or(tuple(parts))
    return q


def lower_infix(q: object) -> object | None:
    """Bare values are full text; comparisons are typed. None for a term without words, which drops out."""
    from tesserae.functions.text import words

    if (own := _compiled(q, "infix")) is not None:
        return own
    match q:
        case And(parts) | Or(parts):
            kept = [x for x in map(lower_infix, parts) if x is not None]
            return flat(type(q), kept) if kept else None
        case Not(part):
            below = lower_infix(part)
            return None if below is None else Not(below)
        case Value(v):
            text = v if isinstance(v, str) else number_text(v)
            return Text(text) if words(text) else None
        case Keyed(key, op, v):
            if op != "eq" and isinstance(v, str):
                raise StringRangeError(f"{key}: strings have no order here")
            return ElemCompare("attrs", key, op, v, strict=True)
    return q


def number_text(v: int | float) -> str:
    """The shortest form; whole floats have no fraction."""
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e16 else repr(v)


__all__ = ["plan", "lower_infix", "lower_prefix", "number_text", "BBox"]
