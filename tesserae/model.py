"""Fixed schemas of the store and the tagged value that attributes and properties carry."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _list(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


#: A tagged value: t is s, l (64-bit integer) or d, and the column of that name holds it.
VALUE = _struct(key=_S, t=_S, s=_S, l=_L, d=_D)
VALUES = _list(VALUE)
#: An element above a chunk: its name, namespaces and attributes.
ROOT = _struct(prefix=_S, name=_S, namespaces=_list(_struct(prefix=_S, uri=_S)), attributes=_list(_struct(prefix=_S, name=_S, value=_S)))
META = _struct(mime=_S, geojson_type=_S, parent_name=_S, header=_S, parents=_list(ROOT))
ADDRESS = _struct(Country=_S, Locality=_S, Street=_S, Number=_S)
DOCUMENT = _struct(
    path=_S, layer=_S, correlation_id=_S, filename=_S, import_ts=_L, mime=_S, meta_id=_S, tags=_list(_S), props=VALUES, attrs=VALUES,
    gml_ids=_list(_S), geojson_ids=VALUES, address=ADDRESS, min_x=_D, min_y=_D, max_x=_D, max_y=_D,
)

INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def tagged(key: str, v: object) -> dict:
    """A value with its type tag: s, l (64-bit integer) or d. Integers out of range become doubles."""
    out = {"key": key, "t": "s", "s": None, "l": None, "d": None}
    if isinstance(v, bool) or v is None:
        v = "null" if v is None else str(v).lower()
    if isinstance(v, int) and INT64_MIN <= v <= INT64_MAX:
        return out | {"t": "l", "l": v}
    if isinstance(v, (int, float)):
        return out | {"t": "d", "d": float(v)}
    return out | {"s": str(v)}


def guess(text: str) -> int | float | str:
    """Integer, else float, else the string itself, as attribute texts are typed."""
    if _INT.fullmatch(text) and INT64_MIN <= int(text) <= INT64_MAX:
        return int(text)
    return float(text) if _FLOAT.fullmatch(text) else text


def normalize_layer(layer: str | None) -> str:
    """`a/b/` without leading and with a trailing slash; the root is the empty string."""
    parts = [p for p in (layer or "").split("/") if p]
    return "/".join(parts) + "/" if parts else ""
