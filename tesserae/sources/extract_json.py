"""What is indexed of a GeoJSON chunk: properties, ids, bounding box."""

from __future__ import annotations

import math
from collections.abc import Iterator

from tesserae.model import guess, tagged

Box = tuple[float, float, float, float]
WORLD = (-180.0, -90.0, 180.0, 90.0)


def _scalar(v: object, coerce: bool) -> object:
    """Booleans and null are text. Coerced: strings that look like numbers are numbers."""
    if v is None or isinstance(v, bool):
        return "null" if v is None else str(v).lower()
    return guess(v) if coerce and isinstance(v, str) else v


def properties(chunk: object, coerce: bool = True) -> list[dict]:
    """Direct scalar members of `properties` objects; the first of equal keys stays."""
    out: dict[str, dict] = {}

    def walk(v: object) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "properties" and isinstance(x, dict):
                    for name, y in x.items():
                        if not isinstance(y, (dict, list)):
                            out.setdefault(name, tagged(name, _scalar(y, coerce)))
                else:
                    walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(chunk)
    return list(out.values())


def flattened(chunk: object, coerce: bool = False) -> list[dict]:
    """All scalars below `properties`, under dotted paths with array positions."""

    def walk(v: object, path: str) -> Iterator[dict]:
        if isinstance(v, (dict, list)):
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                yield from walk(x, f"{path}.{k}" if path else str(k))
        else:
            yield tagged(path, _scalar(v, coerce))

    found = chunk.get("properties") if isinstance(chunk, dict) else None
    return list(walk(found, "")) if isinstance(found, (dict, list)) else []


def feature_ids(chunk: object) -> list[dict]:
    """`id` of every object that is a Feature: text or an integer."""
    out: list[dict] = []

    def walk(v: object) -> None:
        if isinstance(v, dict):
            i = v.get("id")
            if v.get("type") == "Feature" and isinstance(i, (str, int)) and not isinstance(i, bool):
                out.append(tagged("id", i))
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(x)

    walk(chunk)
    return [x for k, x in enumerate(out) if x not in out[:k]]


def _numbers(v: object) -> Iterator[float]:
    if isinstance(v, list):
        for x in v:
            yield from _numbers(x)
    elif isinstance(v, (int, float)) and not isinstance(v, bool):
        yield float(v)


def _positions(v: object) -> Iterator[tuple[float, float]]:
    if isinstance(v, list):
        if len(v) > 1 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            yield float(v[0]), float(v[1])
        else:
            for x in v:
                yield from _positions(x)


def bounds(points: list[tuple[float, float]]) -> Box | None:
    if not points:
        return None
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def valid(box: Box | None, off_globe: bool = False) -> Box | None:
    """The box if it lies on the globe, else none; with `off_globe`, also any other of finite numbers."""
    if off_globe:
        return box if box and all(map(math.isfinite, box)) else None
    return box if box and all(a <= x <= b for x, a, b in zip(box, WORLD[:2] * 2, WORLD[2:] * 2, strict=True)) else None


def bounding_box(chunk: object, strict_pairs: bool = False) -> Box | None:
    """Over every `coordinates` member at any depth, by position; altitudes are left out.

    strict_pairs: all numbers are taken as x, y, x, y instead, and an odd count gives no box."""
    points: list[tuple[float, float]] = []

    def walk(v: object) -> bool:
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "coordinates":
                    if strict_pairs:
                        n = list(_numbers(x))
                        if len(n) % 2:
                            return False
                        points.extend(zip(n[::2], n[1::2], strict=True))
                    else:
                        points.extend(_positions(x))
                elif not walk(x):
                    return False
        elif isinstance(v, list):
            return all([walk(x) for x in v])
        return True

    return bounds(points) if walk(chunk) else None
