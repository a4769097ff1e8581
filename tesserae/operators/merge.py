"""Chunks back into one valid document: GeoJSON collections, and XML under a common root."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, unescape

#: The XML declaration, the namespace of schema locations, the members that make a collection.
HEADER = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
XSI = "http://www.w3.org/2001/XMLSchema-instance"
RESERVED = ("type", "features", "geometries")
Meta = dict
Chunk = tuple[bytes, Meta]


class MergeError(ValueError):
    """Chunks that can't be in one document; `kind` says why."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(message or kind)
        self.kind = kind


def is_geojson(meta: Meta) -> bool:
    return "json" in (meta.get("mime") or "")


def merge_geojson(chunks: Iterable[Chunk], features: bool = True, extra: dict | None = None) -> Iterator[bytes]:
    """A FeatureCollection in which geometries are wrapped, or, without `features`, a GeometryCollection.

    `extra`: further top-level members, before the array."""
    if bad := [k for k in extra or {} if k in RESERVED]:
        raise MergeError("reserved", f"reserved member: {', '.join(bad)}")
    head = "".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}," for k, v in (extra or {}).items())
    kind, name = ("FeatureCollection", "features") if features else ("GeometryCollection", "geometries")
    yield f'{{"type":"{kind}",{head}"{name}":['.encode()
    for n, (data, meta) in enumerate(chunks):
        if n:
            yield b","
        yield b'{"type":"Feature","geometry":' + data + b"}" if features and meta.get("geojson_type") != "Feature" else data
    yield b"]}"


def name_of(e: dict) -> str:
    return f"{e['prefix']}:{e['name']}" if e["prefix"] else e["name"]


def quoted(value: str) -> str:
    """A value between quotes, such that a parser reads it back as it is, line breaks included."""
    return '"' + escape(value, {'"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}) + '"'


def start_tag(e: dict) -> str:
    spaces = "".join(f' xmlns{":" + n["prefix"] if n["prefix"] else ""}={quoted(n["uri"])}' for n in e["namespaces"])
    own = "".join(f' {a["prefix"] + ":" if a["prefix"] else ""}{a["name"]}={quoted(a["value"])}' for a in e["attributes"])
    return f"<{name_of(e)}{spaces}{own}>"


def _is_location(a: dict, e: dict) -> bool:
    return a["name"] == "schemaLocation" and any(n["prefix"] == a["prefix"] and n["uri"] == XSI for n in e["namespaces"])


def _pairs(value: str) -> dict[str, str]:
    words = value.split()
    return dict(zip(words[::2], words[1::2], strict=False))


def union(a: dict, b: dict) -> dict | None:
    """One element with the namespaces and attributes of both; None where they contradict each other."""
    if name_of(a) != name_of(b):
        return None
    spaces = {n["prefix"]: n["uri"] for n in a["namespaces"]}
    for n in b["namespaces"]:
        if spaces.setdefault(n["prefix"], n["uri"]) != n["uri"]:
            return None
    own = {(x["prefix"], x["name"]): x["value"] for x in a["attributes"]}
    for x in b["attributes"]:
        k = (x["prefix"], x["name"])
        if k in own and own[k] != x["value"]:
            if not _is_location(x, b):
                return None
            both = _pairs(own[k])
            for ns, place in _pairs(x["value"]).items():
                if both.setdefault(ns, place) != place:
                    return None
            own[k] = " ".join(f"{ns} {place}" for ns, place in both.items())
        else:
            own[k] = x["value"]
    return a | {"namespaces": [{"prefix": p, "uri": u} for p, u in spaces.items()], "attributes": [{"prefix": p, "name": n, "value": v} for (p, n), v in own.items()]}


def common_parents(metas: Iterable[Meta]) -> list[dict]:
    """The elements above all chunks: the same for all, or their union level by level. Few distinct ones come in."""
    found: list[dict] | None = None
    for m in metas:
        parents = m["parents"]
        if found is None or parents == found:
            found = parents
            continue
        merged = [union(a, b) for a, b in zip(found, parents, strict=False)] if len(found) == len(parents) else [None]
        if any(x is None for x in merged):
            raise MergeError("parents", "chunks have parents that can't be merged")
        found = merged
    return found or []


def fits(parents: list[dict], meta: Meta) -> bool:
    """Nothing would be added to `parents` by a chunk's own."""
    try:
        return common_parents([{"parents": parents}, meta]) == parents
    except MergeError:
        return False


def merge_xml(chunks: Iterable[Chunk], parents: list[dict]) -> Iterator[bytes]:
    """Header, parents, chunks, closing tags."""
    yield HEADER + "".join(map(start_tag, parents)).encode()
    for data, meta in chunks:
        if not fits(parents, meta):
            raise MergeError("parents", "chunk doesn't fit under the common parents")
        yield data
    yield "".join(f"</{name_of(e)}>" for e in reversed(parents)).encode()


def _location(e: dict) -> tuple[str | None, dict[str, str]] | None:
    return next(((a["prefix"], _pairs(a["value"])) for a in e["attributes"] if _is_location(a, e)), None)


def _sorted_spaces(e: dict) -> list[tuple[str | None, str]]:
    return sorted(((n["prefix"], n["uri"]) for n in e["namespaces"]), key=lambda x: (x[0] or "", x[1]))


def _uri(e: dict) -> str | None:
    uri = next((n["uri"] for n in e["namespaces"] if n["prefix"] == e["prefix"]), None)
    if uri is None and e["prefix"]:
        raise MergeError("unknown_prefix", f"no namespace for {e['prefix']}")
    return uri


def _location_text(prefix: str | None, pairs: dict[str, str]) -> str:
    text = " ".join(f"{k} {v}" for k, v in sorted(pairs.items()))
    return f' {prefix + ":" if prefix else ""}schemaLocation={quoted(text)}'


_TAG = re.compile(rb"""<([^\s/>!?]+)((?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>""")
_PAIR = re.compile(r"""\s+([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def adapted(data: bytes, own: dict, root: dict) -> bytes:
    """The chunk with those namespaces and schema locations in its start tag that its own root has and the first has not."""
    m = re.search(rb"<[^!?]", data)
    tag = _TAG.match(data, m.start()) if m else None
    if tag is None:
        raise MergeError("premature_end", "no start tag in the chunk")
    here = [(k, (a or b).replace('"', "&quot;")) for k, a, b in _PAIR.findall(tag[2].decode())]  # as they are written
    have = {n["prefix"]: n["uri"] for n in root["namespaces"]}
    mine = {k.partition(":")[2] or None for k, _ in here if k == "xmlns" or k.startswith("xmlns:")}
    added = [(p, u) for p, u in _sorted_spaces(own) if have.get(p) != u and p not in mine]
    a, b = _location(own), _location(root)
    place = ""
    if a:
        known = b[1] if b else {}
        fresh = {k: v for k, v in a[1].items() if known.get(k) != v}
        name = f"{a[0] + ':' if a[0] else ''}schemaLocation"
        stated = next((unescape(v, {"&quot;": '"', "&apos;": "'"}) for k, v in here if k == name), None)
        if fresh:
            place = _location_text(a[0], fresh | _pairs(stated or ""))
            here = [(k, v) for k, v in here if k != name]
    if not added and not place:
        return data
    attributes = "".join(f' {k}="{v}"' for k, v in here) + "".join(f' xmlns{":" + p if p else ""}={quoted(u)}' for p, u in added) + place
    name = tag[1].decode()
    rest = data[tag.end() :]
    if tag[3]:
        if rest.strip():
            raise MergeError("unexpected_content", "more content after an empty tag")
        return data[: tag.start()] + f"<{name}{attributes}></{name}>".encode()
    return data[: tag.start()] + f"<{name}{attributes}>".encode() + rest


def merge_xml_first_root(chunks: Iterable[Chunk]) -> Iterator[bytes]:
    """The first chunk's root stands for all; later chunks carry what it lacks. No header. Nothing for no chunks."""
    root: dict | None = None
    for data, meta in chunks:
        own = meta["parents"][0]
        if root is None:
            root = own
            spaces = [{"prefix": p, "uri": u} for p, u in _sorted_spaces(root)]
            tag = start_tag(root | {"namespaces": spaces, "attributes": []})[:-1]
            place = _location(root)
            yield (tag + (_location_text(*place) if place else "") + ">" + "").encode() + data
            continue
        if own == root:
            yield data
            continue
        if own["name"] != root["name"]:
            raise MergeError("multiple_roots", f"found {own['name']}, expected {root['name']}")
        if _uri(own) != _uri(root):
            raise MergeError("root_namespace", f"found {_uri(own)}, expected {_uri(root)}")
        yield adapted(data, own, root)
    if root is not None:
        yield f"</{name_of(root)}>".encode()


#: Whether a merger takes chunks of such metadata, and the merger; see `tesserae.extensions`.
MERGERS: list = []


def merge(chunks: Iterable[Chunk], metas: Iterable[Meta], optimistic: bool = False, extra: dict | None = None, unmerged: list | None = None) -> Iterator[bytes]:
    """Picks the merger by the chunks' metadata; the distinct ones come first, in `metas`, unless `optimistic`.

    Chunks of the other format are errors; if optimistic, they and XML chunks with other parents are skipped and
    counted in `unmerged`."""
    chunks = iter(chunks)
    skipped = unmerged if unmerged is not None else []
    if optimistic:
        first = next(chunks, None)
        if first is None:
            return
        from itertools import chain

        chunks, metas = chain([first], chunks), [first[1]]
    metas = list(metas)
    if not metas:
        return
    for accepts, own in MERGERS:
        if all(map(accepts, metas)):
            yield from own((c for c in chunks if accepts(c[1])), metas)
            return
    json_first = is_geojson(metas[0])
    if any(is_geojson(m) != json_first for m in metas):
        raise MergeError("mixed", "XML and GeoJSON chunks in one document")
    parents = [] if json_first else common_parents(metas)

    def same() -> Iterator[Chunk]:
        for c in chunks:
            if is_geojson(c[1]) == json_first and (json_first or not optimistic or fits(parents, c[1])):
                yield c
            elif optimistic:
                skipped.append(1)
            else:
                raise MergeError("mixed", "XML and GeoJSON chunks in one document")

    if json_first:
        features = optimistic or any(m.get("geojson_type") == "Feature" for m in metas)
        yield from merge_geojson(same(), features, extra)
    else:
        yield from merge_xml(same(), parents)


def frame(metas: list[Meta]) -> tuple[str, str, str]:
    """What stands before all chunks, behind them, and before each but the first, of a document of chunks like these."""
    if not is_geojson(metas[0]):
        parents = common_parents(metas)
        return HEADER.decode() + "".join(map(start_tag, parents)), "".join(f"</{name_of(e)}>" for e in reversed(parents)), ""
    if any(not is_geojson(m) for m in metas):
        raise MergeError("mixed", "XML and GeoJSON chunks in one document")
    whole = b"".join(merge_geojson([], any(m.get("geojson_type") == "Feature" for m in metas))).decode()
    return whole[:-2], whole[-2:], ","


def with_artificial_id(data: bytes, path: str, number: int) -> bytes:
    """A feature with an id: its own, or one made of its chunk's path and its number in the chunk."""
    value = json.loads(data)
    if not isinstance(value, dict) or value.get("id") is not None:
        return data
    return json.dumps({"id": artificial_id(path, number)} | value, ensure_ascii=False, separators=(",", ":")).encode()


def artificial_id(path: str, number: int) -> str:
    return f"chunk_{path.replace('-', '-2d').replace('/', '-2f')}_feature_{number}"
