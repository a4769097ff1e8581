"""Collections, items and single items over a store, as the OGC API Features has them; without a server."""

from __future__ import annotations

import json
import re
from datetime import datetime
from urllib.parse import quote, urlencode
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.model import normalize_layer
from tesserae.operators import merge, select
from tesserae.operators.merge import quoted
from tesserae.plans.nodes import And, BBox, Keyed, Or
from tesserae.plans.prefix import number
from tesserae.store import MissingChunk, NoMatch, Store

#: The conformance classes, link relations, media types and namespaces of the standard.
CONFORMANCE = tuple(f"http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/{c}" for c in ("core", "oas30", "geojson", "gmlsf0"))
JSON, GEOJSON, XML, GML, OPENAPI = "application/json", "application/geo+json", "application/xml", "application/gml+xml", "application/vnd.oai.openapi+json;version=3.0"
CORE, ATOM = "http://www.opengis.net/ogcapi-features-1/1.0", "http://www.w3.org/2005/Atom"
PAGE = 100
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def link(rel: str, href: str, kind: str = JSON, title: str | None = None) -> dict:
    return {"rel": rel, "href": href, "type": kind} | ({"title": title} if title else {})


def landing_page(base: str = "") -> dict:
    """Where everything else is."""
    own = [link("self", f"{base}/"), link("service-desc", f"{base}/api", OPENAPI), link("conformance", f"{base}/conformance"), link("data", f"{base}/collections")]
    return {"title": "Features", "description": "Features of a store", "links": own}


def conformance() -> dict:
    return {"conformsTo": list(CONFORMANCE)}


def api(base: str = "") -> dict:
    """The interface as an OpenAPI document."""
    at = lambda name, kind, where="query": {"name": name, "in": where, "required": where == "path", "schema": kind}
    text, collection = {"type": "string"}, at("collectionId", {"type": "string"}, "path")
    box = {"type": "array", "oneOf": [{"minItems": n, "maxItems": n} for n in (4, 6)], "items": {"type": "number"}}
    items_of = [collection, at("limit", {"type": "integer", "minimum": 1, "default": PAGE}), at("bbox", box), at("datetime", text), at("scrollId", text)]
    get = lambda summary, kind=JSON, own=(): {"get": {"summary": summary, "parameters": list(own), "responses": {"200": {"description": summary, "content": {kind: {}}}}}}
    paths = {
        "/": get("Landing page"),
        "/api": get("This document", OPENAPI),
        "/conformance": get("Conformance classes"),
        "/collections": get("All collections"),
        "/collections/{collectionId}": get("One collection", own=[collection]),
        "/collections/{collectionId}/items": get("A page of features; other parameters are attributes", GEOJSON, items_of),
        "/collections/{collectionId}/items/{featureId}": get("One feature", GEOJSON, [collection, at("featureId", text, "path")]),
    }
    return {"openapi": "3.0.3", "info": {"title": "Features", "version": "1.0.0"}, "servers": [{"url": base or "/"}], "paths": paths}


def collection_view(layer: str, kind: str, base: str = "") -> dict:
    """A collection as JSON: its id is its layer without slashes at the ends."""
    name = layer.strip("/")
    at = f"{base}/collections/{quote(name, safe='')}"
    return {"id": name, "title": name or "All", "itemType": "feature", "links": [link("self", at), link("items", f"{at}/items", GEOJSON if kind == "json" else GML)]}


def collections_view(store: Store, base: str = "") -> dict:
    """All collections as JSON; there are as many as there are layers."""
    found = [collection_view(r["layer"], r["kind"], base) for r in collections(store).toLocalIterator()]
    return {"title": "Collections", "links": [link("self", f"{base}/collections")], "collections": found}


def as_xml(view: dict) -> bytes:
    """A landing page, conformance declaration, or list of collections in the standard's XML."""

    def links(view: dict) -> list[str]:
        return [f"<atom:link {' '.join(f'{k}={quoted(v)}' for k, v in x.items())}/>" for x in view.get("links", [])]

    def texts(view: dict, *names: str) -> list[str]:
        return [f"<core:{n.title()}>{escape(str(view[n]))}</core:{n.title()}>" for n in names if view.get(n)]

    if "conformsTo" in view:
        name, body = "ConformsTo", [f"<atom:link href={quoted(c)}/>" for c in view["conformsTo"]]
    elif "collections" in view:
        name, body = "Collections", links(view)
        for c in view["collections"]:
            body += ["<core:Collection>", f"<core:Id>{escape(c['id'])}</core:Id>", *texts(c, "title"), *links(c), "</core:Collection>"]
    else:
        name, body = "LandingPage", texts(view, "title", "description") + links(view)
    return f"<core:{name} xmlns:core={quoted(CORE)} xmlns:atom={quoted(ATOM)} service=\"OGCAPI-Features\" version=\"1.0.0\">{''.join(body)}</core:{name}>".encode()


def collections(store: Store) -> DataFrame:
    """Layers and the folders above them that hold one kind of chunk: layer, kind (json or xml)."""
    return select.collections(store.documents()).orderBy("layer")


def check_datetime(text: str) -> None:
    """An instant or an interval with `..` for open ends; it is validated and selects nothing away."""
    ends = text.split("/")
    if len(ends) > 2:
        raise ValueError(f"not a time: {text}")
    for t in ends:
        if t not in ("..", ""):
            datetime.fromisoformat(t.replace("Z", "+00:00"))


def equal(key: str, text: str) -> object:
    """key = value, where a value that looks like a number is compared as one as well."""
    own = Keyed(key, "eq", text)
    return Or((Keyed(key, "eq", number(text)), own)) if _NUMBER.fullmatch(text) else own


def items_query(bbox: str | tuple | None = None, datetime: str | None = None, **attributes: str) -> object | None:
    parts: list = []
    if bbox is not None:
        n = [float(x) for x in (bbox.split(",") if isinstance(bbox, str) else bbox)]
        if len(n) not in (4, 6):
            raise ValueError("a box has four or six numbers")
        x1, y1, x2, y2 = n if len(n) == 4 else (n[0], n[1], n[3], n[4])
        parts.append(BBox(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)))
    if datetime is not None:
        check_datetime(datetime)
    parts += [equal(k, v) for k, v in attributes.items()]
    return None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def _view(found: list[tuple[str, bytes, dict]], collection: str, limit: int, base: str, bbox: str | tuple | None, attributes: dict) -> dict:
    """A page of these chunks: path, bytes and metadata, in order of the paths."""
    after = found[-1][0] if found else None
    if {merge.is_geojson(m) for _, _, m in found} == {False}:
        parents = merge.common_parents(m for _, _, m in found)
        body = b"".join(merge.merge_xml(((d, m) for _, d, m in found), parents))
        return {"type": "xml", "body": body, "numberReturned": len(found), "scrollId": after}
    features = []
    for path, data, _ in found:
        value = json.loads(data)
        if value.get("type") != "Feature":
            value = {"type": "Feature", "geometry": value, "properties": {}}
        features.append(value | {"id": value.get("id") or merge.artificial_id(path, 0)})
    at = f"{base}/collections/{quote(collection.strip('/'), safe='')}/items"
    more = urlencode({"scrollId": after, "limit": limit} | ({"bbox": bbox if isinstance(bbox, str) else ",".join(map(str, bbox))} if bbox is not None else {}) | attributes) if after else ""
    links = [link("self", at, GEOJSON)] + ([link("next", f"{at}?{more}", GEOJSON)] if after and len(found) == limit else [])
    return {"type": "FeatureCollection", "features": features, "numberReturned": len(found), "links": links, "scrollId": after}


def items(store: Store, collection: str, limit: int = PAGE, scroll_id: str | None = None, bbox: str | tuple | None = None, datetime: str | None = None, base: str = "", **attributes: str) -> dict:
    """A page of a collection: features with ids, their number, and the scroll id of the next page."""
    query = items_query(bbox, datetime, **attributes)
    found, _ = store.page(query, limit, scroll_id, layer=normalize_layer(collection))
    paths = [r["path"] for r in found]  # at most `limit`
    spark = store.spark
    rows = store.get(spark.createDataFrame([(p,) for p in paths], "path string")).collect() if paths else []
    data = {r["path"]: bytes(r["data"]) for r in rows}
    meta = {r["meta_id"]: r["meta"].asDict(recursive=True) for r in store.chunk_meta().where(F.col("meta_id").isin([r["meta_id"] for r in found])).collect()} if found else {}
    return _view([(r["path"], data[r["path"]], meta[r["meta_id"]]) for r in found], collection, limit, base, bbox, attributes)


def pages(store: Store, collection: str, limit: int = PAGE, bbox: str | tuple | None = None, datetime: str | None = None, base: str = "", **attributes: str) -> DataFrame:
    """All pages with features, each as `items` gives it, as JSON: page (from 0 on), view. Tasks make them, in one pass over
    the collection, where `items` looks for every page anew."""
    placed = select.pages(store.documents(), items_query(bbox, datetime, **attributes), limit, dialect=store.dialect, layer=normalize_layer(collection))
    chunks = placed.join(store.chunk_meta(), "meta_id", "left").join(store.chunks(), "path", "left")

    @F.udf("string")
    def view(rows):  # noqa: ANN001, ANN202 - hints would make it a pandas function
        if lost := [r["path"] for r in rows if r["data"] is None]:
            raise MissingChunk(lost[0])
        found = _view([(r["path"], bytes(r["data"]), r["meta"].asDict(recursive=True)) for r in rows], collection, limit, base, bbox, attributes)
        return json.dumps(found, ensure_ascii=False, default=bytes.decode)  # XML is text

    held = F.array_sort(F.collect_list(F.struct("path", "data", "meta")))
    return chunks.groupBy("page").agg(held.alias("rows")).select("page", view("rows").alias("view"))


def item(store: Store, collection: str, item_id: str, base: str | None = None) -> bytes:
    """One feature by its own id or by an artificial one; with `base`, links to it and to its collection are put in."""
    layer = normalize_layer(collection)
    if m := re.fullmatch(r"chunk_(.*)_feature_(\d+)", item_id):
        path = m[1].replace("-2f", "/").replace("-2d", "-")
        hits = store.documents().where((F.col("path") == path) & F.col("layer").startswith(layer))
    else:
        ids = Or(tuple(Keyed("id", "eq", v) for v in ([number(item_id)] if _NUMBER.fullmatch(item_id) else []) + [item_id]))
        hits = store.select(ids, layer)
    found = hits.select("path").orderBy("path").limit(1).collect()
    if not found:
        raise NoMatch(item_id)
    data = bytes(store.get(store.spark.createDataFrame([tuple(found[0])], "path string")).first()["data"])
    if data.lstrip()[:1] != b"{":
        return data
    data = merge.with_artificial_id(data, found[0]["path"], 0)
    if base is None:
        return data
    at = f"{base}/collections/{quote(collection.strip('/'), safe='')}"
    own = [link("self", f"{at}/items/{quote(item_id, safe='')}", GEOJSON), link("collection", at)]
    return json.dumps({"links": own} | json.loads(data), ensure_ascii=False, separators=(",", ":")).encode()


__all__ = ["api", "as_xml", "collection_view", "collections", "collections_view", "conformance", "item", "items", "landing_page", "pages"]
