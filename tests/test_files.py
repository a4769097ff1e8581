"""Splitting, extraction, merging, and a store from import to deletion."""

import gzip
import hashlib
import json
import os
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import duckdb
import pytest

from tesserae import cli, ogc, rendered
from tesserae.config import Settings
from tesserae.operators import merge
from tesserae.sources import extract_json, files, split_json, xml
from tesserae.store import MissingChunk, NoMatch, Store
from tesserae.streaming import file_drop

FEATURES = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[-70.31,-18.48]},"properties":{"name":"North Pier","n":1}},  {"type":"Feature","id":"south","geometry":{"type":"Point","coordinates":[-70.33,-18.52]},"properties":{"name":"Lighthouse","n":"2"}}]}'


def chunks(text: str, split=split_json.split_geojson) -> list[tuple[str, str | None]]:
    return [(c.data.decode(), c.parent_name) for c in split(text.encode())]


def test_geojson_chunks():
    assert [p for _, p in chunks(FEATURES)] == ["features", "features"]
    assert all(t in FEATURES for t, _ in chunks(FEATURES))
    assert chunks('{"features":[]}') == [] and chunks('{"type":"GeometryCollection","geometries":[]}') == []
    point = '{"type": "Point", "coordinates": [1, 2]}'
    assert chunks(f" {point}\n") == [(point, None)]
    assert chunks(f'{{"ext":[{{"a":1}}],"geometries":[{point} , {point}],"more":[[1]]}}') == [(point, "geometries")] * 2
    assert chunks('﻿{"features":[{"x":"αβγ }]"}]}') == [('{"x":"αβγ }]"}', "features")]
    for bad in ('{"features":[{]}', '{"features":[{} {}]}', '{"a":1} x', '{"a" 1}'):
        with pytest.raises(split_json.JsonSyntaxError):
            chunks(bad)


def test_json_chunks():
    assert chunks('[{"a":[{"b":1}]}, 2, [{"c":3}]]', split_json.split_json) == [('{"a":[{"b":1}]}', None), ('{"c":3}', None)]
    assert chunks('{"x":{"list":[{"a":1}]}}', split_json.split_json) == [('{"a":1}', "list")]
    assert chunks('{"x":[1,2]}', split_json.split_json) == [('{"x":[1,2]}', None)]


def shown(found: list[dict]) -> dict:
    return {x["key"]: next((x[t] for t in "sld" if x[t] is not None), None) for x in found}


def test_geojson_extraction():
    f = {"type": "Feature", "id": "fid", "geometry": {"type": "LineString", "coordinates": [[8, 49, 3], [8.5, 49.5, 100]]}, "properties": {"name": "x", "year": "2016", "solid": True, "none": None, "deep": {"a": 1}}}
    assert shown(extract_json.properties(f)) == {"name": "x", "year": 2016, "solid": "true", "none": "null"}
    assert shown(extract_json.properties(f, coerce=False))["year"] == "2016"
    assert shown(extract_json.feature_ids(f)) == {"id": "fid"}
    assert extract_json.bounding_box(f) == (8, 49, 8.5, 49.5)
    assert extract_json.bounding_box(f, strict_pairs=True) == (3, 8.5, 49.5, 100)
    assert extract_json.bounding_box({"coordinates": [1, 2, 3]}, strict_pairs=True) is None
    assert extract_json.valid((0, 0, 181, 1)) is None and extract_json.valid((0, 0, 180, 1)) == (0, 0, 180, 1)
    nested = {"properties": {"crew": [{"name": "Ada", "shifts": [3, 5]}, "spare"], "open": True, "by": {"year": {"1999": 1.5}}, "gone": None}}
    assert shown(extract_json.flattened(nested)) == {"crew.0.name": "Ada", "crew.0.shifts.0": 3, "crew.0.shifts.1": 5, "crew.1": "spare", "open": "true", "by.year.1999": 1.5, "gone": "null"}


def test_xml_chunks():
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    body = '<root>\n<object><child></child></object>\n<o2 a="≈">≈</o2 ><e/><!-- c --></root>'
    found = [c.data.decode() for c in xml.split((head + body).encode())]
    assert found == ["<object><child></child></object>", '<o2 a="≈">≈</o2 >', "<e/>"]
    assert len(list(xml.split(body.encode(), self_closing=False))) == 2
    tight = b"<a><a/><a>x/></a><a><b/></a><a></a><a/></a>"  # empty tags next to closing ones, text that looks like an end
    assert [c.data for c in xml.split(tight)] == [b"<a/>", b"<a>x/></a>", b"<a><b/></a>", b"<a></a>", b"<a/>"]
    assert [c.data for c in xml.split(tight, self_closing=False)] == [b"<a>x/></a>", b"<a><b/></a>", b"<a></a>"]
    assert len(list(xml.split(b"\xef\xbb\xbf" + body.encode()))) == 3
    (c,) = xml.split(b'<r xmlns="u" xmlns:p="v" p:a="1" b="2"><p:x/></r>')
    assert c.root.namespaces == [(None, "u"), ("p", "v")] and c.root.attributes == [("p", "a", "1"), (None, "b", "2")]


GML = '<r xmlns:gml="http://www.opengis.net/gml" xmlns:gen="g">{}</r>'


def one(body: str, **kw):
    return next(xml.split(GML.format(body).encode(), **kw))


def test_xml_extraction():
    c = one('<b gml:id="B1"><gen:stringAttribute name="a"><gen:value>x</gen:value></gen:stringAttribute><gen:intAttribute name="n"><gen:value>5</gen:value></gen:intAttribute><gen:intAttribute name="n"><gen:value>6</gen:value></gen:intAttribute><p gml:id="P1"/></b>')
    assert shown(c.attrs) == {"a": "x", "n": 5} and c.gml_ids == ["B1", "P1"]
    both = one('<b><gen:intAttribute name="n"><gen:value>5</gen:value></gen:intAttribute><gen:intAttribute name="n"><gen:value>6</gen:value></gen:intAttribute></b>', first_text=True)
    assert [x["l"] for x in both.attrs] == [5, 6]
    xal = '<a xmlns:x="urn:oasis:names:tc:ciq:xsdschema:xAL:2.0"><x:CountryName> Chile </x:CountryName><x:LocalityName>Arica</x:LocalityName><x:ThoroughfareNumber>17b</x:ThoroughfareNumber></a>'
    assert one(xal).address == {"Country": "Chile", "Locality": "Arica", "Number": "17b"}


def test_xml_boxes():
    c = one('<s srsName="EPSG:25832" srsDimension="3"><posList>675603 6522325 0 675604 6522326 100</posList></s>')
    assert abs(c.box[0] - 12.06) < 0.1 and abs(c.box[1] - 58.8) < 0.1 and c.box[0] < c.box[2]
    assert one('<s srsName="EPSG:4326"><pos>49 8</pos></s>').box == (8, 49, 8, 49)
    env = one('<f><boundedBy><Envelope srsName="EPSG:4326"><lowerCorner>49 8</lowerCorner><upperCorner>50 9</upperCorner></Envelope></boundedBy><pos>51 7</pos></f>')
    assert env.box == (7, 49, 9, 51)
    skipped = one('<f><boundedBy><Envelope srsName="EPSG:4326"><lowerCorner>49 8</lowerCorner></Envelope></boundedBy><pos>51 7</pos></f>', skip=frozenset(["Envelope"]))
    assert skipped.box == (7, 51, 7, 51)
    assert one("<s><pos>1 2</pos></s>").box is None and one('<s srsName="EPSG:9"><pos>1 2</pos></s>').box is None
    assert one("<s><pos>49 8</pos></s>", fallback_crs="EPSG:4326").box == (8, 49, 8, 49)
    for bad in ("<s><pos>1 2</pos></s>", '<s srsName="EPSG:4326" srsDimension="2"><pos>1 2 3</pos></s>', '<s srsName="EPSG:4326" srsDimension="1"><pos>1 2</pos></s>'):
        with pytest.raises((xml.CoordinateError, ValueError)):
            one(bad, strict=True)


def test_mime_types():
    assert files.belongs_to("application/geo+json", "application", "json") and not files.belongs_to("application/geojson", "application", "json")
    assert [files.sniff(x) for x in (b' \n{"a"', b"\xef\xbb\xbf[", b" <a/>", b"x", b"")] == ["application/json", "application/json", "application/xml", None, None]


J, G = {"mime": "application/json", "geojson_type": "Feature"}, {"mime": "application/json", "geojson_type": "Point"}


def joined(*args, **kw) -> str:
    return b"".join(merge.merge(*args, **kw)).decode()


def test_geojson_merging():
    assert joined([(b"1", G), (b"2", G)], [G]) == '{"type":"GeometryCollection","geometries":[1,2]}'
    assert joined([(b"1", J), (b"2", G)], [J, G]) == '{"type":"FeatureCollection","features":[1,{"type":"Feature","geometry":2}]}'
    assert joined([(b"2", G)], [], optimistic=True) == '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":2}]}'
    assert joined([(b"1", J)], [J], extra={"a": 1}) == '{"type":"FeatureCollection","a":1,"features":[1]}'
    with pytest.raises(merge.MergeError):
        joined([(b"1", J)], [J], extra={"type": 1})


def element(name: str, spaces: list, attributes: list = (), prefix: str | None = None) -> dict:
    return {"prefix": prefix, "name": name, "namespaces": [{"prefix": p, "uri": u} for p, u in spaces], "attributes": [{"prefix": p, "name": n, "value": v} for p, n, v in attributes]}


def X(*parents: dict) -> dict:  # noqa: N802
    return {"mime": "application/xml", "parents": list(parents)}


DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def test_xml_merging_by_union():
    """Two harbours with namespaces, schema locations and attributes of their own, under one element."""
    xsi = ("xsi", merge.XSI)
    north = element("harbour", [(None, "urn:h"), ("t", "urn:tide"), xsi], [("xsi", "schemaLocation", "urn:h h.xsd  urn:tide tide.xsd"), ("t", "station", "north")])
    south = element("harbour", [(None, "urn:h"), ("w", "urn:wind"), xsi], [("xsi", "schemaLocation", "urn:wind wind.xsd urn:h h.xsd"), ("w", "mast", "9")])
    (both,) = merge.common_parents([X(north), X(south)])
    assert {(n["prefix"], n["uri"]) for n in both["namespaces"]} == {(None, "urn:h"), ("t", "urn:tide"), ("w", "urn:wind"), xsi}
    own = {(a["prefix"], a["name"]): a["value"] for a in both["attributes"]}
    assert own.pop(("xsi", "schemaLocation")).split() == ["urn:h", "h.xsd", "urn:tide", "tide.xsd", "urn:wind", "wind.xsd"]
    assert own == {("t", "station"): "north", ("w", "mast"): "9"}
    out = joined([(b"<quay/>", X(north)), (b"<mole/>", X(south))], [X(north), X(south)])
    assert out.startswith(DECLARATION + "<harbour ") and out.endswith("><quay/><mole/></harbour>")
    bare = element("harbour", [])
    assert joined([(b"<quay/>", X(bare))], [X(bare)]) == DECLARATION + "<harbour><quay/></harbour>"
    for other in (element("port", []), element("harbour", [(None, "urn:other")])):
        with pytest.raises(merge.MergeError):
            merge.common_parents([X(north), X(other)])
    with pytest.raises(merge.MergeError):
        joined([(b"<quay/>", X(bare)), (b"{}", J)], [X(bare), J])
    lost: list = []
    assert joined([(b"<quay/>", X(bare)), (b"{}", J), (b"<mole/>", X(north))], [], optimistic=True, unmerged=lost).endswith("<harbour><quay/></harbour>") and len(lost) == 2


HOSTILE = 'a&b<c>"d"\'e\' \t\n&amp;'


def parsed(text: str | bytes) -> list:
    """Every element's expanded name and attributes, as another parser reads them."""
    return [(e.tag, dict(e.attrib)) for e in ElementTree.fromstring(text).iter()]


def test_xml_values_are_escaped():
    """What a parser reads from the merged document is what it read from the files."""
    whole = f'<h:harbour xmlns:h={quoteattr("urn:h?x=1&y=2")} xmlns={quoteattr("urn:<n>")} h:note={quoteattr(HOSTILE)} plain={quoteattr(HOSTILE)}><quay h:n={quoteattr(HOSTILE)}/></h:harbour>'
    (c,) = xml.split(whole.encode())
    assert [a["value"] for a in c.root.row()["attributes"]] == [HOSTILE] * 2
    meta = X(c.root.row())
    assert parsed(joined([(c.data, meta)], [meta])) == parsed(whole)
    head, tail, _ = merge.frame([meta])
    assert parsed(head + c.data.decode() + tail) == parsed(whole)


def test_xml_values_are_escaped_under_the_first_root():
    """Namespaces and schema locations that move to a chunk's own tag, next to attributes that stay as they are."""
    first = element("harbour", [("h", "urn:h")], prefix="h")
    place = "urn:h?a&b h.xsd?x=1&y=2"
    later = element("harbour", [("h", "urn:h"), ("w", "urn:w?1&2"), ("xsi", merge.XSI)], [("xsi", "schemaLocation", place)], prefix="h")
    out = first_root(("<quay/>", first), (f"<w:mole n={quoteattr(HOSTILE)} m='\"q\"'></w:mole>", later))
    tag, attributes = parsed(out)[2]
    assert tag == "{urn:w?1&2}mole" and attributes == {"n": HOSTILE, "m": '"q"', f"{{{merge.XSI}}}schemaLocation": place}


def first_root(*found) -> str:
    return b"".join(merge.merge_xml_first_root((c.encode(), X(e)) for c, e in found)).decode()


def test_xml_merging_under_the_first_root():
    """The first chunk's harbour stands for all; what it lacks goes to the quays of the others."""
    quay = lambda n, more="": f"<quay no='{n}'{more}></quay>"
    bare = element("harbour", [])
    assert first_root((quay(1), bare), (quay(2), bare)) == f"<harbour>{quay(1)}{quay(2)}</harbour>"
    sea = ("sea", "urn:sea")
    a, b = element("harbour", [sea, ("t", "urn:tide")], prefix="sea"), element("harbour", [sea, ("w", "urn:wind")], prefix="sea")
    out = parsed(first_root((quay(1), a), ("<w:quay/>", b), ("<w:quay>calm</w:quay>", b)))
    assert [t for t, _ in out] == ["{urn:sea}harbour", "quay", "{urn:wind}quay", "{urn:wind}quay"]
    ocean = element("harbour", [("ocean", "urn:sea"), ("w", "urn:wind")], prefix="ocean")  # the same name by another prefix
    assert [t for t, _ in parsed(first_root((quay(1), a), ("<ocean:quay/>", ocean)))] == ["{urn:sea}harbour", "quay", "{urn:sea}quay"]
    own = "<sea:quay xmlns:sea='urn:lake'/>"  # a prefix that the chunk itself binds anew
    assert [t for t, _ in parsed(first_root((quay(1), a), (own, b)))] == ["{urn:sea}harbour", "quay", "{urn:lake}quay"]
    for chunk, e, kind in (("", b, "premature_end"), ("<quay/><quay/>", b, "unexpected_content"), (quay(2), element("port", [sea], prefix="sea"), "multiple_roots"), (quay(2), element("harbour", [("sea", "urn:lake")], prefix="sea"), "root_namespace")):
        with pytest.raises(merge.MergeError) as err:
            first_root((quay(1), a), (chunk, e))
        assert err.value.kind == kind


@pytest.fixture()
def store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(FEATURES)
    (tmp_path / "in/b.json.gz").write_bytes(gzip.compress('{"type":"Point","coordinates":[1,2]}'.encode()))
    s = Store(spark, str(tmp_path / "store"), indexed_fields=("n",), cells=True)
    assert s.import_files(str(tmp_path / "in/a.json"), layer="places", tags=["t1"], properties={"p": "v"}) == 2
    return s


def test_store(store, tmp_path, spark):
    whole = b"".join(store.search())
    assert json.loads(whole) == json.loads(FEATURES)
    assert json.loads(b"".join(store.search("Lighthouse")))["features"][0]["id"] == "south"
    assert store.paths('EQ(name "North Pier")').count() == 1 and store.paths("-70.3101,-18.4801,-70.3099,-18.4799").count() == 1
    assert store.paths("EQ(n 2)").count() == 1 and store.paths("GT(n 2)").count() == 0
    assert store.paths("t1", layer="places").count() == 2 and store.paths(None, layer="place").count() == 0
    with pytest.raises(NoMatch):
        list(store.search("nothing"))
    with pytest.raises(MissingChunk):
        store.get(spark.createDataFrame([("x",)], "path string"))
    first, scroll = store.page(size=1)
    second, scroll2 = store.page(size=1, scroll_id=scroll)
    third, end = store.page(size=1, scroll_id=scroll2)
    assert (len(first), len(second), third, end) == (1, 1, [], None)
    old = store.manifest().version
    store.add_tags(["x"], "Lighthouse")
    store.set_properties({"p": 5, "q": "z"}, "x")
    assert store.paths("x").count() == 1 and store.paths("EQ(p 5)").count() == 1 and {r.value for r in store.property_values("p").collect()} == {"v", "5"}
    store.remove_properties(["p", "q"])
    store.remove_tags(["x"])
    assert store.property_values("p").count() == 0 and store.paths("x").count() == 0 and {r.value for r in store.attribute_values("name").collect()} == {"North Pier", "Lighthouse"}
    assert store.import_files(str(tmp_path / "in"), glob="*.gz") == 1
    assert [r.layer for r in store.layers().orderBy("layer").collect()] == ["", "places/"] and store.layer_exists("places") and not store.layer_exists("plac")
    assert store.meta().count() == 3 and store.distinct_meta().count() == 2 and store.import_log().count() == 2
    assert store.delete("EQ(n 1)") == 1 and store.delete("EQ(n 1)") == 0
    assert store.documents(old).count() == 2
    store.vacuum()
    assert store.chunks().count() == 2 and len(json.loads(b"".join(store.export("places")))["features"]) == 1


def test_features_api(store):
    assert [(r.layer, r.kind) for r in ogc.collections(store).collect()] == [("", "json"), ("places/", "json")]
    page = ogc.items(store, "places", limit=1)
    rest = ogc.items(store, "places", limit=1, scroll_id=page["scrollId"])
    assert page["numberReturned"] == 1 and {f["id"] for f in page["features"] + rest["features"]} >= {"south"}
    assert ogc.items(store, "places", n="2")["numberReturned"] == 1 and ogc.items(store, "places", bbox="-71,-19,-70,-18", name="Lighthouse", datetime="2020-01-01/..")["numberReturned"] == 1
    made = next(f["id"] for f in page["features"] + rest["features"] if f["id"] != "south")
    assert json.loads(ogc.item(store, "places", made))["properties"]["n"] == 1 and json.loads(ogc.item(store, "places", "south"))["id"] == "south"
    with pytest.raises(NoMatch):
        ogc.item(store, "places", "none")
    with pytest.raises(ValueError):
        ogc.items(store, "places", datetime="soon")
    assert ogc.landing_page()["links"] and ogc.conformance()["conformsTo"]


def test_all_pages_are_those_of_single_requests(spark, tmp_path, store):
    def walked(s: Store, layer: str, limit: int, **at) -> list[dict]:
        found = [ogc.items(s, layer, limit, **at)]
        while found[-1]["scrollId"]:
            found.append(ogc.items(s, layer, limit, found[-1]["scrollId"], **at))
        return [json.loads(json.dumps(x, default=bytes.decode)) for x in found[:-1]]

    def paged(s: Store, layer: str, limit: int, **at) -> list[dict]:
        rows = ogc.pages(s, layer, limit, **at).orderBy("page").collect()
        assert [r.page for r in rows] == list(range(len(rows)))
        return [json.loads(r.view) for r in rows]

    store.import_files(str(tmp_path / "in/b.json.gz"), layer="places")  # a geometry, which gets an id
    for limit, at in ((1, {"bbox": "-71,-19,-70,-18", "base": "http://x"}), (2, {}), (3, {}), (2, {"n": "none"})):
        assert paged(store, "places", limit, **at) == walked(store, "places", limit, **at)
    for k in (1, 2, 3):
        (tmp_path / f"{k}.xml").write_text(GML.format(f"<boat>{k}</boat>"))
    s = Store(spark, str(tmp_path / "xml"))
    s.import_files(str(tmp_path), glob="*.xml", layer="boats")
    assert [x["numberReturned"] for x in paged(s, "boats", 2)] == [2, 1] and paged(s, "boats", 2) == walked(s, "boats", 2)
    s.commit(lambda m: m.chunks.clear())
    with pytest.raises(Exception, match="MissingChunk"):
        paged(s, "boats", 2)


def test_jobs_of_a_paged_collection_do_not_grow_with_its_pages(spark):
    d = "/root/testdata/sf0.01"
    rendered.feature_store(spark, d)
    spark.sparkContext.setJobGroup("pages", "")
    try:
        rows = rendered.QUERIES["collection_pages"](spark, d).collect()
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert len({r.page for r in rows}) == 8 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("pages")) < 30


def test_xml_store(spark, tmp_path):
    boat = lambda k: f'<boat gml:id="B{k}"><gen:stringAttribute name="berth"><gen:value>Quay{k}</gen:value></gen:stringAttribute></boat>'
    for k in (1, 2):
        (tmp_path / f"{k}.xml").write_text(GML.format(boat(k)))
    s = Store(spark, str(tmp_path / "store"), dialect="infix")
    assert s.import_files(str(tmp_path), glob="*.xml") == 2
    out = b"".join(s.search('berth == "Quay2"')).decode()
    assert boat(2) in out and boat(1) not in out and out.startswith("<?xml")
    assert parsed(b"".join(s.search('"quay1"', first_root=True))) == parsed(GML.format(boat(1)))
    s.export_files(str(tmp_path / "out"))
    boats = lambda text: sorted(str(e) for e in parsed(text) if e[0] == "boat")
    assert boats(together(tmp_path / "out")) == boats(GML.format(boat(1) + boat(2)))


def together(folder) -> str:
    return "".join(f.read_text() for f in sorted(folder.glob("part-*")))


def test_export_files_are_one_document(store, tmp_path):
    store.export_files(str(tmp_path / "out"))
    assert json.loads(together(tmp_path / "out")) == json.loads(b"".join(store.export()))
    store.import_files(str(tmp_path / "in/b.json.gz"))
    store.export_files(str(tmp_path / "more"))
    assert json.loads(together(tmp_path / "more")) == json.loads(b"".join(store.export()))
    with pytest.raises(NoMatch):
        store.export_files(str(tmp_path / "none"), "nothing")


def test_boxes_in_metres_beyond_the_globe(spark, tmp_path):
    c = duckdb.connect()
    c.execute("create table customer as select unnest([0, 1, 20037, 20038, 89999, 472618, 899999])::bigint as c_custkey, 3 as c_nationkey")
    c.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    got = rendered.QUERIES["xml_boxes_in_metres"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(rendered.ORACLES["xml_boxes_in_metres"]).fetchall())
    far = '<r><p><pos srsName="EPSG:3857">90000000 0</pos></p><p><pos srsName="EPSG:4326">3 2</pos></p><p><pos srsName="EPSG:4326">1e999 2</pos></p></r>'
    boxes = lambda o: [(r["min_x"], r["min_y"]) for r in files.rows(far.encode(), "a", o)]
    assert boxes(files.ImportOptions()) == [(None, None), (2, 3), (None, None)]
    assert boxes(files.ImportOptions(off_globe=True)) == [(pytest.approx(808.483464), 0), (2, 3), (None, None)]
    (tmp_path / "far.xml").write_text(far)
    s = Store(spark, str(tmp_path / "far"), cells=True)
    s.import_files(str(tmp_path / "far.xml"), off_globe=True)
    assert [s.paths(q).count() for q in ("800,-1,810,1", "0,0,810,5", "2,3,2,3", "-5,-5,1,1")] == [1, 2, 1, 0]


def test_exported_files_are_read_in_order_of_their_names(spark, tmp_path, monkeypatch):
    class Parts:
        def export_files(self, at: str) -> None:
            os.makedirs(at)
            for k in range(4):  # the last is the largest
                with open(f"{at}/part-{k:05d}.txt", "w") as f:
                    f.writelines(f"{k}-{n}\n" for n in range(10 ** (k + 1)))

    monkeypatch.setattr(rendered, "feature_store", lambda *a: Parts())
    want = "".join(f"{k}-{n}" for k in range(4) for n in range(10 ** (k + 1))).encode()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (size, "20000"):  # also where files are cut
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            assert tuple(rendered._exported(spark, "").first()) == (len(want), hashlib.sha256(want).hexdigest())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_file_may_be_imported_twice(store, tmp_path):
    assert store.import_files(str(tmp_path / "in/a.json"), layer="places") == 2
    assert len(json.loads(b"".join(store.search()))["features"]) == 4 == store.documents().select("path").distinct().count()
    (tmp_path / "in/copies").mkdir()
    for d in ("x", "y"):
        (tmp_path / "in/copies" / d).mkdir()
        (tmp_path / "in/copies" / d / "a.json").write_text(FEATURES)
    assert store.import_files(str(tmp_path / "in/copies"), glob="*.json", layer="copies", correlation_id="one") == 4
    assert store.paths(layer="copies").distinct().count() == 4 and len(json.loads(b"".join(store.search(layer="copies")))["features"]) == 4


def test_two_writers_both_survive(store, tmp_path, spark):
    """A second writer commits while the first has read the version it builds on: the first builds on the newer one."""
    other = Store(spark, store.root)
    begun, publish = [], store._publish

    def late(name, text):
        if not begun:
            begun.append(1)
            other.import_files(str(tmp_path / "in/a.json"), layer="other")
        return publish(name, text)

    store._publish = late
    store.add_tags(["x"], "Lighthouse")
    assert store.paths("x").count() == 1 and store.documents().count() == 4 and store.paths(layer="other").count() == 2
    store._publish = late_change(store, other, publish)
    store.add_tags(["y"], "Lighthouse", layer="places")
    assert store.paths("AND(x y EQ(q 1))").count() == 1


def late_change(store, other, publish):
    """Another writer changes the very file that a change is about, just before that is published."""
    done = []

    def f(name, text):
        if not done:
            done.append(1)
            other.set_properties({"q": 1}, "x")
        return publish(name, text)

    return f


@pytest.mark.parametrize("step", [0, 1, 2, 3, 4, 5])
def test_a_crash_leaves_the_old_version(store, tmp_path, monkeypatch, step):
    """An import that dies before any of its writes is not there at all; the next one works."""
    count, write, publish = [0], store._write, store._publish

    def dying(f):
        def g(*a):
            count[0] += 1
            if count[0] > step:
                raise OSError("lost")
            return f(*a)

        return g

    monkeypatch.setattr(store, "_write", dying(write))
    monkeypatch.setattr(store, "_publish", dying(publish))
    with pytest.raises(OSError, match="lost"):
        store.import_files(str(tmp_path / "in/a.json"))
    monkeypatch.undo()
    assert store.documents().count() == 2 and len(json.loads(b"".join(store.search()))["features"]) == 2
    assert store.import_files(str(tmp_path / "in/a.json")) == 2 and store.documents().count() == 4


def test_changes_rewrite_only_files_with_a_match(store, tmp_path):
    for k in range(3):
        store.import_files(str(tmp_path / "in/b.json.gz"), layer=f"l{k}")
    before = store._files(store.manifest().documents)
    store.add_tags(["x"], "Lighthouse")
    after = store._files(store.manifest().documents)
    assert len(set(before) - set(after)) == 1 and store.paths("x").count() == 1 and store.documents().count() == 5
    version = store.manifest().version
    store.add_tags(["x"], "no such word")
    assert store.manifest().version == version
    store.compact()
    assert store.documents().count() == 5 and len(store.manifest().documents) == 1
    store.vacuum()
    assert store.documents().count() == 5 and store.paths("x").count() == 1


def test_an_index_is_added_and_dropped(store, tmp_path):
    store.import_files(str(tmp_path / "in/b.json.gz"))
    store.add_index(["name"])
    assert {c for c in store.documents().columns if c.startswith("ix_")} == {f"ix_{k}_{p}" for k in ("n", "name") for p in ("min", "max", "smin", "smax")}
    assert "ix_name_smin" in store.select('EQ(name "Lighthouse")')._jdf.queryExecution().toString() and store.paths('EQ(name "Lighthouse")').count() == 1
    store.drop_index(["n"])
    assert not any(c.startswith("ix_n_") for c in store.documents().columns) and store.paths("EQ(n 1)").count() == 1
    other = Store(store.spark, store.root, indexed_fields=("other",))  # the index of a store that has data is the store's
    other.import_files(str(tmp_path / "in/a.json"))
    assert other.paths('EQ(name "Lighthouse")').count() == 2


def test_words_and_cells_come_from_the_postings(store, tmp_path):
    store.import_files(str(tmp_path / "in/b.json.gz"))
    infix = lambda q: store.select(q, dialect="infix")
    for q, n in (('"north pier"', 1), ('"pier north"', 0), ('"lighthouse"', 1), ('"lighthouse" or "pier"', 2), ('"north" and "pier" and n == 1', 1), ('!("pier")', 2), ("bbox(-71,-19,-70,-18)", 2), ("bbox(0,0,3,3)", 1), ('bbox(-71,-19,-70,-18) and "pier"', 1)):
        assert infix(q).count() == n, q
    plan_text = infix('"north pier"').select("path")._jdf.queryExecution().toString()
    assert "In(word" in plan_text and "tokens" not in plan_text.split("Physical Plan")[1]


def test_collections_are_one_aggregation(store):
    assert "NestedLoop" not in ogc.collections(store)._jdf.queryExecution().toString()


def test_dropped_files(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop/a.json").write_text(FEATURES)
    s = Store(spark, str(tmp_path / "store"))
    for n in (2, 3):
        file_drop.watch(s, str(tmp_path / "drop"), str(tmp_path / "done")).awaitTermination(120)
        assert s.documents().count() == n
        (tmp_path / "drop/b.json").write_text('{"type":"Point","coordinates":[1,2]}')


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(FEATURES)
    at = ["--store", str(tmp_path / "store")]
    assert cli.main([*at, "import", str(tmp_path / "a.json"), "--layer", "l", "--tags", "a,b", "--properties", "k:1"]) == 0
    assert cli.main([*at, "property", "get", "k"]) == 0 and cli.main([*at, "tag", "rm", "a"]) == 0 and cli.main([*at, "search", "a"]) == 1
    assert cli.main([*at, "collections"]) == 0 and cli.main([*at, "delete", "b"]) == 0
    assert capsys.readouterr().out.split() == ["2", "1", "l/", "2"]


def small_pieces(data: bytes, n: int) -> list[bytes]:
    return [data[a : a + n] for a in range(0, len(data), n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_files_are_split_the_same_in_any_pieces(n):
    head = '<?xml version="1.0"?>\n<r xmlns:p="u">'
    for text in (FEATURES, '﻿{"a":[1],"geometries":[{"x":"αβγ }]"} , {"y":-1.5e3}],"n":12}', '{"one":12345}', "[1, 2]", "12345"):
        whole = [(c.data, c.value, c.parent_name) for c in split_json.split_geojson(text.encode())]
        assert [(c.data, c.value, c.parent_name) for c in split_json.split_geojson(small_pieces(text.encode(), n))] == whole
    text = '[{"a":[{"b":1}]}, 2, [{"c":3}], "é\\""]'
    assert list(split_json.split_json(small_pieces(text.encode(), n))) == list(split_json.split_json(text.encode()))
    text = ("﻿" + head + "".join(f"<o i='{i}'>≈<p:q/>{i}</o><e/>" for i in range(20)) + "</r>").encode()
    assert [c.data for c in xml.split(small_pieces(text, n))] == [c.data for c in xml.split(text)] and len(list(xml.split(text))) == 40


def test_large_files_pass_through_a_window():
    """A collection of 60 MB, piece by piece: the text that is held stays small, and every chunk comes."""
    feature = '{"type":"Feature","geometry":null,"properties":{"t":"' + "x" * 2000 + '"}}'
    many = 30_000
    pieces = iter(['{"features":['.encode(), *((feature + ("," if i < many - 1 else "]}")).encode() for i in range(many))])
    held, made = [], split_json.Window

    class Watched(made):
        def more(self):
            held.append(len(self.text))
            return super().more()

    split_json.Window = Watched
    try:
        assert sum(1 for _ in split_json.split_geojson(pieces)) == many
    finally:
        split_json.Window = made
    assert max(held) < 12 << 20
    boats = iter([b"<r>", *(b"<boat>" + b"y" * 2000 + b"</boat>" for _ in range(many)), b"</r>"])
    assert sum(len(c.data) for c in xml.split(boats)) == many * 2013


def test_files_too_large_for_a_cell_are_opened_by_their_task(spark, tmp_path):
    (tmp_path / "a.json").write_text(FEATURES)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(FEATURES.encode()) + gzip.compress(b"  "))
    (tmp_path / "c.xml").write_text(GML.format("<b/><b>1</b>"))
    o = files.ImportOptions()
    got = [sorted((r.path, bytes(r.data)) for r in files.read_files(spark, str(tmp_path), o, cell=c).collect()) for c in (files.CELL, 100, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6


def test_views_of_the_features_api(store):
    base = "http://x/y"
    page = ogc.landing_page(base)
    assert {x["rel"] for x in page["links"]} >= {"self", "service-desc", "conformance", "data"} and any(c.endswith("oas30") for c in ogc.conformance()["conformsTo"])
    doc = json.loads(json.dumps(ogc.api(base)))
    assert doc["openapi"].startswith("3.0") and {p["name"] for p in doc["paths"]["/collections/{collectionId}/items"]["get"]["parameters"]} >= {"collectionId", "limit", "bbox", "datetime"}
    found = ogc.collections_view(store, base)
    assert [c["id"] for c in found["collections"]] == ["", "places"] and found["collections"][1]["links"][1]["href"] == f"{base}/collections/places/items"
    for view, name in ((page, "LandingPage"), (ogc.conformance(), "ConformsTo"), (found, "Collections")):
        root = ElementTree.fromstring(ogc.as_xml(view))
        assert root.tag == f"{{{ogc.CORE}}}{name}" and root.iter(f"{{{ogc.ATOM}}}link")
    assert len([e for e in ElementTree.fromstring(ogc.as_xml(found)).iter() if e.tag.endswith("Collection")]) == 2
    first = ogc.items(store, "places", limit=1, base=base)
    assert [x["rel"] for x in first["links"]] == ["self", "next"] and first["scrollId"].split("/")[1] in first["links"][1]["href"]
    one = json.loads(ogc.item(store, "places", "south", base))
    assert [x["rel"] for x in one["links"]] == ["self", "collection"] and one["id"] == "south"


def test_extensions(spark, tmp_path):
    """A splitter of lines, an indexer, an indexer of metadata, a term of the language and a merger of one's own."""
    from tesserae import extensions
    from tesserae.plans.nodes import ElemCompare, Value

    def lines(pieces):
        from types import SimpleNamespace

        for x in b"".join(pieces).splitlines():
            yield SimpleNamespace(data=x, value={"properties": {"raw": x.decode()}}, parent_name="lines")

    (tmp_path / "a.txt").write_text("one two\nthree\nfour five six\n")
    extensions.add_splitter("lines", lines, "text/json")
    extensions.add_indexer(lambda value: {"words": len(value["properties"]["raw"].split())})
    extensions.add_meta_indexer(lambda meta: {"from": meta["parent_name"]})
    extensions.add_compiler(lambda q, dialect: ElemCompare("attrs", "words", "gt", 1) if q == Value("long") else None)
    extensions.add_merger(lambda meta: meta["parent_name"] == "lines", lambda chunks, metas: (data + b"\n" for data, _ in chunks))
    try:
        s = Store(spark, str(tmp_path / "store"))
        assert s.import_files(str(tmp_path / "a.txt"), splitter="lines") == 3
        assert b"".join(s.search()) == b"one two\nthree\nfour five six\n"
        assert b"".join(s.search("long")) == b"one two\nfour five six\n"
        assert b"".join(s.search("EQ(words 1)")) == b"three\n" and s.paths("EQ(from lines)").count() == 3
    finally:
        extensions.clear()
    assert s.paths("long").count() == 0


def test_settings_and_the_rest_of_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text('[{"k":1},{"k":2}]')
    (tmp_path / "conf.json").write_text(json.dumps({"store": str(tmp_path / "store"), "splitter": "json", "indexed_fields": ["k"], "cells": True, "dialect": "infix"}))
    at = ["--config", str(tmp_path / "conf.json")]
    for command in (["import", str(tmp_path / "a.json")], ["log"], ["index", "add", "n"], ["compact"], ["index", "rm", "n"], ["vacuum"], ["export", "--folder", str(tmp_path / "out")], ["delete", "--layer", "none"]):
        assert cli.main([*at, *command]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "2" and lines[1].startswith("- 2 ") and lines[2] == "0"
    assert [f["geometry"]["k"] for f in json.loads(together(tmp_path / "out"))["features"]] == [1, 2] if "Feature" in together(tmp_path / "out") else json.loads(together(tmp_path / "out"))["geometries"] == [{"k": 1}, {"k": 2}]
    for wrong in ({"stor": "x"}, {"dialect": "none"}):
        (tmp_path / "wrong.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError, match="no such"):
            Settings.read(str(tmp_path / "wrong.json"))
    with pytest.raises(ValueError, match="store"):
        Settings().open(spark)
