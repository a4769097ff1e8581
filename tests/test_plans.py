"""Both query languages, their errors, and what predicates select from a small index of lakes."""

import random

import pytest

from tesserae.functions import crs, spatial
from tesserae.model import DOCUMENT, normalize_layer, tagged
from tesserae.operators import mutate, select
from tesserae.plans import infix, labels, prefix
from tesserae.plans.lower import plan
from tesserae.plans.nodes import And, BBox, ElemCompare, Keyed, Not, Or, QuerySyntaxError, StartsWith, StringRangeError, Value
from tesserae.plans.translate import index_columns


@pytest.mark.parametrize(("text", "tree"), [
    ("river", Value("river")),
    ("river\n\r lake", Or((Value("river"), Value("lake")))),
    ('"the \\"old\\" mill"', Value('the "old" mill')),
    ("'Anna\\'s'", Value("Anna's")),
    ("70", Value(70)), ("+70", Value(70)), ("-2.25e2", Value(-225.0)), (".125", Value(0.125)), ("7b", Value("7b")), ("b7", Value("b7")),
    ("18446744073709551616", Value(2.0**64)),
    ("AND(river lake)", And((Value("river"), Value("lake")))),
    ("OR ( river )", Value("river")),
    ("NOT(river lake)", Not(Or((Value("river"), Value("lake"))))),
    ("EQ(depth low)", Keyed("depth", "eq", "low")), ("EQ('max depth' 31)", Keyed("max depth", "eq", 31)), ("LTE(depth 0.5)", Keyed("depth", "lte", 0.5)),
    ('"NOT"', Value("NOT")), ("NOTES", Value("NOTES")),
    ("AND(river OR(lake pond)) NOT(EQ(depth 9))", Or((And((Value("river"), Or((Value("lake"), Value("pond"))))), Not(Keyed("depth", "eq", 9))))),
    ("-3.5,40.25,-3.25,40.5", BBox(-3.5, 40.25, -3.25, 40.5)),
    ("", None),
])
def test_prefix(text, tree):
    assert prefix.parse(text) == tree


@pytest.mark.parametrize("text", ["EQ(name two words)", "EQ(depth)", "EQ(4 5)", "OR()", "OR(river", "river)", "'open", "GT(depth NOT)", "NOT"])
def test_prefix_errors(text):
    with pytest.raises(QuerySyntaxError):
        prefix.parse(text)


@pytest.mark.parametrize(("text", "tree"), [
    ('\t"wide lake" ', Value("wide lake")), ('"a \\" b"', Value('a " b')), ('"\\u00e9t\\u00E9\\t"', Value("été\t")), ('"\\\\u0041"', Value("\\u0041")),
    ("8", Value(8)), ("8.", Value(8.0)), ("-0.75", Value(-0.75)), (".75", Value(0.75)), ("3.E-2", Value(0.03)), ("6e2", Value(600.0)),
    ('"lake" && 8', And((Value("lake"), Value(8)))), ('"lake"&&8', And((Value("lake"), Value(8)))), ('"lake" AnD "pond"', And((Value("lake"), Value("pond")))),
    ('"x" or "y" && "z"', Or((Value("x"), And((Value("y"), Value("z")))))), ('"x" || "y" || "z"', Or((Value("x"), Value("y"), Value("z")))),
    ('("x" or "y") && "z"', And((Or((Value("x"), Value("y"))), Value("z")))),
    ("depth == 9", Keyed("depth", "eq", 9)), ("depth=9", Keyed("depth", "eq", 9)), ("depth != 9", Not(Keyed("depth", "eq", 9))), ("depth!==9", Not(Keyed("depth", "eq", 9))),
    ("lücke-1 >= 0.25", Keyed("lücke-1", "gte", 0.25)), ("`max depth` < 4", Keyed("max depth", "lt", 4)),
    ("!(depth > 9)", Not(Keyed("depth", "gt", 9))), ("! ( depth > 9 )", Not(Keyed("depth", "gt", 9))),
    ("bbox(5, 6, 7, 8)", BBox(5, 6, 7, 8)), ("RECT(7,8,5,6)", BBox(5, 6, 7, 8)),
])
def test_infix(text, tree):
    assert infix.parse(text) == tree


@pytest.mark.parametrize(("text", "pos", "kind"), [
    ('"a\\u12 b"', 6, "hex_digit"), ('"\\u00zz"', 5, "hex_digit"), ('"\\u"', 3, "hex_digit"), ('"mill \\q"', 7, "escape"), (" \"it\\'s\"", 5, "escape"),
    ('"\\udc00x"', 1, "code_point"), ('"a"OR8', 3, "unexpected"), (" ", 0, "empty"), ("7e+", 0, "invalid_number"), ("depth >=", 8, "unexpected"), ("rect(1,2,3)", 10, "unexpected"),
])
def test_infix_errors(text, pos, kind):
    with pytest.raises(QuerySyntaxError) as e:
        infix.parse(text)
    assert (e.value.pos, e.value.kind) == (pos, kind)


def test_labels():
    assert labels.parse_tags("wet,'very wet',\"dry\"") == ["wet", "very wet", "dry"]
    assert labels.parse_properties("kind:lake,depth:31,'mean depth':-0.5,kind:9m") == {"kind": "9m", "depth": 31, "mean depth": -0.5}
    for bad in ("", "wet,", "wet dry", "kind:lake"):
        with pytest.raises(QuerySyntaxError):
            labels.parse_tags(bad) if bad != "kind:lake" else labels.parse_properties("kind,depth")


def test_layers_are_normalized():
    assert [normalize_layer(x) for x in ("", "/", "a", "/a/b", "a//b/", None)] == ["", "", "a/", "a/b/", "a/b/", ""]
    assert plan("foo", layer="/x") == And((plan("foo"), StartsWith("layer", "x/")))


#: Five lakes: two have numbers, three have boxes, one of which lies across the meridian of Greenwich.
LAKES = [
    ("a", [("name", "Long Water")], (None,) * 4),
    ("b", [("name", "Upper Long Lake"), ("depth", 254), ("area", 536.5)], (8.9, 47.4, 9.8, 47.9)),
    ("c", [("name", "Salt Pan"), ("depth", 2)], (-0.5, 38.0, 0.25, 38.5)),
    ("d", [("name", "Tarn")], (None,) * 4),
    ("e", [("name", "Lower Lake"), ("depth", 60), ("area", 90.0)], (-76.0, -14.5, -68.5, -12.0)),
]


@pytest.fixture(scope="module")
def mini(spark):
    from tesserae.store import Store

    rows = []
    for i, attrs, box in LAKES:
        row = dict.fromkeys(DOCUMENT.names) | {"path": i, "layer": "", "tags": [], "props": [], "gml_ids": [], "geojson_ids": [], "attrs": [tagged(k, v) for k, v in attrs]}
        rows.append(row | dict(zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)))
    store = Store(spark, "/nowhere", indexed_fields=("depth", "area"))
    return store.shaped(spark.createDataFrame(rows, DOCUMENT)).cache()


ALL = "a b c d e"


@pytest.mark.parametrize(("query", "ids"), [
    ('"tarn"', "d"), ('"TARN"', "d"), ('"tarn" || "pan"', "c d"), ('"long lake"', "b"), ('"upper lake"', ""), ('"lake"', "b e"), ('"lak"', ""), ('"536.5"', "b"), ("536.5", "b"), ("90", "e"),
    ('name == "Lower Lake"', "e"), ('name == "Lower"', ""), ('name == "tarn"', ""),
    ("depth == 2", "c"), ('depth == "2"', ""), ("depth == 536", ""), ("depth == 2.0", ""), ("area == 536.5", "b"), ("area == 536", ""), ("area == 90.0", "e"), ("area == 90", ""),
    ("depth > 1", "b c e"), ("depth > 59", "b e"), ("depth > 254", ""), ("depth >= 254", "b"), ("depth < 60", "c"), ("depth <= 60", "c e"), ("depth < 2", ""),
    ("area > 89.9", "b e"), ("area > 90.0", "b"), ("area > 536.5", ""), ("area > 100", ""), ("area <= 536.5", "b e"),
    ("!(depth == 2)", "a b d e"), ("!(depth == 2 || depth == 60)", "a b d"), ("depth != 60", "a b c d"),
    ('depth == 2 || "?!"', "c"), ('"?!"', ALL), ('!("?!")', ALL), ('depth == 2 || !("?!")', "c"),
    ("bbox(0,0,20,60)", "b c"), ("bbox(-180,-90,-1,90)", "e"), ("bbox(8.9, 47.4, 9.8, 47.9)", "b"), ("bbox(9.8, 47, 12, 48)", "b"), ("bbox(9.80001, 47, 12, 48)", ""), ("bbox(0.25, 38.5, 1, 39)", "c"),
])
def test_infix_on_the_small_index(mini, query, ids):
    found = select.select(mini, query, "infix").select("path").collect()
    assert " ".join(sorted(r[0] for r in found)) == ids


def test_string_ranges_are_errors_in_infix():
    with pytest.raises(StringRangeError):
        plan('name > "a"', "infix")


@pytest.mark.parametrize(("query", "ids"), [
    ("Tarn", "d"), ("tarn", ""), ("Lake", ""), ("EQ(depth 2.0)", "c"), ('EQ(depth "2")', ""), ("GT(area 100)", "b"), ("LT(depth 255)", "b c e"), ('GTE(name "Salt")', "b c d"),
    ("NOT(EQ(depth 60))", "a b c d"), ("EQ(depth 9007199254740993)", ""), ("", ALL), ("AND(GT(depth 1) LT(area 100))", "e"),
])
def test_prefix_on_the_small_index(mini, query, ids):
    found = select.select(mini, query).select("path").collect()
    assert " ".join(sorted(r[0] for r in found)) == ids


def test_duplicate_keys_match_any(spark, mini):
    two = spark.createDataFrame([("x", [tagged("name", "Mere"), tagged("name", "Loch")])], "path string, attrs array<struct<key:string,t:string,s:string,l:bigint,d:double>>")
    for v in ("Mere", "Loch"):
        assert select.select(two, f'name == "{v}"', "infix").count() == 1


def test_range_columns_prune(spark, mini, tmp_path):
    mini.write.parquet(str(tmp_path / "d"))
    plan_text = select.select(spark.read.parquet(str(tmp_path / "d")), "GT(depth 59)")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ix_depth_max,59.0)" in plan_text
    assert set(index_columns(["a"])) == {"ix_a_min", "ix_a_max", "ix_a_smin", "ix_a_smax"}


def test_pages(spark):
    df = spark.createDataFrame([(f"lake/{i:02}",) for i in range(5)], "path string")
    sizes, scroll = [], None
    while True:
        rows = select.page(df, None, 3, scroll).collect()
        sizes.append(len(rows))
        if not rows:
            break
        scroll = rows[-1].path
    assert sizes == [3, 2, 0]


def test_ids_and_addresses(spark):
    row = dict.fromkeys(DOCUMENT.names) | {"path": "p", "tags": ["t"], "props": [], "attrs": [], "gml_ids": ["G1"], "geojson_ids": [tagged("id", 7), tagged("id", "f")], "address": {"Country": "Chile", "Locality": "Arica", "Street": None, "Number": None}, "correlation_id": "c"}
    df = spark.createDataFrame([row], DOCUMENT)
    for q, n in (("G1", 1), ("EQ(gmlId G1)", 1), ("EQ(gml:id G1)", 1), ("GT(gmlId G0)", 0), ("EQ(id 7)", 1), ("EQ(geoJsonFeatureId f)", 1), ("Chile", 1), ("EQ(Locality Arica)", 1), ("GT(Locality Ari)", 0), ("EQ(correlationId c)", 1), ("t", 1), ("c", 0)):
        assert select.select(df, q).count() == n, q


def test_random_boxes_through_cells():
    r = random.Random(42)

    def box():
        x, y, w, h = r.uniform(-180, 180), r.uniform(-90, 90), 10 ** r.uniform(-4, 1.5), 10 ** r.uniform(-4, 1.5)
        return max(x - w, -180), max(y - h, -90), min(x + w, 180), min(y + h, 90)

    stored = [box() for _ in range(400)]
    terms = [set(spatial.index_terms(b)) for b in stored]
    candidates = 0
    for _ in range(100):
        q = box()
        wanted = set(spatial.query_terms(q))
        hit = {i for i, t in enumerate(terms) if t & wanted}
        real = {i for i, b in enumerate(stored) if b[0] <= q[2] and b[2] >= q[0] and b[1] <= q[3] and b[3] >= q[1]}
        assert real <= hit
        candidates += len(hit)
    assert candidates / 100 < 40
    assert all(len(spatial.covering(*b)) <= spatial.MAX_CELLS for b in stored)


def test_coordinate_systems():
    x, y = crs.to_wgs84("EPSG:31467", [(3477534.683, 5605739.857)])[0]
    assert abs(x - 8.681739535269804) < 1e-5 and abs(y - 50.58691850210496) < 1e-5
    x, y = crs.to_wgs84("urn:ogc:def:crs:EPSG::25832", [(500000.0, 5538630.703)])[0]
    assert abs(x - 9) < 1e-9 and abs(y - 50) < 1e-5
    assert crs.to_wgs84("epsg:4326", [(49.0, 8.0)]) == [(8.0, 49.0)] and crs.to_wgs84("urn:ogc:def:crs:OGC:1.3:CRS84", [(8.0, 49.0)]) == [(8.0, 49.0)]
    assert crs.decode("urn:ogc:def:crs,crs:EPSG::25832,crs:EPSG::5783") == "EPSG:25832"
    assert crs.decode('PROJCS["x", GEOGCS["y", AUTHORITY["EPSG","4314"]], AUTHORITY["EPSG","31467"]]') == "EPSG:31467"
    with pytest.raises(crs.UnknownCRS):
        crs.to_wgs84("EPSG:1", [(0, 0)])
    crs.register("EPSG:1", lambda a, b: (a + 1, b))
    assert crs.to_wgs84("EPSG:1", [(0, 0)]) == [(1, 0)]


@pytest.mark.parametrize(("code", "x", "y", "lon", "lat"), [
    (2154, 652469, 6862035, 2.3522, 48.8566), (27700, 651409.903, 313177.270, 1.71605, 52.65798), (3035, 3962799.45, 2999718.85, 5, 50), (28992, 155000, 463000, 5.3872, 52.15517),
    (2056, 2600000, 1200000, 7.43863, 46.95108), (21781, 600000, 200000, 7.43863, 46.95108), (31287, 400000, 400000, 13.33259, 47.49948), (27572, 600000, 2200000, 2.33653, 46.79995), (3006, 500000, 0, 15, 0), (23032, 500000, 4649776, 8.999, 41.9982),
])
def test_projected_systems(code, x, y, lon, lat):
    a, b = crs.to_wgs84(f"EPSG:{code}", [(x, y)])[0]
    assert abs(a - lon) < 2e-4 and abs(b - lat) < 2e-4


def test_projections_on_their_own_ellipsoids():
    """Points that the guidance on these methods gives, before any shift of the datum."""
    own = {n: crs.SYSTEMS[n] for n in (27700, 28992, 5514)}
    for n, x, y, lon, lat in ((27700, 651409.903, 313177.270, 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600), (28992, 196105.283, 557057.739, 6, 53), (5514, -568991.00, -1050538.63, 16 + 50 / 60 + 59.179 / 3600, 50 + 12 / 60 + 32.442 / 3600)):
        method, ell, _, parameters = own[n]
        a, b = crs.METHODS[method](x, y, crs.ELLIPSOIDS[ell], **parameters)
        assert abs(a - lon) < 1e-6 and abs(b - lat) < 1e-6


def test_systems_spelled_out():
    wkt = 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["GRS 1980",6378137,298.257222101],TOWGS84[0,0,0]],UNIT["degree",0.0174532925]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",49],PARAMETER["standard_parallel_2",44],PARAMETER["latitude_of_origin",46.5],PARAMETER["central_meridian",3],PARAMETER["false_easting",700000],PARAMETER["false_northing",6600000],UNIT["metre",1]]'
    assert crs.to_wgs84(wkt, [(652469, 6862035)]) == crs.to_wgs84("EPSG:2154", [(652469, 6862035)])
    feet = wkt.replace('UNIT["metre",1]', 'UNIT["foot",0.3048]').replace("700000", str(700000 / 0.3048)).replace("6600000", str(6600000 / 0.3048))
    assert crs.to_wgs84(feet, [(652469 / 0.3048, 6862035 / 0.3048)])[0] == pytest.approx(crs.to_wgs84(wkt, [(652469, 6862035)])[0])
    with pytest.raises(crs.UnknownCRS):
        crs.to_wgs84(wkt.replace("Lambert_Conformal_Conic_2SP", "Polyconic"), [(0, 0)])


def test_changes(spark):
    row = dict.fromkeys(DOCUMENT.names) | {"path": "p", "tags": ["a", "b"], "props": [tagged("k", 1), tagged("m", "x")], "attrs": []}
    df = spark.createDataFrame([row], DOCUMENT)
    assert mutate.add_tags(df, ["b", "c"]).first().tags == ["a", "b", "c"]
    assert mutate.remove_tags(df, ["a", "z"]).first().tags == ["b"]
    assert [(p.key, p.s, p.l, p.d) for p in mutate.set_properties(df, {"k": "v", "n": 1.5}).first().props] == [("m", "x", None, None), ("k", "v", None, None), ("n", None, None, 1.5)]
    assert mutate.remove_properties(df, ["k", "m"]).first().props == []
    assert mutate.delete(df, "EQ(k 1)").count() == 0 and mutate.delete(df, "EQ(k 2)").count() == 1
    assert plan("k == 1", "infix") == ElemCompare("attrs", "k", "eq", 1, strict=True)
