"""The registered queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import rendered
from tesserae.operators import mutate, select
from tesserae.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
PART = "select *, 'part/' || p_partkey as path from part"
TEXT = "select *, 'doc/' || doc_id as path, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' as norm from documents"
EVENT = "select *, 'event/' || event_id as path, cast(json_extract_string(props, '$.k') as bigint) as k from events"
VEC = "select *, 'vec/' || vec_id as path, embedding[1]::double * 180 as x, embedding[2]::double * 90 as y from embeddings"
SOURCES = {"part": (T.part_documents, PART), "text": (T.text_documents, TEXT), "event": (T.event_documents, EVENT), "vec": (T.vector_documents, VEC), "place": (T.place_documents, ""), "customer": (T.customer_documents, "select *, 'customer/' || c_custkey as path from customer")}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _paths(name: str, source: str, query: str | None, where: str, dialect: str = "prefix", layer: str | None = None) -> None:
    make, sql = SOURCES[source]
    QUERIES[name] = lambda spark, d: select.paths(make(spark, d), query, dialect=dialect, layer=layer)
    ORACLES[name] = f"select path from ({sql}) t where {where}"


def _add(name: str, f: Query, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


_paths("search_and_range_eq", "part", 'AND(GTE(size 10) EQ(brand "Brand#13"))', "p_size >= 10 and p_brand = 'Brand#13'")
_paths("search_layer_prefix", "part", None, "lower(p_type) like 'promo%'", layer="/catalog/promo")
_paths("layer_and_query", "text", 'GT(n_chars 1000)', "lang = 'fr' and n_chars > 1000", layer="text/fr")
_paths("eq_string", "part", 'EQ(brand "Brand#13")', "p_brand = 'Brand#13'")
_paths("eq_int", "part", "EQ(size 15)", "p_size = 15")
_paths("eq_int_as_float", "part", "EQ(size 15.0)", "p_size = 15")
_paths("eq_string_of_int_misses", "part", 'OR(EQ(size "15") EQ(size 16))', "p_size = 16")
_paths("infix_eq_int", "part", "size == 15", "p_size = 15", "infix")
_paths("infix_eq_float_strict_misses", "part", "size == 15.0 || size == 16", "p_size = 16", "infix")
_paths("infix_neq", "part", 'brand != "Brand#13"', "p_brand <> 'Brand#13'", "infix")
for _op, _sql in (("GT", ">"), ("GTE", ">="), ("LT", "<"), ("LTE", "<=")):
    _paths(f"{_op.lower()}_int", "part", f"{_op}(size 25)", f"p_size {_sql} 25")
    _paths(f"{_op.lower()}_float", "event", f"{_op}(value 12.5)", f"value {_sql} 12.5")
    _paths(f"{_op.lower()}_int_on_float", "event", f"{_op}(value 12)", f"value {_sql} 12")
    _paths(f"{_op.lower()}_string", "text", f'{_op}(source "src13")', f"source {_sql} 'src13'")
    _paths(f"infix_{_op.lower()}_int", "part", f"size {_sql} 25", f"p_size {_sql} 25", "infix")
    _paths(f"infix_{_op.lower()}_float", "event", f"value {_sql} 12.5", f"value {_sql} 12.5", "infix")
    _paths(f"infix_{_op.lower()}_int_on_float_misses", "event", f"value {_sql} 12 || user_id {_sql} 50", f"user_id {_sql} 50", "infix")
_paths("and_or_not_nested", "part", 'AND(OR(EQ(size 3) GT(size 40)) NOT(EQ(brand "Brand#13") EQ(type "PROMO")))', "(p_size = 3 or p_size > 40) and not (p_brand = 'Brand#13' or p_type = 'PROMO')")
_paths("infix_precedence", "part", 'size == 3 || size > 40 && brand == "Brand#13"', "p_size = 3 or (p_size > 40 and p_brand = 'Brand#13')", "infix")
_paths("infix_not", "part", "!(size == 3 or size > 40)", "not (p_size = 3 or p_size > 40)", "infix")
_paths("not_of_missing_attribute", "event", "NOT(EQ(k 5))", "k is distinct from 5")
_paths("implicit_or", "part", '"Brand#13" "Brand#21"', "p_brand in ('Brand#13', 'Brand#21') or p_name in ('Brand#13', 'Brand#21')")
_paths("free_value_tag", "event", "purchase", "event_type = 'purchase'")
_paths("free_value_attribute", "text", "src3", "source = 'src3'")
_paths("free_number", "event", "17", "k = 17 or user_id = 17 or value = 17")
_paths("property_eq", "event", "EQ(k 42)", "k = 42")
_paths("property_range", "event", "AND(GTE(k 10) LT(k 20))", "k >= 10 and k < 20")
_paths("prefix_string_range", "text", 'AND(GTE(source "src1") LT(source "src2"))', "source >= 'src1' and source < 'src2'")
_paths("fulltext_term", "text", '"the"', "norm like '% the %'", "infix")
_paths("fulltext_phrase", "text", '"of the"', "norm like '% of the %'", "infix")
_paths("fulltext_and_attribute", "text", '"que" and n_chars > 900', "norm like '% que %' and n_chars > 900", "infix")
_paths("fulltext_or_not", "text", '"der" or !("the")', "norm like '% der %' or not norm like '% the %'", "infix")
_paths("fulltext_empty_term_drops", "text", '"--" or n_chars < 300', "n_chars < 300", "infix")
_paths("bbox_window", "vec", "-10,-5,10,5", "x between -10 and 10 and y between -5 and 5")
_paths("infix_bbox", "vec", "bbox(-10, -5, 10, 5)", "x between -10 and 10 and y between -5 and 5", "infix")
_paths("bbox_swapped_corners", "vec", "rect(10, 5, -10, -5)", "x between -10 and 10 and y between -5 and 5", "infix")
_paths("bbox_and_attribute", "vec", "AND(-20,-10,20,10 EQ(label 3))", "x between -20 and 20 and y between -10 and 10 and label = 3")
_paths("tags_contains", "customer", "BUILDING", "c_mktsegment = 'BUILDING'")



def _some(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which every other has a place, every third a size, and whose layers have names that begin alike."""
    third = F.when(F.col("label") % 3 == 0, F.col("label"))
    x, y = (F.when(F.col("vec_id") % 2 == 0, F.col("embedding")[i].cast("double") * k) for i, k in ((0, 180), (1, 90)))
    layer = F.when(F.col("label") % 2 == 0, "atlas/map/").otherwise("atlas/maps/")
    return T.documents(T.read(spark, d, "embeddings"), T.key("vec", "vec_id"), layer, attrs=[T.field("size", third, "l")], tags=[F.col("vec_id").cast("string")], box=(x, y, x, y))


SOURCES["some"] = (_some, VEC)
_paths("bbox_missing", "some", "-180,-90,180,90", "vec_id % 2 = 0")
_paths("bbox_not", "some", "NOT(-180,-90,0,90)", "vec_id % 2 = 1 or x > 0")
_paths("layer_is_no_name_prefix", "some", None, "label % 2 = 0", layer="atlas/map")
_paths("infix_neq_missing_key", "some", "size != 3", "label % 3 <> 0 or label <> 3", "infix")
_add("search_all", lambda s, d: select.select(_some(s, d)).select("path", "layer", F.size("attrs").alias("n"), F.element_at("tags", 1).alias("tag")), f"select path, case label % 2 when 0 then 'atlas/map/' else 'atlas/maps/' end as layer, case label % 3 when 0 then 1 else 0 end as n, vec_id::varchar as tag from ({VEC}) t")
_paths("bbox_touching_edge", "vec", "0,-90,180,90", "x >= 0 and x <= 180 and y between -90 and 90")
_add("prefix_place_folder", lambda s, d: select.paths(T.place_documents(s, d), None, layer="geo/europe"), "select 'nation/' || n_nationkey as path from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
_add("exists_layer", lambda s, d: s.createDataFrame([(x, select.layer_exists(T.part_documents(s, d), x)) for x in ("catalog", "catalog/promo", "nowhere")], "layer string, found boolean"), "select 'catalog' as layer, count(*) > 0 as found from part union all select 'catalog/promo', coalesce(bool_or(lower(p_type) = 'promo'), false) from part union all select 'nowhere', false")
_add("add_tags", lambda s, d: mutate.add_tags(T.part_documents(s, d), ["x", "y", "x"], "GT(size 25)").select("path", F.array_join("tags", ",").alias("tags")), f"select path, case when p_size > 25 then p_brand || ',x,y' else p_brand end as tags from ({PART}) t")
_add("remove_tags", lambda s, d: mutate.remove_tags(T.part_documents(s, d), ["Brand#13"], "GT(size 25)").select("path", F.array_join("tags", ",").alias("tags")), f"select path, case when p_size > 25 and p_brand = 'Brand#13' then '' else p_brand end as tags from ({PART}) t")
_PROPS = "transform(props, e -> concat(e.key, '=', coalesce(e.s, cast(e.l as string))))"
_add("set_properties", lambda s, d: mutate.set_properties(T.event_documents(s, d), {"k": 7, "note": "n"}, "GTE(k 50)").select("path", F.expr(f"array_join({_PROPS}, ',')").alias("props")), f"select path, case when k >= 50 then 'k=7,note=n' else 'k=' || k end as props from ({EVENT}) t")
_add("remove_properties", lambda s, d: mutate.remove_properties(T.event_documents(s, d), ["k", "other"], "GTE(k 50)").select("path", F.expr(f"array_join({_PROPS}, ',')").alias("props")), f"select path, case when k >= 50 then '' else 'k=' || k end as props from ({EVENT}) t")
_add("delete_by_query", lambda s, d: mutate.delete(T.part_documents(s, d), "GT(size 25)").select("path"), f"select path from ({PART}) t where p_size <= 25")
_add("delete_by_paths", lambda s, d: mutate.delete_paths(T.part_documents(s, d), select.paths(T.part_documents(s, d), "LT(size 10)")).select("path"), f"select path from ({PART}) t where p_size >= 10")
_add("distinct_property_values", lambda s, d: select.property_values(T.event_documents(s, d), "k"), f"select distinct 'l' as t, cast(k as varchar) as value from ({EVENT}) t where k is not null")
_add("distinct_attribute_values", lambda s, d: select.attribute_values(T.text_documents(s, d), "source", "GT(n_chars 1000)"), "select distinct 's' as t, source as value from documents where n_chars > 1000")
_add("layers", lambda s, d: select.layers(T.part_documents(s, d)), "select distinct 'catalog/' || lower(p_type) || '/' as layer from part")
_add("layers_with_ancestors", lambda s, d: select.layers_with_ancestors(T.place_documents(s, d)), "select '' as layer union select 'geo/' union select 'geo/' || lower(r_name) || '/' from nation join region on n_regionkey = r_regionkey union select 'geo/' || lower(r_name) || '/' || lower(n_name) || '/' from nation join region on n_regionkey = r_regionkey")
_add("scroll_page1", lambda s, d: select.page(T.part_documents(s, d), "GT(size 10)", size=50).select("path"), f"select path from ({PART}) t where p_size > 10 order by path limit 50")
_add("scroll_page2", lambda s, d: select.page(T.part_documents(s, d), "GT(size 10)", size=50, scroll_id="part/150").select("path"), f"select path from ({PART}) t where p_size > 10 and path > 'part/150' order by path limit 50")
_MIME = "case when layer = 'text/fr/' then 'application/xml' when layer <> 'text/de/' then 'application/json' when path like '%0' then 'application/gml+xml' else 'application/geo+json' end"
_add("mime_per_layer", lambda s, d: select.mime_per_layer(T.text_documents(s, d).withColumn("mime", F.expr(_MIME))), "select 'text/' || lang || '/' as layer, case when lang = 'fr' then 'xml' else 'json' end as kind from documents where lang <> 'de' group by lang")
_add("distinct_meta", lambda s, d: select.distinct_meta(T.text_documents(s, d).withColumn("meta_id", F.sha2(F.col("layer"), 256)), "GT(n_chars 1000)"), "select distinct sha256('text/' || lang || '/') as meta_id from documents where n_chars > 1000")
_add("attribute_rows", lambda s, d: select.select(T.event_documents(s, d), "GT(value 50)").select("path", F.explode("attrs").alias("e")).select("path", "e.key", "e.t", F.coalesce("e.d", F.col("e.l").cast("double")).alias("value")), f"select path, 'value' as key, 'd' as t, value::double as value from ({EVENT}) t where value > 50 union all select path, 'user_id', 'l', user_id::double from ({EVENT}) t where value > 50")

QUERIES |= rendered.QUERIES
ORACLES |= rendered.ORACLES
