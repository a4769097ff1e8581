"""Relational tables as documents, so that the query languages work on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import norm_column, token_column
from tesserae.functions.values import value, values
from tesserae.model import DOCUMENT
from tesserae.plans.translate import index_name


def documents(
    df: DataFrame,
    path: Column,
    layer: Column,
    attrs: list[Field] = (),
    props: list[Field] = (),
    tags: list[Column] = (),
    text: Column | None = None,
    box: tuple[Column, Column, Column, Column] | None = None,
) -> DataFrame:
    """Rows in the store's shape; columns that are not named are empty. All of it is lazy and JVM-side.

    Every attribute and property also gives the range columns of its key, which are nothing but the table's own column, so
    that comparisons reach the table's scan; and the raw text stays beside its words, which are made only where needed."""
    found = [x.field for x in (*attrs, *props)]
    once = {k: (c, t) for k, c, t in found if sum(o[0] == k for o in found) == 1 and t in ("s", "l", "d")}
    ranges = {index_name(k, part): (c if (t == "s") == part.startswith("s") else F.lit(None)).cast("string" if part.startswith("s") else "double") for k, (c, t) in once.items() for part in ("min", "max", "smin", "smax")}
    attrs, props = [x.column for x in attrs], [x.column for x in props]
    given = {
        "path": path,
        "layer": layer,
        "attrs": values(*attrs),
        "props": values(*props),
        "tags": F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>"),
        "gml_ids": F.array().cast("array<string>"),
        "geojson_ids": F.array().cast(DOCUMENT["geojson_ids"].dataType),
    } | (dict(zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)) if box else {})
    shape = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT]
    out = df.select(*shape, (F.lit("") if text is None else text).alias("text"), *(c.alias(n) for n, c in ranges.items()))
    out = out.withColumn("tokens", token_column(F.col("text")))
    return out.withColumn("text_norm", norm_column(F.col("tokens")))


@dataclass(frozen=True)
class Field:
    """An attribute or property of a row: key, column and type, and the tagged value they make."""

    field: tuple[str, Column, str]
    column: Column


def field(key: str, c: Column | str, t: str) -> Field:
    return Field((key, F.col(c) if isinstance(c, str) else c, t), value(key, c, t))


def key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(
        read(spark, sf_dir, "part"),
        key("part", "p_partkey"),
        F.concat(F.lit("catalog/"), F.lower("p_type"), F.lit("/")),
        attrs=[field("name", "p_name", "s"), field("brand", "p_brand", "s"), field("type", "p_type", "s"), field("size", "p_size", "l"), field("retailprice", "p_retailprice", "d")],
        tags=[F.col("p_brand")],
        text=F.col("p_name"),
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(
        read(spark, sf_dir, "documents"),
        key("doc", "doc_id"),
        F.concat(F.lit("text/"), F.col("lang"), F.lit("/")),
        attrs=[field("source", "source", "s"), field("n_chars", "n_chars", "l")],
        tags=[F.col("lang")],
        text=F.col("text"),
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(
        read(spark, sf_dir, "events"),
        key("event", "event_id"),
        F.concat(F.lit("events/"), F.col("event_type"), F.lit("/")),
        attrs=[field("value", "value", "d"), field("user_id", "user_id", "l")],
        props=[field("k", F.get_json_object("props", "$.k").cast("bigint"), "l")],
        tags=[F.col("event_type")],
    )


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("embedding")[0].cast("double") * 180, F.col("embedding")[1].cast("double") * 90
    return documents(read(spark, sf_dir, "embeddings"), key("vec", "vec_id"), F.lit("vec/"), attrs=[field("label", "label", "l")], box=(x, y, x, y))


def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region as a folder; both tables are dimension tables of fixed size."""
    region = F.broadcast(read(spark, sf_dir, "region"))
    df = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return documents(
        df,
        key("nation", "n_nationkey"),
        F.concat(F.lit("geo/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/")),
        attrs=[field("name", "n_name", "s"), field("regionkey", "n_regionkey", "l")],
        tags=[F.col("r_name")],
        text=F.col("n_name"),
    )


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(
        read(spark, sf_dir, "customer"),
        key("customer", "c_custkey"),
        F.concat(F.lit("people/"), F.lower("c_mktsegment"), F.lit("/")),
        attrs=[field("name", "c_name", "s"), field("acctbal", "c_acctbal", "d"), field("nationkey", "c_nationkey", "l")],
        tags=[F.col("c_mktsegment")],
        text=F.col("c_name"),
    )
