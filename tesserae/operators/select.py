"""Selection and the projections over what a query selects. Everything stays lazy and JVM-side."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.values import shown
from tesserae.model import normalize_layer
from tesserae.plans.lower import plan
from tesserae.plans.translate import to_column


def condition(docs: DataFrame, tree: object) -> Column:
    """The filter for a predicate tree. Range columns that `docs` has are used for pruning."""
    indexed = frozenset(c[3:-4] for c in docs.columns if c.startswith("ix_") and c.endswith("_min") and not c.endswith("_smin"))
    return to_column(tree, indexed, "text" in docs.columns)


def select(docs: DataFrame, query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    """The documents for which the query holds."""
    return docs.where(condition(docs, plan(query, dialect, layer)))


def paths(docs: DataFrame, *args: object, **kw: object) -> DataFrame:
    return select(docs, *args, **kw).select("path")


def meta(docs: DataFrame, chunk_meta: DataFrame, *args: object, **kw: object) -> DataFrame:
    """Path and chunk metadata of each match; the dimension is joined by its key, broadcast if it is small."""
    return select(docs, *args, **kw).select("path", "meta_id").join(chunk_meta, "meta_id", "left")


def distinct_meta(docs: DataFrame, *args: object, **kw: object) -> DataFrame:
    return select(docs, *args, **kw).select("meta_id").distinct()


def page(docs: DataFrame, query: object = None, size: int = 100, scroll_id: str | None = None, **kw: object) -> DataFrame:
    """Keyset paging: the next `size` matches after `scroll_id` in path order. The last path is the next scroll_id."""
    found = select(docs, query, **kw)
    if scroll_id is not None:
        found = found.where(F.col("path") > scroll_id)
    return found.orderBy("path").limit(size)


def pages(docs: DataFrame, query: object = None, size: int = 100, **kw: object) -> DataFrame:
    """All pages at once: path and meta_id of the matches, and the page, from 0 on, that `page` would give each in. They are
    sorted once; the sizes of the sorted partitions are all that the driver sees."""
    rows = select(docs, query, **kw).select("path", "meta_id").orderBy("path").rdd  # one RDD, so its partitions stay as they are counted
    starts = [0, *accumulate(rows.mapPartitions(lambda it: [sum(1 for _ in it)]).collect())]
    placed = rows.mapPartitionsWithIndex(lambda k, it: ((*r, n // size) for n, r in enumerate(it, starts[k])))
    return docs.sparkSession.createDataFrame(placed, "path string, meta_id string, page bigint", verifySchema=False)


def property_values(docs: DataFrame, name: str, *args: object, **kw: object) -> DataFrame:
    return _distinct_values(select(docs, *args, **kw), "props", name)


def attribute_values(docs: DataFrame, name: str, *args: object, **kw: object) -> DataFrame:
    return _distinct_values(select(docs, *args, **kw), "attrs", name)


def _distinct_values(docs: DataFrame, field: str, name: str) -> DataFrame:
    found = F.filter(field, lambda e: e["key"] == name)
    return docs.select(F.explode(found).alias("e")).select("e.t", shown(F.col("e")).alias("value")).distinct()


def layers(docs: DataFrame) -> DataFrame:
    return docs.select("layer").distinct()


def _with_ancestors(layer: Column) -> Column:
    parts = F.split(F.rtrim(layer, F.lit("/")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(layer == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), up))


def layers_with_ancestors(docs: DataFrame) -> DataFrame:
    """Each layer and all folders above it, the root included."""
    return layers(docs).select(F.explode(_with_ancestors(F.col("layer"))).alias("layer")).distinct()


def layer_exists(docs: DataFrame, name: str) -> bool:
    return not docs.where(F.col("layer").startswith(normalize_layer(name))).select("path").limit(1).isEmpty()


def mime_per_layer(docs: DataFrame) -> DataFrame:
    """Layers all of whose documents are JSON, or all XML."""
    return _of_one_kind(_kinds(docs))


def collections(docs: DataFrame) -> DataFrame:
    """The same for layers and all folders above them: one aggregation by layer, then one over the few layers there are."""
    above = _kinds(docs).withColumn("layer", F.explode(_with_ancestors(F.col("layer"))))
    return _of_one_kind(above.groupBy("layer").agg(F.every("json").alias("json"), F.every("xml").alias("xml")))


def _kinds(docs: DataFrame) -> DataFrame:
    json, xml = F.col("mime").rlike(r"^application/([\w.-]+\+)?json$"), F.col("mime").rlike(r"^(application|text)/([\w.-]+\+)?xml$")
    return docs.groupBy("layer").agg(F.every(json).alias("json"), F.every(xml).alias("xml"))


def _of_one_kind(found: DataFrame) -> DataFrame:
    return found.where("json or xml").select("layer", F.when(F.col("json"), "json").otherwise("xml").alias("kind"))
