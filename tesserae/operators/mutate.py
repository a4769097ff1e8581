"""Bulk changes as projections: a new version of the documents, in one pass and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.values import value
from tesserae.model import VALUES, tagged
from tesserae.plans.lower import plan
from tesserae.plans.translate import to_column


def _where(query: object, dialect: str, layer: str | None) -> Column:
    return F.coalesce(to_column(plan(query, dialect, layer)), F.lit(False))


def _strings(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def add_tags(docs: DataFrame, tags: list[str], query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    """Set union: tags that a document has already stay where they are."""
    new = F.array_union(F.coalesce("tags", _strings([])), _strings(tags))
    return docs.withColumn("tags", F.when(_where(query, dialect, layer), new).otherwise(F.col("tags")))


def remove_tags(docs: DataFrame, tags: list[str], query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    new = F.filter("tags", lambda t: ~t.isin(*tags))
    return docs.withColumn("tags", F.when(_where(query, dialect, layer), new).otherwise(F.col("tags")))


def set_properties(docs: DataFrame, props: dict, query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    """Replaces properties of the same keys, then appends the new ones."""
    new = [value(k, F.lit(t[t["t"]]), t["t"]) for k, v in props.items() for t in (tagged(k, v),)]
    kept = F.filter(F.coalesce("props", F.array().cast(VALUES)), lambda e: ~e["key"].isin(*props))
    return docs.withColumn("props", F.when(_where(query, dialect, layer), F.concat(kept, F.array(*new))).otherwise(F.col("props")))


def remove_properties(docs: DataFrame, keys: list[str], query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    new = F.filter("props", lambda e: ~e["key"].isin(*keys))
    return docs.withColumn("props", F.when(_where(query, dialect, layer), new).otherwise(F.col("props")))


def delete(docs: DataFrame, query: object = None, dialect: str = "prefix", layer: str | None = None) -> DataFrame:
    """What is left. Rows for which the query is unknown stay."""
    return docs.where(~_where(query, dialect, layer))


def delete_paths(docs: DataFrame, paths: DataFrame) -> DataFrame:
    return docs.join(paths.select("path").distinct(), "path", "left_anti")
