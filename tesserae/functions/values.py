"""Columns of tagged values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.model import VALUES


def value(key: str, c: Column | str, t: str) -> Column:
    """A tagged element from a column; t: s, l or d."""
    c = F.col(c) if isinstance(c, str) else c
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(t).alias("t"),
        (c.cast("string") if t == "s" else null("string")).alias("s"),
        (c.cast("bigint") if t == "l" else null("bigint")).alias("l"),
        (c.cast("double") if t == "d" else null("double")).alias("d"),
    )


def values(*found: Column) -> Column:
    """An array of tagged elements; those without a value are left out."""
    if not found:
        return F.array().cast(VALUES)
    return F.filter(F.array(*found), lambda e: e["s"].isNotNull() | e["l"].isNotNull() | e["d"].isNotNull())


def shown(e: Column) -> Column:
    """A tagged element's value as text."""
    return F.coalesce(e["s"], e["l"].cast("string"), e["d"].cast("string"))
