"""Sharding by a Hilbert curve: quantised metadata, sorted by curve index, cut into runs of equal row counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import partitions, release, table, unused


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points with `bits` bits a dimension (Skilling's transform)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | ((a >> b) & 1)
    return out


def _string_cuts(df: DataFrame, column: Column, cells: int) -> list[str]:
    """Values that cut the rows, in order of whole strings, into `cells` runs of about equal size; fewer if values repeat.

    Counts by value are summed before they are sorted; a window runs over one range of values at a time. Sums of ranges
    and the cuts themselves are all that the driver sees."""
    spark = df.sparkSession
    counts = df.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = table(counts.repartitionByRange(partitions(spark), "v").withColumn("p", F.spark_partition_id()), "values")
    sums = ranges.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    total, starts, at = sum(r["n"] for r in sums), {}, 0
    for r in sums:
        starts[r["p"]] = at
        at += r["n"]
    if not total:
        return []
    first = F.element_at(F.create_map(*(F.lit(x) for p in starts.items() for x in p)), F.col("p"))
    before = first + F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = lambda rows: F.floor(rows * cells / total)
    crossing = ranges.withColumn("before", before).where(cell(F.col("before") + F.col("n")) > cell(F.col("before")))
    found = [r["v"] for r in crossing.select("v").collect()]  # `cells` at most
    release(ranges)
    return sorted(found, key=lambda v: v.encode())


def _cells(df: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """The cell of each row in each dimension: how many of the cuts, 2^bits - 1 at most, are less than its value."""
    kinds = dict(df.dtypes)
    texts = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in dimensions if kinds[c] == "string"}
    low = {c: F.lit(-(1 << 63)) if kinds[c] in ("bigint", "int", "smallint", "tinyint") else F.lit(float("-inf")) for c in dimensions if c not in texts}
    numbers = {c: F.coalesce(F.col(f"`{c}`").cast("bigint" if "int" in kinds[c] else "double"), v) for c, v in low.items()}
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*(F.percentile_approx(x, at, 2000).alias(f"c{i}") for i, x in enumerate(numbers.values()))).first() if numbers else []
    cuts = dict(zip(numbers, found, strict=True)) | {c: _string_cuts(df, x, 1 << bits) for c, x in texts.items()}
    below = lambda edges, x: F.size(F.filter(edges, lambda v: v < x))
    out = []
    for c in dimensions:
        x, kind = (texts | numbers)[c], "string" if c in texts else "bigint" if "int" in kinds[c] else "double"
        edges = F.array(*(F.lit(v) for v in sorted(set(cuts[c] or []), key=lambda v: v.encode() if isinstance(v, str) else v))).cast(f"array<{kind}>")
        out.append(below(edges, x))
    return out


def curve_shards(df: DataFrame, dimensions: list[str], tie: list[str], shards: int = 8, bits: int = 5) -> DataFrame:
    """Adds curve (long), shard (int) and slot (long) under the `rows` law: shard sizes differ by one at most.

    Dimensions are cut at 2^bits - 1 quantiles over all rows (of numbers approximate, of strings exact, by whole values),
    so that every cell range is used. The rank of a row comes from a range partitioning by (curve, tie): counts of
    partitions are the only thing the driver sees. Null: smallest, as an empty string. Ties: by the `tie` columns; rows
    alike in all of them, repeated rows among them, stand in any order. Very long strings: compared whole. Empty tables
    give empty results. Columns of the table stay as they are; a new one whose name is taken has underscores behind it.
    """
    spark = df.sparkSession
    columns = [f"`{c}`" for c in df.columns]

    @F.pandas_udf("bigint")
    def curve(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert([cols[name].to_numpy() for name in cols], bits))

    made = unused(df, "curve")
    names = {c: unused(df, c) for c in ("shard", "slot")}
    cells = F.struct(*(c.alias(f"d{i}") for i, c in enumerate(_cells(df, dimensions, bits))))
    placed = df.select(F.struct(*columns).alias("row"), curve(cells).alias("curve"))
    order = ["curve", *(f"row.`{c}`" for c in tie)]
    dealt = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = table(dealt, "curve")
    counts = kept.groupBy(F.shiftright("at", 33).alias("p")).count().orderBy("p").collect()  # one row for each partition
    total = sum(r["count"] for r in counts)
    first, start = {}, 0
    for r in counts:
        first[r["p"]] = start
        start += r["count"]
    low, more = divmod(total, shards)
    head = F.lit([first.get(p, 0) for p in range(max(first, default=0) + 1)])
    rank = F.element_at(head, (F.shiftright("at", 33) + 1).cast("int")).cast("bigint") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = kept.withColumn("rank", rank)
    edge = more * (low + 1)
    early = F.col("rank") < edge
    shard = F.when(early, F.floor(F.col("rank") / (low + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(low, 1)))
    slot = F.when(early, F.col("rank") % (low + 1)).otherwise((F.col("rank") - edge) % max(low, 1))
    return ranked.select("row.*", F.col("curve").alias(made), shard.cast("int").alias(names["shard"]), slot.cast("bigint").alias(names["slot"]))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A folder for each shard, in it a file for each run of slots, written by as many tasks as there are runs. Each file
    is a piece of the curve, so its footer has narrow ranges in every dimension."""
    run = F.floor(F.col("slot") / rows_per_file)
    rows = df.agg(F.max("slot")).first()[0]
    tasks = max(1, df.select("shard").distinct().count() * (1 + (rows or 0) // rows_per_file))
    df.repartition(tasks, "shard", run).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of op5: every document once, with size, checksum, shard and slot. Null text: size 1. Other columns of the
    table are not read, whatever their names; for the rest see `curve_shards`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = curve_shards(slim, ["size", "lang", "source", "doc_id"], ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
