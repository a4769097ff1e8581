"""Connected components of links between 64-bit ids, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import needing, table

ROUNDS = 60
FEW = 200_000  # links that one task resolves by itself (under 50 MB); beyond, rounds of stars do it in parallel


def forest(edges: DataFrame, held_links: int = 1 << 17) -> DataFrame:
    """Each partition's links as stars: as many as it has ids, whatever the number of links, of which so many are held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (p := up.setdefault(x, x)) != x:
                    up[x] = x = up[p]
                return x

            for a, b in pairs:
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            found = [(x, root(x)) for x in [*up]]
            found = [p for p in found if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list[tuple[int, int]] = []
        for batch in it:
            held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            if len(held) >= held_links:
                yield flush(held)
                held = []
        yield flush(held)

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, label from links (a, b): label is the smallest id that can be reached. Ids without links don't appear.

    Links are contracted in each partition first. Each round halves distances at least; a table in the shared folder
    cuts the lineage after each. Only a count and a checksum of the links come to the driver.
    """
    now, seen = table(forest(edges).distinct(), "stars"), None
    if now.limit(FEW + 1).count() <= FEW:
        one = table(needing(forest(now.coalesce(1), FEW + 1), now), "stars")
        return table(needing(one.select(F.col("a").alias("node"), F.col("b").alias("label")).union(one.select("b", "b").distinct()), one), "labels")
    for _ in range(ROUNDS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = large.join(low, F.col("a") == F.col("u"))
        small = hung.select("a", F.col("m").alias("b")).union(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = table(needing(small.distinct(), now), "stars")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return table(needing(now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct()), now), "labels")
