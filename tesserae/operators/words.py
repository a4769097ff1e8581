"""An inverted index of words and of spatial cells: postings in order of term, found by range statistics, phrases by place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.spatial import cells_column, query_terms
from tesserae.functions.text import words
from tesserae.plans.nodes import All, And, BBox, Text

CELL = "\x01"  # begins the terms of cells; no word has it


def postings(docs: DataFrame, cells: bool = False) -> DataFrame:
    """word, path and place of every word of every document, and the cells of its box."""
    rows = docs.select("path", F.posexplode("tokens").alias("place", "word")).select("word", "path", "place")
    if cells:
        boxes = docs.where(F.col("min_x").isNotNull()).select("path", F.explode(cells_column()).alias("c"))
        rows = rows.union(boxes.select(F.concat(F.lit(CELL), "c"), "path", F.lit(0)))
    return ordered(rows)


def ordered(rows: DataFrame) -> DataFrame:
    """In files by term. A term that many documents have goes on over as many files as it needs."""
    return rows.select("word", "path", "place").repartitionByRange("word", "path", "place").sortWithinPartitions("word", "path", "place")


def required(tree: object, cells: bool = False) -> list:
    """Words, phrases and, with `cells`, boxes without which a document can't match."""
    match tree:
        case And(parts):
            return [x for p in parts for x in required(p, cells)]
        case Text():
            return [tree]
        case BBox():
            return [tree] if cells else []
    return []


def without(tree: object, found: list) -> object:
    """What is left to test for documents that the postings gave. A box still is: cells only cover it."""
    match tree:
        case And(parts):
            return And(tuple(without(p, found) for p in parts))
        case Text():
            return All() if tree in found else tree
    return tree


def _paths(rows: DataFrame, wanted: object) -> DataFrame:
    """Paths of the documents that have a word, a phrase, or a cell that meets a box."""
    if isinstance(wanted, BBox):
        terms = [CELL + t for t in query_terms((wanted.min_x, wanted.min_y, wanted.max_x, wanted.max_y))]
        return rows.where(F.col("word").isin(*terms)).select("path").distinct()
    own = words(wanted.text)
    if len(own) == 1:
        return rows.where(F.col("word") == own[0]).select("path").distinct()
    offsets = reduce(lambda c, w: c.when(F.col("word") == w, F.array(*(F.lit(i) for i, x in enumerate(own) if x == w))), sorted(set(own)), F)
    begins = rows.where(F.col("word").isin(*set(own))).select("path", "place", F.explode(offsets).alias("i")).select("path", (F.col("place") - F.col("i")).alias("at"))
    return begins.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own)).select("path").distinct()


def lookup(rows: DataFrame, wanted: list) -> DataFrame:
    """Paths of the documents that have all that is wanted: the filters on terms reach the scan of the postings."""
    return reduce(lambda a, b: a.join(b, "path", "left_semi"), (_paths(rows, w) for w in wanted))
