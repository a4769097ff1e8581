"""I-Match: terms within a band of document frequency, sorted, and hashed under several randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import BLOBS, U, blob_batch, by_bucket, gathered, limited, mix, pack, partitions, slices, table, text_bytes, to_buckets, unpack, word_hashes

SUBSETS = 64
#: Levels of subset sizes: a term is in a subset of level k with chance 2^-(k + 4). Subsets that drop a third of the
#: lexicon, as a single classic fingerprint has them, change with nearly every edit; with small ones of several sizes, the
#: share of subsets that agree falls gradually with the share of terms that differ, for short and for long documents.
LEVELS = 8
LOW, HIGH = 0.001, 0.2  # share of documents a term of the lexicon is in
THIN, FEW = 0.25, 16  # a row with less than this share of lexicon terms, or fewer, falls back, the more so the less
FLUSH = 1 << 22  # terms that a task holds before it sums and sends them (32 MB)


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each row, and the offsets of rows among them."""
    h, off = word_hashes(buf, offsets)
    parts = [np.unique(h[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Hashes of the terms in between `low` and `high` of all distinct texts, counted over all of them; sorted.

    Its size is bounded, whatever the corpus: a document has T distinct terms on average, so at most T / low terms can
    be in a share `low` of the documents (under half a million for T = 480, 4 MB). Counts are summed in each task first.
    Each of c copies of a text counts for 1 / c. Texts that occur once are counted in whole numbers, apart from others.
    """
    spark = docs.sparkSession
    buckets = partitions(spark) * 2

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[np.ndarray] = []
        often: list[tuple] = []  # terms and weights
        for batch in it:
            buf, off = text_bytes(batch.column(0))
            copies = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                t, at = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                of = np.repeat(copies[i:j], np.diff(at))
                once.append(t[of == 1])
                often = summed([*often, (t[of > 1], 1 / of[of > 1])])
                if sum(map(len, once)) > FLUSH:
                    yield flush(*np.unique(np.concatenate(once), return_counts=True), np.int32)
                    once = []
                if len(often[0][0]) > FLUSH:
                    yield flush(*often[0], np.float64)
                    often = []
        if once:
            yield flush(*np.unique(np.concatenate(once), return_counts=True), np.int32)
        if often:
            yield flush(*often[0], np.float64)

    def summed(parts: list[tuple]) -> list[tuple]:
        t, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        return [(t, np.bincount(at, np.concatenate([x[1] for x in parts]), len(t)))]

    def flush(t: np.ndarray, c: np.ndarray, kind: type) -> pa.RecordBatch:
        return blob_batch([(b, np.int64(kind is np.int32).tobytes() + x) for b, x in by_bucket((mix(t) % U(buckets)).astype(np.int64), buckets, t=t, c=c.astype(kind))])

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in gathered(it):
            found = [unpack(memoryview(x)[8:], t=np.uint64, c=np.int32 if np.frombuffer(x, np.int64, 1)[0] else np.float64) for x in blobs]
            t, at = np.unique(np.concatenate([x["t"] for x in found]), return_inverse=True)
            df = np.rint(np.bincount(at, np.concatenate([x["c"] for x in found]), len(t)))
            ok = (df >= least) & (df <= most)
            if ok.any():
                yield blob_batch([(b, pack(t=t[ok]))])

    same = F.xxhash64(F.coalesce("text", F.lit(""))).alias("same")
    copies = table(docs.select(same).groupBy("same").agg(F.count(F.lit(1)).alias("copies")), "copies")
    n = copies.count()
    least, most = max(low * n, 1), max(high * n, 1)
    weighed = docs.select("text", same).join(limited(copies.where("copies > 1")), "same", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = to_buckets(weighed.mapInArrow(count, "bucket int, blob binary"), partitions(spark)).mapInArrow(total, "bucket int, blob binary")
    found = [unpack(r["blob"], t=np.uint64)["t"] for r in counted.toLocalIterator()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def subsets(t: np.ndarray, first: int = 4) -> np.ndarray:
    """Bit s of the result: the term is in subset s; of level k with chance 2^-(k + first)."""
    out = np.zeros(len(t), np.uint64)
    for s in range(SUBSETS):
        rate = first + s * LEVELS // SUBSETS
        out |= (mix(t + U((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - rate) == 0).astype(np.uint64) << U(s)
    return out


def fingerprints(buf: np.ndarray, offsets: np.ndarray, lex: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """SUBSETS 32-bit hashes for each row; 0 for a subset of which the row has no term.

    A row with few terms of the lexicon, or none, falls back on denser subsets of all its terms, with the same bits. How
    few is another number in each subset, so that near copies on both sides of one differ in few hashes. Only a row that
    has a term in no subset is hashed by all its terms in each.
    """
    t, off = terms(buf, offsets)
    n = len(off) - 1
    at = np.searchsorted(lex, t)
    at[at == len(lex)] = 0
    ok = (lex[at] == t) if len(lex) else np.zeros(len(t), bool)
    row = np.repeat(np.arange(n), np.diff(off))
    mask = np.where(ok, masks[at], U(0)) if len(lex) else np.zeros(len(t), np.uint64)
    enough = np.maximum(np.diff(off) * THIN, FEW) / SUBSETS
    known = np.bincount(row[ok], minlength=n)
    thin = np.zeros(n, np.uint64)
    for s in range(SUBSETS):
        thin |= (known < enough * (1 + s * 37 % SUBSETS)).astype(np.uint64) << U(s)
    dense = np.flatnonzero(thin[row])
    mask[dense] = (mask[dense] & ~thin[row[dense]]) | (subsets(t[dense], 1) & thin[row[dense]])
    bare = np.bincount(row[mask != 0], minlength=n) == 0 if len(t) else np.ones(n, bool)
    mask = np.where(bare[row], U(0xFFFFFFFFFFFFFFFF), mask)
    out = np.zeros((n, SUBSETS), np.uint32)
    for s in range(SUBSETS):
        hit = np.flatnonzero(mask & U(1 << s))
        if len(hit):
            r = row[hit]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            rank = np.arange(len(hit)) - np.repeat(first, np.diff(np.concatenate([first, [len(hit)]])))
            sums = np.add.reduceat(mix(t[hit] ^ mix(rank.astype(np.uint64) + U(s + 1))), first)
            out[r[first], s] = (mix(sums) >> U(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets of which either has a term; 1 for two without any."""
    some = (a != 0) | (b != 0)
    same = ((a == b) & some).sum(axis=1)
    return np.where(some.any(axis=1), same / np.maximum(some.sum(axis=1), 1), 1.0)


def _strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


def fingerprint_table(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The digest of op1: fingerprints of whole texts and of their edited forms, and their likenesses.

    Order: doc_id, null last, then a hash of the text, then the text. One shuffle: documents go to ranges of this order,
    and the first of each range also to the range before it, as the last one's successor. An id that holds many rows, or
    null, is spread over as many ranges as it has cuts, by the hash of the text. Null text is empty. Very long texts are
    hashed piece by piece. Ties: rows alike in id and text stand side by side. Repeated rows: each is a row of the
    result. An empty table gives an empty result. Other columns of the table are not read, whatever their names.
    """
    spark = docs.sparkSession
    lex = lexicon(docs, low, high)
    sent = spark.sparkContext.broadcast((lex, subsets(lex)))
    parts = partitions(spark) * 2
    last = (1 << 63) - 1
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(last)).alias("k"), F.xxhash64(text).alias("h"), "doc_id", text.alias("text"))
    cuts = keyed.agg(F.percentile_approx("k", [k / parts for k in range(1, parts)], 4 * parts).alias("c")).first()["c"] or []
    edges = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    below = F.size(F.filter(edges, lambda c: c < F.col("k")))
    own_cuts = F.size(F.filter(edges, lambda c: c == F.col("k")))
    share = F.least((F.col("h") / float(1 << 64) + 0.5) * own_cuts, own_cuts - 1).cast("int")
    dealt = keyed.withColumn("dest", F.when(own_cuts > 0, below + 1 + share).otherwise(below))
    firsts = {r["dest"]: r["first"] for r in dealt.select("dest", "k", "h").groupBy("dest").agg(F.min(F.struct("k", "h")).alias("first")).collect()}  # one row a range
    full = sorted(firsts)
    heads = F.create_map(*(x for d in full for x in (F.lit(d), F.struct(F.lit(firsts[d].k).alias("k"), F.lit(firsts[d].h).alias("h"))))) if full else F.lit(None).cast("map<int,struct<k:bigint,h:bigint>>")
    before = F.create_map(*(F.lit(x) for i, d in enumerate(full) for x in (d, full[i - 1]))) if full else F.lit(None).cast("map<int,int>")
    spot = lambda dest, carry: F.struct(dest.cast("int").alias("dest"), F.lit(carry).alias("carry"))
    own = spot(F.col("dest"), False)
    head = heads[F.col("dest")]
    both = F.when((F.col("k") == head["k"]) & (F.col("h") == head["h"]), F.array(own, spot(before[F.col("dest")], True))).otherwise(F.array(own))
    order = ["dest", "carry", "k", "h", "text"]
    sorted_rows = dealt.withColumn("to", F.explode(both)).select("to.dest", "to.carry", "k", "h", "doc_id", "text").repartition(partitions(spark), "dest").sortWithinPartitions(*order)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, masks = sent.value
        held: list[tuple] = []  # rows of one range whose successor has not come yet, and those to be hashed with it
        size = 0
        dest = None
        closed = False
        for batch in it:
            for d, carry, doc, text in zip(*(batch.column(c).to_pylist() for c in ("dest", "carry", "doc_id", "text")), strict=True):
                if d != dest:
                    dest, held, size, closed = d, [], 0, False
                if closed:
                    continue
                held.append((doc, text))
                size += len(text)
                if carry:
                    closed = True
                if carry or size > 1 << 20:
                    if len(held) > 1:
                        yield emit(held, lex, masks)
                    held, size = held[-1:], len(held[-1][1])

    def emit(held: list[tuple], lex: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
        texts = [t for _, t in held]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]  # noqa: B905
        fp = fingerprints(*_strings(texts), lex, masks)
        fe = fingerprints(*_strings(edited), lex, masks)
        n = len(edited)
        cols = [
            pa.array([d for d, _ in held[:n]], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([x.tobytes().hex() for x in fp[:n].byteswap()]),
            pa.array([x.tobytes().hex() for x in fe.byteswap()]),
            pa.array(likeness(fp[:n], fe)),
            pa.array(likeness(fp[:-1], fp[1:])),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return sorted_rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


__all__ = ["BLOBS", "fingerprint_table", "fingerprints", "lexicon", "likeness", "subsets", "terms"]
