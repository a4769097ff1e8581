"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import unused

BITS, ORDERS = 16, (1, 2, 3)
SCALE = 1 << 12
_LETTER = regex.compile(r"\p{L}")
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
SLICE_CHARS = 1 << 18
HELD = 200  # languages whose counts a task holds at once (100 MB)
BLOCK = 64  # languages that are scored at once


@dataclass(frozen=True)
class Model:
    """Fixed-point log probabilities by feature and language; the last row is zero and stands for no feature."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def features(cp: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram at each position; 2^BITS where it would run over the end of a text (code point 0)."""
    n = max(0, len(cp) - order + 1)
    h, gone = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(order):
        part = cp[k : k + n]
        h = (h ^ (part + np.uint32(order))) * _ODD[k]
        h ^= h >> np.uint32(15)
        gone |= part == 0
    out = (h * _ODD[1]) >> np.uint32(32 - BITS)
    out[gone] = 1 << BITS
    return out


def batches(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j, their lower-cased code points with two zeros after each text, and where each begins."""
    i = 0
    while i < len(texts):
        j, size, parts = i, 0, []
        while j < len(texts) and (j == i or size < SLICE_CHARS):
            parts.append((texts[j] or "").replace("\0", " ").lower())
            size += len(parts[-1]) + 2
            j += 1
        cp = np.frombuffer(("\0\0".join(parts) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, cp, np.cumsum([0, *(len(p) + 2 for p in parts[:-1])])
        i = j


def pieces(cp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for a in range(0, len(cp), SLICE_CHARS):
        yield a, cp[a : a + SLICE_CHARS + 2]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior and evidence of each text; `und`, 0 and 0 without a letter. Sums are of integers: equal texts,
    equal results. Of equally likely languages the first by name is taken.

    Evidence: by how much an n-gram is more likely in that language than by chance, in nats, on average."""
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    langs, scores, evidence = [], [], []
    for i, j, cp, starts in batches(texts):
        total = np.zeros((j - i, len(model.languages)), np.int64) + model.prior
        for a, part in pieces(cp):
            own = np.searchsorted(starts, [a, a + SLICE_CHARS])
            first = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
            begins = np.concatenate([[a], starts[first + 1 : own[1]]]) - a
            for order in ORDERS:
                f = features(part, order)[:SLICE_CHARS]
                cuts = begins[begins < len(f)]
                if len(cuts):
                    for b in range(0, len(model.languages), BLOCK):
                        total[first : first + len(cuts), b : b + BLOCK] += np.add.reduceat(model.matrix[:, b : b + BLOCK][f], cuts, axis=0, dtype=np.int64)
        logs = total / SCALE
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        for k, t in enumerate(texts[i:j]):
            known = t is not None and _LETTER.search(t) is not None
            langs.append(model.languages[best[k]] if known else "und")
            scores.append(float(post[k, best[k]] / post[k].sum()) if known else 0.0)
            size = int(starts[k + 1] - starts[k] if k + 1 < j - i else len(cp) - 2 - starts[k]) - 2
            grams = sum(max(0, size - order + 1) for order in ORDERS)
            own = (total[k, best[k]] - model.prior[best[k]]) / SCALE
            evidence.append(float(own / grams + BITS * np.log(2)) if known and grams else 0.0)
    return langs, scores, evidence


def held_out(doc_id: Column) -> Column:
    """Documents of the test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, per_language: int = 1000, smoothing: float = 0.1) -> Model:
    """Counts n-grams of whole texts, of about `per_language` documents of each language, however many there are.

    The sample is by a hash of doc_id and is the only bounded part; the test fold and rows without text or lang are left
    out. Ids that repeat are drawn together. Without any row to learn from, or an empty table, the model has no languages.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros(((1 << BITS) + 1, 0), np.int32))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, per_language / n)) for x, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text").repartition(8)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])
        totals: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"lang": [*totals], "counts": [zlib.compress(v.tobytes(), 1) for v in totals.values()]}, schema)
            totals.clear()
            return out

        for batch in it:
            names = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(names)):
                if lang not in totals and len(totals) >= HELD:
                    yield flush()
                sums = totals.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                for _, _, cp, _ in batches([t for t, x in zip(texts, names, strict=True) if x == lang]):
                    for _, part in pieces(cp):
                        for order in ORDERS:
                            sums += np.bincount(features(part, order)[:SLICE_CHARS], minlength=len(sums))
        yield flush()

    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((1 << BITS, len(languages)))
    for r in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():  # 8 tasks, fixed-size rows of languages
        counts[:, place[r["lang"]]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)[: 1 << BITS]
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    matrix = np.zeros(((1 << BITS) + 1, len(languages)), np.int32)
    for a in range(0, len(languages), BLOCK):
        part = counts[:, a : a + BLOCK] + smoothing
        matrix[:-1, a : a + BLOCK] = np.round(np.log(part / part.sum(axis=0)) * SCALE)
    return Model(languages, np.round(prior * SCALE).astype(np.int64), matrix)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with lang_pred, score and evidence. The model is broadcast: its size is that of
    2^BITS numbers for each language.

    Null or empty text, or one without letters, or a model without languages: `und`, 0, 0. Ties: the first language by
    name. Repeated rows: each for itself. Very long texts go in pieces. Empty tables: empty results. Columns of the table
    stay as they are; a new one whose name is taken has underscores behind it.
    """
    kept = [c for c in keep or docs.columns if c in docs.columns]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    new = [unused(docs.select(*(f"`{c}`" for c in kept)), c) for c in ("lang_pred", "score", "evidence")]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.StringType() if k == 0 else T.DoubleType()) for k, c in enumerate(new))])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, *numbers = predict(sent.value, part.column("text").to_pylist())
                cols = [part.column(c) for c in kept] + [pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *new])

    needed = [*kept, *([] if "text" in kept else ["text"])]
    return docs.select(*(f"`{c}`" for c in needed)).mapInArrow(score, schema)


def language_table(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """The digest of op7. Odd rows as in `fit` and `identify`."""
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(slim, fit(docs, per_language), ["doc_id", "held_out"])
