"""What the operators share: tables in the shared folder, Arrow batches as byte arrays, vectorised hashes, packed rows."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SLICE_BYTES = 1 << 20
SMALL = 1_000_000  # ids up to which a set of them is broadcast (8 MB); beyond, it is joined by shuffle
#: White space of the word definition: blank and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may do without the setting."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (conf or f"{tempfile.gettempdir()}/tesserae-tables").rstrip("/")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of that size, in what is run meanwhile. They are held twice on either side of a Python worker, and
    rows of packed arrays or bitmaps fill the largest that are allowed."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with batches_of(spark, "2m"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written, out._needs = path, []
    release(*getattr(df, "_needs", []))
    return out


def needing(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, whose rows come from tables that nothing else reads: they are deleted once `table` has written df."""
    df._needs = list(tables)
    return df


def release(*tables: DataFrame) -> None:
    """Deletes tables of `table` that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def limited(df: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it has been counted and is small; else joined by shuffle, which AQE can split."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def tidy(run: Callable) -> Callable:
    """The same function over batches; what it has freed by its end goes back to the system, since the worker that it runs in
    is kept for later tasks."""

    def tidied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        del it
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: A-Z as a-z; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
LONG = 256  # bytes beyond which a range is hashed by itself


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; behind the end there are zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand. Two seeds give 128 bits.

    Eight bytes at a time go through a mixing function, which is no polynomial, so that no strings collide by their
    structure, whatever the modulus. Ranges over LONG bytes are hashed one by one, with a cryptographic hash."""
    view, length = lanes(buf), end - start
    h = mix(length.astype(np.uint64) * _SEEDS[seed] + U(seed + 1))
    some = np.flatnonzero(length <= LONG)
    at, left, state = start[some], length[some], h[some]
    for k in range(0, LONG, 8):
        if k:
            on = left > k
            if not on.all():
                h[some] = state
                some, at, left, state = some[on], at[on], left[on], state[on]
        if not len(some):
            break
        state = mix((state ^ (view[at + k] & FIRST[np.minimum(left - k, 8)])) + _SEEDS[seed])
    h[some] = state
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(len(col) + 1, np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `size` bytes together; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _piece_words(buf: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of words; `fresh`: positions at which a word can't go on."""
    blank = SPACE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = True
    before[1:] = blank
    edge = np.zeros(len(buf) + 1, bool)
    edge[fresh] = True
    start = np.flatnonzero(~blank & (before[:-1] | edge[:-1]))
    after = np.ones(len(buf) + 1, bool)
    after[:-1] = blank | edge[:-1]
    end = np.flatnonzero(~blank & after[1:]) + 1
    return range_hashes(LOWER[buf], start, end), start


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of rows, and the offsets of rows among them. Long rows go piece by piece."""
    n = len(offsets) - 1
    hashes, counts = [], np.zeros(n, np.int64)
    for i, j in slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i == 1 and b - a > 2 * SLICE_BYTES:
            at = a
            while at < b:
                to = min(at + SLICE_BYTES, b)
                while to < b and not SPACE[buf[to]]:  # on to the end of a word, a block at a time
                    gap = np.flatnonzero(SPACE[buf[to : to + 65536]])
                    to = to + int(gap[0]) if len(gap) else min(to + 65536, b)
                h, _ = _piece_words(buf[at:to], np.zeros(0, np.int64))
                hashes.append(h)
                counts[i] += len(h)
                at = to
            continue
        h, start = _piece_words(buf[a:b], offsets[i:j] - a)
        hashes.append(h)
        counts[i:j] = np.diff(np.searchsorted(start, offsets[i : j + 1] - a))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def pack(**columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes, column after column, after their count."""
    n = len(next(iter(columns.values())))
    return b"".join([np.int64(n).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns.values())])


def unpack(blob: bytes, **kinds: type) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def by_bucket(bucket: np.ndarray, buckets: int, **columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed row for each bucket that has entries; the order within a bucket stays."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            own = order[edges[b] : edges[b + 1]]
            yield b, pack(**{k: c[own] for k, c in columns.items()})


BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=BLOBS)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of one bucket after the other; rows come sorted by bucket."""
    now, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if b != now and blobs:
                yield now, blobs
                blobs = []
            now = b
            blobs.append(blob.as_buffer())
    if blobs:
        yield now, blobs


def to_buckets(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")
