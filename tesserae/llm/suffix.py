"""Removal of repeated 100-byte strings by blockwise suffix sorting with a difference cover.

Suffixes are dealt into buckets by the least k-gram (by hash) of their first 100 bytes, so that equal strings share a
bucket, and neighbouring suffixes mostly do: they travel together, as a stretch of text. Stretches that are equal as a
whole are settled by a 96-bit hash before any text moves. Of those that differ but share a k-gram, the text goes to the
bucket. Its suffixes are sorted there one block at a time: first the suffixes at positions of a difference cover are
ranked, then all are sorted by a few bytes, and longer ties are resolved by the ranks, since for any two positions the
cover has a common distance at which both are ranked. Neighbours in that order are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import U, blob_batch, by_bucket, gathered, lanes, mix, pack, partitions, range_hashes, release, table, text_bytes, to_buckets, unpack

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
PERIOD = 32  # of the difference cover, and bytes that suffixes are sorted by before ranks are asked
RANGES = 32
PLACE = {"doc": np.int64, "th": np.int64, "pos": np.int32}
ROWS = {**PLACE, "runs": np.int32}
SEGMENTS = {"key": np.uint64, "seg": np.uint64, "seg2": np.uint32, **PLACE, "runs": np.uint8}
ASKED = {"key": np.uint64, **ROWS}
OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "kind int, bucket int, blob binary"
RUN, SEGMENT, REQUEST, STRING, TEXT = 0, 1, 2, 3, 9
PRIME, FACTOR = (1 << 31) - 1, 48_271


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory, none of which changes a result."""

    piece: int = 1 << 18  # bytes of text that are sampled at a time, under 2^20
    flush: int = 1 << 20  # rows that a task holds before it sends them
    sketch_bits: int = 20  # cells of the sketch that counts the stretches of a k-gram
    crowd: int = 1 << 16  # stretches of one k-gram beyond which its bucket is split by more of their bytes
    block: int = 1 << 20  # suffixes that are sorted at a time
    bucket_bytes: int = 32 << 20
    task_bytes: int = 192 << 20


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo the period is one between two of them, chosen greedily."""
    chosen, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: sum(d in missing for d in {x for c in chosen for x in ((r - c) % period, (c - r) % period)})  # noqa: E731, B023
        best = max((r for r in range(period) if r not in chosen), key=lambda r: (gain(r), -r))
        chosen.append(best)
        missing -= {(a - b) % period for a in chosen for b in chosen}
    return np.array(sorted(chosen))


COVER = difference_cover(PERIOD)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: DISTANCE[a, b]: the least distance at which positions with residues a and b are both in the cover.
DISTANCE = np.array([[next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD] and IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def sample(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of string starts with the same least k-gram: its hash, its place, first start, number of starts.

    `ends[i]`: end of the row that byte i is in; strings that run over it don't count. At most 2^20 bytes."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    view, m = lanes(buf), n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for k in range(0, GRAM, 8):  # only deals suffixes into buckets; no equality rests on it
        h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15) + view[k : k + m] * U(0xD6E8FEB86659FD93)
    h = mix(h)
    least = (h >> U(20) << U(20)) | np.arange(m, dtype=np.uint64)  # the leftmost of equal hashes
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if WINDOW > width:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    anchor = (least & U((1 << 20) - 1)).astype(np.int64)
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[: len(anchor)])
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none
    a = anchor[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (start[1:] != start[:-1] + 1) | (a[1:] != a[:-1])
    first = np.flatnonzero(cut)
    return h[a[first]], a[first], start[first], np.diff(np.concatenate([first, [len(start)]]))


def split(buf: np.ndarray, key: np.ndarray, anchor: np.ndarray, begin: np.ndarray, runs: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, first start and number of starts of stretches, those of crowded k-grams in parts by distance to the k-gram.

    All strings of a part share more bytes around the k-gram, which make its key: at level 1, 66 of 100 bytes, at level 7
    the whole string. Equal strings have equal distances, so they stay together."""
    level = levels[(key >> U(64 - levels.size.bit_length() + 1)).astype(np.int64)].astype(np.int64)
    if not level.any():
        return key, begin, runs
    easy, hard = level == 0, np.flatnonzero(level)
    wide = -(-WINDOW // (1 << level[hard]))
    far = anchor[hard] - begin[hard]  # of the first start; those that follow are nearer
    top, low = far // wide, (far - runs[hard] + 1) // wide
    of = np.repeat(np.arange(len(hard)), top - low + 1)
    part = np.repeat(low, top - low + 1) + np.arange(len(of)) - np.repeat(np.cumsum(top - low + 1) - (top - low + 1), top - low + 1)
    near, away = part * wide[of], np.minimum((part + 1) * wide[of], WINDOW) - 1
    a, own = anchor[hard][of], hard[of]
    first, last = np.maximum(begin[own], a - away), np.minimum(begin[own] + runs[own] - 1, a - near)
    more = mix(range_hashes(buf, a - near, a - away + LENGTH) ^ mix((part + 256 * level[own]).astype(np.uint64) + U(1)))
    return tuple(np.concatenate([x[easy], y]) for x, y in ((key, more), (begin, first), (runs, last - first + 1)))


def pieces(off: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows i to j and the bytes a to b of a piece: several rows, or a part of a long one that shares 99 bytes with the next."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        a, b = int(off[i]), int(off[j])
        if b - a <= size:
            yield i, j, a, b
        else:
            for s in range(a, b - LENGTH + 1, size):
                yield i, j, s, min(s + size + LENGTH - 1, b)
        i = j


def sampled(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """For each piece: its bytes and stretches, the row of each stretch, and what to add to its start for that in the row."""
    buf, off = text_bytes(batch.column("text"))
    for i, j, a, b in pieces(off, size):
        own = np.minimum(off[i + 1 : j + 1], b) - a
        ends = np.repeat(own, np.diff(np.concatenate([[0], own])))
        yield buf[a:b], sample(buf[a:b], ends), i, own, a - off


def merged(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, runs: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of starts in order, neighbours joined."""
    o = np.lexsort((pos, th, doc))
    doc, th, pos, runs = doc[o], th[o], pos[o], runs[o].astype(np.int64)
    if not len(doc):
        return {"doc": doc, "th": th, "pos": pos, "runs": runs.astype(np.int32)}
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + runs[:-1])
    first = np.flatnonzero(cut)
    return {"doc": doc[first], "th": th[first], "pos": pos[first], "runs": np.add.reduceat(runs, first).astype(np.int32)}


def settle(keys: list[np.ndarray], cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and start, and which of that order are at the first place of their keys.

    Rows alike in document and start are one place, so that repeated rows are not taken for repeats of themselves."""
    o = np.lexsort((cols["pos"], cols["th"], cols["doc"], *keys[::-1]))
    head = np.zeros(len(o), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[o][1:] != k[o][:-1]
    place = head.copy()
    for c in PLACE:
        place[1:] |= cols[c][o][1:] != cols[c][o][:-1]
    number = np.cumsum(place)
    return o, number == number[head][np.cumsum(head) - 1]


def doc_bucket(doc: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, as bucket_column has it."""
    return (np.mod(np.mod(doc, PRIME) * FACTOR + np.mod(th, PRIME), PRIME) % buckets).astype(np.int64)


def bucket_column(doc: Column, th: Column, buckets: int) -> Column:
    return (F.pmod(F.pmod(doc, F.lit(PRIME)) * FACTOR + F.pmod(th, F.lit(PRIME)), F.lit(PRIME)) % buckets).cast("int")


def rows_of(kind: int, bucket: np.ndarray, buckets: int, cols: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    return [(kind, b, blob) for b, blob in by_bucket(bucket, buckets, **cols)]


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(OUT.types)], schema=OUT)


class Outgoing:
    """Rows for document buckets, held over the buckets that a task reads and packed together when there are many."""

    def __init__(self, kind: int, buckets: int, most: int) -> None:
        self.kind, self.buckets, self.most, self.held, self.size = kind, buckets, most, [], 0

    def add(self, cols: dict[str, np.ndarray], rows: np.ndarray) -> None:
        if len(rows):
            m = merged(*(cols[c][rows] for c in ROWS)) if self.kind == RUN else {c: cols[c][rows].astype(t) for c, t in ASKED.items()}
            self.held.append(m)
            self.size += len(m["pos"])

    def full(self) -> bool:
        return self.size > self.most

    def flush(self) -> list[tuple[int, int, bytes]]:
        if not self.size:
            return []
        m = {c: np.concatenate([x[c] for x in self.held]) for c in self.held[0]}
        self.held, self.size = [], 0
        return rows_of(self.kind, doc_bucket(m["doc"], m["th"], self.buckets), self.buckets, m)


def crowding(docs: DataFrame, sizes: Sizes) -> tuple[np.ndarray, int]:
    """The level at which the k-grams of each cell of a sketch are split, and the number of stretches, over all texts.

    The sketch is of fixed size, whatever the corpus: a byte a cell comes to the driver, its count on a log scale."""
    cells = 1 << sizes.sketch_bits
    per = cells // RANGES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in it:
            for _, (key, *_), *_ in sampled(batch, sizes.piece):
                counts += np.bincount((key >> U(64 - sizes.sketch_bits)).astype(np.int64), minlength=cells) if len(key) > cells // 16 else 0
                if len(key) <= cells // 16:
                    np.add.at(counts, (key >> U(64 - sizes.sketch_bits)).astype(np.int64), 1)
        parts = np.minimum(np.round(4 * np.log2(counts + 1.0)), 255).astype(np.uint8).reshape(RANGES, per)
        yield blob_batch([(k, parts[k].tobytes()) for k in range(RANGES) if parts[k].any()])

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in gathered(it):
            sums = np.zeros(per)
            for x in blobs:
                sums += np.exp2(np.frombuffer(x, np.uint8) / 4) - 1
            yield blob_batch([(b, np.minimum(np.round(4 * np.log2(sums + 1.0)), 255).astype(np.uint8).tobytes())])

    counts = np.zeros((RANGES, per))
    ranges = to_buckets(docs.select("text").mapInArrow(run, "bucket int, blob binary"), min(RANGES, partitions(docs.sparkSession)))
    for r in ranges.mapInArrow(total, "bucket int, blob binary").toLocalIterator():
        counts[r["bucket"]] = np.exp2(np.frombuffer(r["blob"], np.uint8) / 4) - 1
    counts = counts.reshape(-1)
    much = max(sizes.crowd, 8 * counts.mean())
    return np.where(counts > much, np.clip(np.ceil(np.log2(np.maximum(counts, 1) / much)) + 1, 1, 7), 0).astype(np.uint8), int(counts.sum())


def cover(docs: DataFrame, levels: np.ndarray, buckets: int, doc_buckets: int, sizes: Sizes) -> DataFrame:
    """Stretches by k-gram bucket. Those that came before in the same task are settled there, as runs to remove."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = {c: np.concatenate([x[k] for x in held]) for k, c in enumerate(SEGMENTS)}
            o, first = settle([cols["key"], cols["seg"], cols["seg2"]], cols)
            gone, kept = o[~first], np.sort(o[first])
            out = rows_of(SEGMENT, (cols["key"][kept] % U(buckets)).astype(np.int64), buckets, {c: v[kept] for c, v in cols.items()})
            if len(gone):
                m = merged(*(cols[c][gone] for c in ROWS))
                out += rows_of(RUN, doc_bucket(m["doc"], m["th"], doc_buckets), doc_buckets, m)
            return batch_of(out)

        for batch in it:
            doc, th = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("doc", "th"))
            for buf, found, i, own, shift in sampled(batch, sizes.piece):
                key, begin, runs = split(buf, *found, sent.value)
                if not len(key):
                    continue
                stop = begin + runs + LENGTH - 1
                row = i + np.searchsorted(own, begin, "right")
                held.append((key, range_hashes(buf, begin, stop), (range_hashes(buf, begin, stop, 1) >> U(32)).astype(np.uint32), doc[row], th[row], (begin + shift[row]).astype(np.int32), runs.astype(np.uint8)))
                size += len(key)
                if size > sizes.flush:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("doc", "th", "text").mapInArrow(run, DDL)


def _by_kind(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(kind, bucket, blobs) of rows sorted by bucket and kind."""
    now, blobs = None, []
    for batch in it:
        for k, b, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if (k, b) != now:
                if blobs:
                    yield *now, blobs
                now, blobs = (k, b), []
            blobs.append(blob.as_buffer())
    if blobs:
        yield *now, blobs


def _columns(blobs: list[bytes], kinds: dict) -> dict[str, np.ndarray]:
    parts = [unpack(x, **kinds) for x in blobs]
    return {c: np.concatenate([p[c] for p in parts]) for c in kinds}


def compare(covered: DataFrame, doc_buckets: int, tasks: int, sizes: Sizes) -> DataFrame:
    """In each k-gram bucket: later ones of equal stretches are runs to remove; of stretches that differ, the first of each
    is a request for its text. Runs that are settled pass through."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, requests = Outgoing(RUN, doc_buckets, sizes.flush), Outgoing(REQUEST, doc_buckets, sizes.flush)
        for kind, _, blobs in _by_kind(it):
            if runs.full() or requests.full():
                yield batch_of(runs.flush() + requests.flush())
            if kind == RUN:
                for blob in blobs:
                    c = unpack(blob, **ROWS)
                    runs.add(c, np.arange(len(c["pos"])))
                continue
            c = _columns(blobs, SEGMENTS)
            ordered = np.sort(c["key"])
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if not len(twice):
                continue
            at = np.searchsorted(twice, c["key"])
            at[at == len(twice)] = 0
            keep = twice[at] == c["key"]
            c = {k: v[keep] for k, v in c.items()}
            o, first = settle([c["key"], c["seg"], c["seg2"]], c)
            one = o[first]
            runs.add(c, o[~first])
            place = np.ones(len(one), bool)  # rows alike in document and start are at one place: one of them asks
            for x in c:
                same = c[x][one][1:] == c[x][one][:-1]
                place[1:] = same if x == "key" else place[1:] & same
            place[:1] = False
            one = one[~place]
            by_key = c["key"][one]
            many = np.concatenate([by_key[1:] == by_key[:-1], [False]]) | np.concatenate([[False], by_key[1:] == by_key[:-1]])
            requests.add(c, one[many])
        yield batch_of(runs.flush() + requests.flush())

    return table(_dealt(covered, tasks).mapInArrow(run, DDL), "stretches")


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket")


def _with_text(docs: DataFrame, side: DataFrame, tasks: int) -> DataFrame:
    """Side rows of each document bucket, then its documents."""
    none = F.lit(None)
    texts = docs.select(F.lit(TEXT).alias("kind"), "bucket", none.cast("binary").alias("blob"), "doc", "doc_id", "th", "text")
    rows = side.select("kind", "bucket", "blob", none.cast("bigint").alias("doc"), none.cast("bigint").alias("doc_id"), none.cast("bigint").alias("th"), none.cast("string").alias("text"))
    return rows.union(texts).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "doc")


def _streamed(it: Iterator[pa.RecordBatch], kinds: dict) -> Iterator[tuple[dict[str, np.ndarray], int, int | None, int, np.ndarray]]:
    """For each document: the side rows of its own, its key, id, hash and bytes."""
    now, blobs, side, index = None, [], {}, None
    for batch in it:
        what, where = batch.column("kind").to_pylist(), batch.column("bucket").to_pylist()
        docs, ids, ths = (batch.column(c).to_pylist() for c in ("doc", "doc_id", "th"))
        for i, (kind, b) in enumerate(zip(what, where, strict=True)):
            if b != now:
                now, blobs, side, index = b, [], {}, None
            if kind != TEXT:
                blobs.append(batch.column("blob")[i].as_buffer().to_pybytes())
                continue
            if index is None:
                side = _columns(blobs, kinds) if blobs else {k: np.zeros(0, t) for k, t in kinds.items()}
                o = np.lexsort((side["pos"], side["th"], side["doc"]))
                side, blobs = {k: v[o] for k, v in side.items()}, []
                index = side["doc"]
            a, e = np.searchsorted(index, docs[i], "left"), np.searchsorted(index, docs[i], "right")
            own = {k: v[a:e] for k, v in side.items()}
            if e > a and (side["th"][a] != ths[i] or side["th"][e - 1] != ths[i]):
                hit = side["th"][a:e] == ths[i]
                own = {k: v[hit] for k, v in own.items()}
            text = batch.column("text")[i]
            yield own, docs[i], ids[i], ths[i], np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1 and so on, count of each, and whose they are."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - (np.cumsum(count) - count)[of] + first[of], of


class Words:
    """The bytes of strings as big-endian words, so that they compare as the strings do; a string's end is zeros."""

    def __init__(self, text: np.ndarray) -> None:
        self.view = lanes(text)

    def at(self, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        left = np.clip(stop - start - 8 * k, 0, 8)
        return (self.view[np.minimum(start + 8 * k, len(self.view) - 1)] & FIRST_BYTES[left]).byteswap()


FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def by_bytes(words: Words, start: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by their first `depth` bytes (a multiple of 8) and the number of each one's group, in that order.

    Strings that end are less than those that go on. Only strings that still tie are looked at again."""
    order = np.argsort(words.at(start, stop, 0), kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True

    def divide(at: np.ndarray, key: np.ndarray) -> None:
        """at: places in the order, whose strings have this key now."""
        new[at] |= np.concatenate([[False], key[1:] != key[:-1]])

    divide(np.arange(len(order)), words.at(start, stop, 0)[order])
    for k in range(1, depth // 8 + 1):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        key = words.at(start[own], stop[own], k) if k < depth // 8 else np.minimum(stop[own] - start[own], depth).astype(np.uint64)
        o = np.lexsort((key, np.cumsum(new)[at]))
        order[at] = own[o]
        divide(at, key[o])
    return order, np.cumsum(new) - 1


def sort_suffixes(text: np.ndarray, pos: np.ndarray, begin: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of stretches in order: their starts in `text`, the stretch of each, and a number for each 100-byte string.

    Stretch i is the text from begin[i] on, with runs[i] starts; pos[i] is its place in its document, which the cover
    counts from. A suffix ends with its stretch."""
    stop = begin + runs + LENGTH - 1
    start, of = spread(begin, runs)
    residue = (pos[of] + (start - begin[of])) % PERIOD
    words = Words(text)
    # Ranks of the suffixes at positions of the cover.
    reach, whose = spread(begin, runs + PERIOD - 1)
    chosen = np.flatnonzero(IN_COVER[(pos[whose] + (reach - begin[whose])) % PERIOD])
    reach, whose = reach[chosen], whose[chosen]
    order, rank_in_order = by_bytes(words, reach, stop[whose], LENGTH + 4)
    rank = np.zeros(len(text) + 1, np.int32)
    rank[reach[order]] = rank_in_order
    # All suffixes by PERIOD bytes; ties by a quicksort of all their groups at once, three ways, by the ranks.
    order, group = by_bytes(words, start, start + PERIOD, PERIOD)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    final = np.zeros(len(order), bool)  # equal to their pivot
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied & ~final)
        if not len(at):
            break
        own, number = order[at], np.cumsum(new)[at]
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        size = np.diff(np.concatenate([head, [len(at)]]))
        pivot = np.repeat(own[head + size // 2], size)
        d = DISTANCE[residue[own], residue[pivot]]
        side = np.sign(rank[start[own] + d] - rank[start[pivot] + d]).astype(np.int8)
        o = np.lexsort((side, number))
        order[at], side, number = own[o], side[o], number[o]
        new[at] |= np.concatenate([[True], (side[1:] != side[:-1]) | (number[1:] != number[:-1])])
        final[at] = side == 0
    # Neighbours in order that are not known to be equal are compared byte by byte.
    differ = new.copy()
    differ[:1] = True
    open_ = np.flatnonzero(new[1:]) + 1
    left, right = start[order[open_ - 1]], start[order[open_]]
    for k in range(-(-LENGTH // 8)):
        same = words.at(left, left + LENGTH, k) == words.at(right, right + LENGTH, k)
        open_, left, right = open_[same], left[same], right[same]
        if not len(open_):
            break
    differ[open_] = False
    return start[order], of[order], np.cumsum(differ)


def strings(docs: DataFrame, requests: DataFrame, buckets: int, doc_buckets: int, tasks: int, doc_tasks: int, sizes: Sizes) -> DataFrame:
    """Runs to remove among the requested stretches, whose texts go to their k-gram's bucket and are sorted there."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            c = {k: np.concatenate([x[k] for x, _ in held]) for k in ASKED}
            data = np.concatenate([x for _, x in held])
            lens = c["runs"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(lens) - lens
            bucket = (c["key"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                out.append((STRING, b, pack(**{k: v[own] for k, v in c.items()}) + data[spread(begin[own], lens[own])[0]].tobytes()))
            return batch_of(out)

        for own, _, _, _, buf in _streamed(it, ASKED):
            if not len(own["pos"]):
                continue
            take, _ = spread(own["pos"].astype(np.int64), own["runs"].astype(np.int64) + LENGTH - 1)
            held.append((own, buf[take]))
            size += len(take)
            if size > 16 * sizes.flush:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Outgoing(RUN, doc_buckets, sizes.flush)
        for _, _, blobs in _by_kind(it):
            parts = [unpack(x, **ASKED) for x in blobs]
            c = {k: np.concatenate([p[k] for p in parts]) for k in ASKED}
            width = sum(np.dtype(t).itemsize for t in ASKED.values())
            text = np.concatenate([np.frombuffer(x, np.uint8)[8 + len(p["pos"]) * width :] for x, p in zip(blobs, parts, strict=True)])
            lens = c["runs"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(lens) - lens
            by_key = np.argsort(c["key"], kind="stable")
            key, count = c["key"][by_key], np.cumsum(c["runs"][by_key].astype(np.int64))
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # blocks end with a key
            a = 0
            while a < len(key):  # a block of suffixes at a time
                done = count[a - 1] if a else 0
                fits = ends[(ends > a) & (count[ends - 1] - done <= sizes.block)]
                b = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, a, "right")])
                own = by_key[a:b]
                take, _ = spread(begin[own], lens[own])
                at = np.cumsum(lens[own]) - lens[own]
                start, of, name = sort_suffixes(text[take], c["pos"][own].astype(np.int64), at, c["runs"][own].astype(np.int64))
                cols = {"doc": c["doc"][own][of], "th": c["th"][own][of], "pos": (c["pos"][own][of] + (start - at[of])).astype(np.int32), "runs": np.ones(len(of), np.int32)}
                o, first = settle([name], cols)
                runs.add(cols, o[~first])
                a = b
            if runs.full():
                yield batch_of(runs.flush())
        yield batch_of(runs.flush())

    asked = _with_text(docs, requests, doc_tasks).mapInArrow(run, DDL)
    return table(_dealt(asked, tasks).mapInArrow(meet, DDL), "strings")


def covered_spans(n: int, pos: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte ranges that the strings at these starts cover."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o = np.argsort(pos, kind="stable")
    start, stop = pos[o], np.maximum.accumulate(pos[o] + runs[o] + LENGTH - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], np.minimum(stop[last], n)


def dedup(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) of each row.

    Order of documents: doc_id, then a hash of the text; a null doc_id is last. Rows alike in both are judged as one
    document. Null or short text: nothing is removed. Texts of any length go piece by piece. Empty tables give empty
    results. Other columns of the table are not read, whatever their names.

    Buckets are sized by the number of stretches over all texts, tasks by the bytes that they read, and k-grams with many
    different stretches are split, so no task grows with the corpus.
    """
    spark = docs.sparkSession
    text, key = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    keyed = docs.select(key.alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    levels, stretches = crowding(keyed, sizes)
    tasks = lambda size: max(partitions(spark), -(-size // sizes.task_bytes))
    count = lambda size: max(2 * partitions(spark), -(-size // sizes.bucket_bytes))
    wide = sum(np.dtype(t).itemsize for t in SEGMENTS.values())
    total = stretches * 40  # bytes of text, as about that many start in a stretch
    buckets, doc_buckets = count(stretches * wide), count(total)
    placed = keyed.withColumn("bucket", bucket_column(F.col("doc"), F.col("th"), doc_buckets))
    found = compare(cover(keyed, levels, buckets, doc_buckets, sizes), doc_buckets, tasks(stretches * wide), sizes)
    asked = found.where(F.col("kind") == REQUEST)
    size = 5 * (asked.agg(F.sum(F.octet_length("blob"))).first()[0] or 0)  # of the texts that are asked for
    rest = strings(placed, asked, count(size * 4), doc_buckets, tasks(size), tasks(total), sizes)
    runs = found.where(F.col("kind") == RUN).union(rest)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for own, _, doc_id, _, buf in _streamed(it, ROWS):
            start, stop = covered_spans(len(buf), own["pos"].astype(np.int64), own["runs"].astype(np.int64))
            kept, at = [], 0
            for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                kept.append(buf[at:s].tobytes())
                at = e
            kept.append(buf[at:].tobytes())
            left = b"".join(kept)
            out.append((doc_id, len(buf), len(buf) - len(left), len(start), hashlib.sha256(left).hexdigest(), left))
            held += len(left)
            if len(out) == 500 or held > 8 << 20:
                yield result(out)
                out, held = [], 0
        if out:
            yield result(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _with_text(placed, runs, tasks(total)).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def dedup_table(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """The digest of op8."""
    return dedup(docs, sizes).drop("kept")


__all__ = ["Sizes", "dedup", "dedup_table", "release"]
