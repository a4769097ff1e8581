"""N-gram Jaccard join: rare-first prefixes give candidates, size-banded tiles of hashed bitmaps bound their overlap, and
sorted arrays are intersected exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.graph import components
from tesserae.llm.shared import U, blob_batch, by_bucket, gathered, limited, mix, needing, pack, partitions, release, slices, table, text_bytes, tidy, to_buckets, unpack, unused, word_hashes

WORDS = 5
NUM, DEN = 75, 100  # the least likeness
SKETCH_BITS, RANGES = 21, 32
FLUSH = 1 << 18  # tokens that a task holds before it sends them; what goes with that is some ten times as large
KNOWN = 1 << 20  # ids of sets that a task remembers, to send equal sets once
TILE = 2048  # members of a candidate group in one tile
TILE_TOKENS = 1 << 21  # and, where links are counted, their tokens (16 MB)
COLUMNS = 1024  # tokens of a tile that are compared at once
GROUPS_KNOWN = 32  # groups of a set, the first by id, that its other groups know, to leave shared pairs to them
MERGING = 2  # rounds in which each set is compared with its likeliest partners alone
CLASHES = 10_000  # shared ids of sets that are told apart
_SEED = U(0x9FB21C651E98DF25)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's 5-word shingles; a shorter row is one shingle, one without words has none."""
    h, off = word_hashes(buf, offsets)
    n = len(h) - WORDS + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        s = s * _SEED + h[k : k + n] if n > 0 else s
    s = mix(s)
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * U(3) + h[k])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray, seed: int = 0) -> int:
    """One 64-bit id for equal sets; with another seed, a second one that is independent of it."""
    return int(mix(mix(s ^ _SEED if not seed else s * _SEED + U(seed & (1 << 64) - 1)).sum(dtype=np.uint64, keepdims=True) + U(len(s))).view(np.int64)[0])


def node_of(s: np.ndarray, clashes: frozenset) -> int:
    """A set's id; where different sets share one, it is made from their second ids, so that 128 bits tell sets apart."""
    first = set_id(s)
    return set_id(s, first | 1) if first in clashes else first


def documents_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    buf, off = text_bytes(batch.column("text"))
    for i, j in slices(off):
        yield from enumerate(shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i]), i)


def prefix_length(n: int) -> int:
    """So many of a set's tokens, first in a common order, that a linked set has one of them among its own first."""
    return n - -(-NUM * n // DEN) + 1


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), n, node and second (ids) of each row, and the ranges of a count sketch over all
    shingles (kind 1), written once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, known = np.zeros(1 << SKETCH_BITS, np.int64), [], 0, set()
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
        for batch in it:
            ns, nodes, seconds = [], [], []
            for _, s in documents_of(batch):
                ns.append(len(s))
                nodes.append(set_id(s) if len(s) else None)
                seconds.append(set_id(s, nodes[-1] | 1) if len(s) else None)
                if len(s) and nodes[-1] not in known:
                    known.add(nodes[-1])
                    held.append(s)
                    size += len(s)
                    if size > FLUSH:
                        counts += np.bincount((np.concatenate(held) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                        held, size = [], 0
            m = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column("doc_id"), batch.column("same"), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(seconds, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
            if len(known) > KNOWN:
                known = set()
        if held:
            counts += np.bincount((np.concatenate(held) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(RANGES, -1)
        own = [k for k in range(RANGES) if parts[k].any()]
        if own:
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(5)), pa.array(own, pa.int32()), pa.array([parts[k].tobytes() for k in own], pa.binary())], schema=schema)

    ddl = "kind int, doc_id bigint, same bigint, n bigint, node bigint, second bigint, bucket int, blob binary"
    return table(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("same"), "text").mapInArrow(tidy(run), ddl), "measured")


def commonness(measured: DataFrame) -> np.ndarray:
    """A byte for each cell of the sketch: how many documents its shingles are in, on a log scale. 2 MB, of fixed size.

    It only orders tokens, common ones last, and any order gives the same links."""

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in gathered(it):
            sums = np.zeros((1 << SKETCH_BITS) // RANGES, np.int64)
            for x in blobs:
                sums += np.frombuffer(x, np.uint8)
            yield blob_batch([(b, np.minimum(np.round(8 * np.log2(sums + 1.0)), 255).astype(np.uint8).tobytes())])

    spark = measured.sparkSession
    out = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), np.uint8)
    ranges = to_buckets(measured.where("kind = 1").select("bucket", "blob"), min(RANGES, partitions(spark)))
    for r in ranges.mapInArrow(tidy(total), "bucket int, blob binary").toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["blob"], np.uint8)
    return out.reshape(-1)


def clashing(measured: DataFrame) -> frozenset:
    """Ids that different sets share: at ten thousand million sets, fewer than ten are to be expected."""
    twice = measured.where("node is not null").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    found = twice.select("node").limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise RuntimeError(f"more than {CLASHES} ids of sets are shared")
    return frozenset(r["node"] for r in found)


def groups(docs: DataFrame, common: np.ndarray, clashes: frozenset) -> DataFrame:
    """Sets that share a prefix token: g, node, n, weight, and the next smaller member (prev, prev_n) if its size fits.

    Postings go to token buckets as packed arrays, equal sets once from each task. g is a hash of the members:
    groups of the same members are one, with the number of their tokens as weight. Tokens of only one set vanish."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    sent = spark.sparkContext.broadcast(common)

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, known = sent.value, set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate([x[0] for x in held])
            lens = [len(x[0]) for x in held]
            node, n = np.repeat(np.array([x[1] for x in held], np.int64), lens), np.repeat(np.array([x[2] for x in held], np.int32), lens)
            return blob_batch(list(by_bucket((mix(t) % U(buckets)).astype(np.int64), buckets, t=t, node=node, n=n)))

        for batch in it:
            for _, s in documents_of(batch):
                if not len(s) or (node := node_of(s, clashes)) in known:
                    continue
                known.add(node)
                t = (rank[(s >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U(56)) | (s & U((1 << 56) - 1))
                k = prefix_length(len(s))
                held.append((np.partition(t, k - 1)[:k] if k < len(t) else t, node, len(s)))
                size += k
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
            if len(known) > KNOWN:
                known = set()
        if held:
            yield flush()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in gathered(it):
            parts = [unpack(x, t=np.uint64, node=np.int64, n=np.int32) for x in blobs]
            t, node, n = (np.concatenate([p[c] for p in parts]) for c in ("t", "node", "n"))
            del parts
            twice = np.sort(t)
            twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
            at = np.searchsorted(twice, t)
            at[at == len(twice)] = 0
            keep = twice[at] == t if len(twice) else np.zeros(len(t), bool)
            t, node, n = t[keep], node[keep], n[keep]
            o = np.lexsort((node, n, t))
            t, node, n = t[o], node[o], n[o]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
            t, node, n = t[fresh], node[fresh], n[fresh]
            if not len(t):
                continue
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([first, [len(t)]]))
            who = np.add.reduceat(mix(node.view(np.uint64)), first)
            _, one, of, weight = np.unique(np.stack([who, size.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            pick = np.zeros(len(first), bool)
            pick[one] = True
            pick &= size > 1
            member = np.repeat(pick, size)
            g, w = np.repeat(mix(who + size.astype(np.uint64)).view(np.int64), size), np.repeat(weight[of.reshape(-1)], size)
            prev, prev_n = np.roll(node, 1), np.roll(n, 1)
            heads = np.zeros(len(t), bool)
            heads[first] = True
            none = heads | (prev_n.astype(np.int64) * DEN < n.astype(np.int64) * NUM)
            rows = np.flatnonzero(member)
            for a in range(0, len(rows), 1 << 16):
                r = rows[a : a + (1 << 16)]
                cols = [pa.array(g[r]), pa.array(node[r]), pa.array(n[r].astype(np.int64)), pa.array(w[r].astype(np.int64)), pa.array(prev[r], mask=none[r]), pa.array(prev_n[r].astype(np.int64), mask=none[r])]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "node", "n", "weight", "prev", "prev_n"])

    posted = docs.select("text").mapInArrow(tidy(post), "bucket int, blob binary")
    met = to_buckets(posted, partitions(spark)).mapInArrow(tidy(meet), "g bigint, node bigint, n bigint, weight bigint, prev bigint, prev_n bigint")
    one = met.groupBy("g", "node").agg(F.first("n").alias("n"), F.sum("weight").alias("weight"), F.first("prev").alias("prev"), F.first("prev_n").alias("prev_n"))
    return table(one, "groups")


def sets(docs: DataFrame, small: DataFrame, nodes: DataFrame, tokens: bool, clashes: frozenset) -> DataFrame:
    """node, n and bits (or the sorted, packed tokens) of the wanted nodes, one row each, from one document's text."""
    ids = table(small.join(limited(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "wanted")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(limited(ids).withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    what = "tokens" if tokens else "bits"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [(node_of(s, clashes), len(s), (s if tokens else bitmap(s)).tobytes()) for _, s in documents_of(batch) if len(s)]
            for a in range(0, len(found), 256):
                part = found[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", what])

    made = rows.mapInArrow(tidy(run), f"node bigint, n bigint, {what} binary")
    return table(needing(made.join(limited(nodes), "node", "left_semi").dropDuplicates(["node"]), ids, nodes), what)


def width(n: int) -> int:
    """Bits of a set's bitmap: a power of two from two to four times its size."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    w = width(len(s))
    out = np.zeros(w // 64, np.uint64)
    at = s & U(w - 1)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap of fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def linked(shared: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    """shared of sets with `both` elements together, each counted: likeness reaches NUM / DEN."""
    return (NUM + DEN) * shared >= NUM * both


def _pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _filtered(pairs: DataFrame, known: DataFrame, what: str, test: Callable) -> DataFrame:
    """Pairs (a, b) for which test(n, column of a, n, column of b) holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b, m, n = (batch.column(c).to_pylist() for c in ("a", "b", "m", "n"))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            yield _pairs_of([(a[i], b[i]) for i in range(len(a)) if test(m[i], x[i], n[i], y[i])])

    left = known.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col(what).alias("x"))
    right = known.select(F.col("node").alias("b"), "n", F.col(what).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "m", "x", "b", "n", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs that their bitmaps don't rule out."""

    def test(m: int, x: np.ndarray, n: int, y: np.ndarray) -> bool:
        words = min(len(x), len(y))
        x, y = folded(x, words), folded(y, words)
        both = int(np.bitwise_count(x & y).sum())
        return linked(min(m - int(np.bitwise_count(x).sum()) + both, n - int(np.bitwise_count(y).sum()) + both), m + n)

    return _filtered(pairs, bits, "bits", test)


def verify(pairs: DataFrame, docs: DataFrame, small: DataFrame, clashes: frozenset) -> DataFrame:
    """The pairs (a, b) that are links, by intersecting the sorted arrays of the sets that are in a pair."""

    def test(m: int, x: np.ndarray, n: int, y: np.ndarray) -> bool:
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return linked(int((y[at] == x).sum()), m + n)

    nodes = table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    tokens = sets(docs, small, nodes, True, clashes)
    return needing(_filtered(pairs, tokens, "tokens", test), tokens)


def band(n: Column) -> Column:
    """Size band: linked sets are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")


def tile_pairs(open_members: DataFrame, known: DataFrame, best: bool) -> DataFrame:
    """Pairs of members of one group with different labels whose bitmaps don't rule out a link; `best`: for each member
    only the likeliest.

    A tile is a group, a size band with the one above, and a pair of its blocks of about TILE members: groups of any
    size are many tiles, and no pairs are written but those that pass the bound. Members with the commonest label of a
    group, which are together already, meet the others and not each other: where those are few, the work grows with the
    group's size and not with its square. Sets often meet in several groups. Each
    member carries the least ids of its groups, GROUPS_KNOWN at most; a pair is left to a lesser group that both carry.
    The least group that a pair meets in never leaves it, so no pair is lost, however many groups its sets have."""
    rows = open_members.withColumn("band", band(F.col("n"))).withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    counts = rows.groupBy("g", "tile", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("g", "tile").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c")).where("c > top.c")
    blocks = lambda c: F.ceil(c / TILE).cast("int")
    few, many = blocks(F.col("c") - F.col("top.c")), F.when(F.col("c") > TILE, blocks(F.col("top.c"))).otherwise(0)
    counts = table(counts.select("g", "tile", F.col("top.label").alias("top"), few.alias("few"), many.alias("many")), "tiles")
    rows = rows.join(counts, ["g", "tile"]).withColumn("major", (F.col("label") == F.col("top")) & (F.col("many") > 0))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("major"), F.col("few") + block(F.col("many"))).otherwise(block(F.col("few"))))
    others = F.when(F.col("major"), F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
    rows = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    lists = open_members.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("g")), 1, GROUPS_KNOWN).alias("groups"))
    rows = rows.join(known.select("node", "bits"), "node").join(lists, "node")
    rows = rows.withColumn("before", F.filter("groups", lambda h: h < F.col("g")))
    key = ["g", "tile", "i", "j"]
    rows = rows.select(*key, "node", "n", "label", "band", "mine", "bits", "before").repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list[tuple], k: tuple) -> Iterator[pa.RecordBatch]:
            node, n, label, up, mine = (np.concatenate([p[0][c] for p in parts]) for c in range(5))
            blobs, before = [x for p in parts for x in p[1]], [x for p in parts for x in p[2]]
            words = min(x.size // 8 for x in blobs)
            bits = np.stack([folded(np.frombuffer(x, np.uint64), words) for x in blobs])
            up = up == k[1] + 1
            ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            known = np.full((len(node), max(map(len, before))), k[0])  # no list has the group itself
            for x, own in enumerate(before):
                known[x, : len(own)] = own
            top, partner = np.zeros(len(node)), np.full(len(node), -1)
            held, size = [], 0
            for x in range(len(node) - 1):
                y = np.arange(x + 1, len(node))
                ok = (label[y] != label[x]) & ~(up[y] & up[x]) & (np.minimum(n[y], n[x]) * DEN >= np.maximum(n[y], n[x]) * NUM)
                if k[2] != k[3]:
                    ok &= mine[y] != mine[x]
                y = y[ok]
                if not len(y):
                    continue
                both = np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64)
                bound = np.minimum(n[x] - (ones[x] - both), n[y] - (ones[y] - both))
                fit = linked(bound, n[x] + n[y])
                y, score = y[fit], bound[fit] / (n[x] + n[y[fit]])
                if len(y) and len(own := before[x]):
                    at = np.searchsorted(own, known[y])
                    at[at == len(own)] = 0
                    here = ~(own[at] == known[y]).any(axis=1)
                    y, score = y[here], score[here]
                if not len(y):
                    continue
                if best:
                    more = score > top[y]
                    top[y[more]], partner[y[more]] = score[more], x
                    if score.max() > top[x]:
                        top[x], partner[x] = score.max(), y[score.argmax()]
                    continue
                held.append((np.full(len(y), node[x]), node[y]))
                size += len(y)
                if size > 1 << 16:
                    yield ordered(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
            if best:
                held = [(node[partner >= 0], node[partner[partner >= 0]])]
            if held:
                yield ordered(*map(np.concatenate, zip(*held, strict=True)))

        def ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        now, parts = None, []
        for batch in it:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], 1)
            numbers = [batch.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "label", "band", "mine")]
            blobs, lists = [x.as_buffer() for x in batch.column("bits")], batch.column("before")
            ids, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905 - runs of rows of one tile
                k = tuple(keys[a].tolist()) if b > a else now
                if k != now:
                    if sum(len(p[1]) for p in parts) > 1:
                        yield from pairs(parts, now)
                    now, parts = k, []
                if b > a:
                    parts.append(([c[a:b] for c in numbers], blobs[a:b], [ids[off[r] : off[r + 1]] for r in range(a, b)]))
        if sum(len(p[1]) for p in parts) > 1:
            yield from pairs(parts, now)

    return needing(rows.mapInArrow(tidy(run), "a bigint, b bigint").distinct(), counts)


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset]:
    """Rows (doc_id, same, n, node), the labels (node, label) of sets that are linked to others, and ids that sets share."""
    measured = measure(docs)
    clashes = clashing(measured)
    node = F.when(F.col("node").isin(*clashes), F.col("second")).otherwise(F.col("node")) if clashes else F.col("node")
    small = measured.where("kind = 0").select("doc_id", "same", "n", node.alias("node"))
    met = groups(docs, commonness(measured), clashes)
    bits = sets(docs, small, table(met.select("node").distinct(), "nodes"), False, clashes)
    # One likely link a set merges most copies, so that groups of copies are not compared pair by pair.
    best = met.where("prev is not null").groupBy("node", "prev").agg(F.sum("weight").alias("w"))
    best = best.groupBy("node").agg(F.max_by("prev", F.struct("w", "prev")).alias("prev"))
    first = table(plausible(best.select(F.col("prev").alias("a"), F.col("node").alias("b")), bits), "first")
    links = table(verify(first, docs, small, clashes), "links")
    release(first)
    labels = components(links)
    # Other members of a group are compared unless they are together already: in MERGING rounds each set with the
    # likeliest in each of its groups; in the last round, all pairs that are left.
    for k in range(MERGING + 1):
        members = met.select("g", "node", "n").join(labels, "node", "left")
        members = table(members.select("g", "node", "n", F.coalesce("label", "node").alias("label")), "members")
        spread = table(members.groupBy("g").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("g"), "open")
        rest = table(tile_pairs(members.join(spread, "g", "left_semi"), bits, k < MERGING), "pairs")
        more = verify(rest, docs, small, clashes)
        links = table(needing(links.union(more), links, *more._needs), "links")
        release(members, spread, rest, labels)
        labels = components(links)
    release(links, bits, met)
    return small, labels, clashes


def counted_links(docs: DataFrame, small: DataFrame, labels: DataFrame, clashes: frozenset) -> DataFrame:
    """node and links: in how many rows a linked set occurs that is another one. No pairs are written.

    All links are inside components, so every pair of a component's sets is compared exactly, but those whose sizes rule
    a link out. Tiles are as in tile_pairs, so that each pair meets in one: both in the tile's band or one in that above,
    and in the two blocks of the tile."""
    copies = small.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    tokens = sets(docs, small, table(labels.select("node").distinct(), "nodes"), True, clashes)
    ids = table(tokens.select("node", "n").join(labels, "node").join(copies, "node").withColumn("band", band(F.col("n"))), "members")
    rows = ids.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_TOKENS)).cast("int")
    tiles = rows.groupBy("label", "tile").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m"), F.min("band").alias("low")).where("m > 1 and low = tile")
    tiles = table(tiles.select("label", "tile", "blocks"), "tiles")
    rows = rows.join(tiles, ["label", "tile"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    key = ["label", "tile", "i", "j"]
    rows = rows.join(tokens.select("node", "tokens"), "node").select(*key, "node", "n", "c", "band", "mine", "tokens").repartition(partitions(docs.sparkSession), *key).sortWithinPartitions(*key)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(members: list[tuple], k: tuple) -> pa.RecordBatch:
            m = len(members)
            node, n, c, up, mine = (np.array([x[f] for x in members], np.int64) for f in range(5))
            up = up == k[1] + 1
            t = np.concatenate([np.frombuffer(x[5], np.uint64) for x in members])
            who = np.repeat(np.arange(m), n)
            _, at, held = np.unique(t, return_inverse=True, return_counts=True)
            some = (held > 1) & (held < m)  # tokens of one set are in no intersection, those of all in every one
            column = np.cumsum(some) - 1
            keep = some[at]
            who, at = who[keep], column[at[keep]]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            shared = np.full((m, m), (held == m).sum(), np.float32)
            for a in range(0, int(some.sum()), COLUMNS):
                x, y = np.searchsorted(at, [a, a + COLUMNS])
                part = np.zeros((m, min(COLUMNS, int(some.sum()) - a)), np.float32)
                part[who[x:y], at[x:y] - a] = 1
                shared += part @ part.T
            out = np.zeros(m, np.int64)
            for a in range(0, m, 256):
                x = np.arange(a, min(a + 256, m))
                ok = linked(shared[x].astype(np.int64), n[x, None] + n) & ~(up[x, None] & up)
                ok[np.arange(len(x)), x] = False
                if k[2] != k[3]:
                    ok &= mine[x, None] != mine
                out[x] = ok @ c
            return pa.RecordBatch.from_arrays([pa.array(node[out > 0]), pa.array(out[out > 0])], names=["node", "links"])

        now, members = None, []
        for batch in it:
            columns = [batch.column(x).to_pylist() for x in batch.schema.names[:-1]]
            for row in zip(*columns, (x.as_buffer() for x in batch.column("tokens")), strict=True):
                if row[:4] != now:
                    if len(members) > 1:
                        yield links(members, now)
                    now, members = row[:4], []
                members.append(row[4:])
        if len(members) > 1:
            yield links(members, now)

    return table(needing(rows.mapInArrow(tidy(run), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links")), tokens, ids, tiles), "counted")


def component_ids(small: DataFrame, labels: DataFrame) -> DataFrame:
    """node, its number of rows c and the component, of all sets that are linked to another row."""
    node = small.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    named = node.join(labels, "node", "left").where("c > 1 or label is not null").select("node", "least", "c", F.coalesce("label", "node").alias("label"))
    named = table(named, "named")
    least = table(named.groupBy("label").agg(F.min("least").alias("component")), "least")
    return table(needing(named.join(least, "label").select("node", "c", "component"), named, least), "components")


def component_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id.

    Null, empty or blank text: no shingles, a component of its own. Equal texts and repeated rows: linked. Null doc_id:
    linked as any other, and never the smallest. Very long texts: hashed piece by piece. Ties of candidates change no
    result. Empty tables: empty results. Other columns of the table are not read, whatever their names.
    """
    small, labels, _ = link(docs)
    ids = component_ids(small, labels).drop("c")
    return small.join(limited(ids), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def link_table(docs: DataFrame) -> DataFrame:
    """The digest of op9: as component_table, and n_links, the number of other rows that each row is linked to."""
    small, labels, clashes = link(docs)
    links = F.col("c") - 1 + F.coalesce("links", F.lit(0))
    ids, counted = component_ids(small, labels), counted_links(docs, small, labels, clashes)
    ids = table(needing(ids.join(counted, "node", "left").select("node", "component", links.alias("n_links")), ids, counted, labels), "links")
    found = small.join(limited(ids), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays, and all rows without words. Same columns.

    It is the row with the smallest doc_id, null last; of several texts under that id, the one with the least hash. Rows
    are known by doc_id and text together: another text under the id of a row that goes is judged for itself. Null, empty
    and blank texts have no words and stay. Repeated rows: one stays. Very long texts: hashed piece by piece. Empty tables:
    empty results. Columns of any names pass through; the ones made here have names that the table does not have."""
    _id, _as, _same = (unused(docs, x) for x in ("_id", "_as", "_same"))
    small, labels, _ = link(docs)
    named = small.where("node is not null").join(labels, "node", "left").select("doc_id", "same", F.coalesce("label", "node").alias("label"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("first"), F.count(F.lit(1)).alias("c"))
    first = table(first.where("c > 1").select("label", "first"), "first")
    found = table(named.join(limited(first), "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("same") == F.col("first.same"))), "dedup")
    names = [F.col("doc_id").alias(_id), F.col("same").alias(_as)]
    gone = table(found.where("not stays").select(*names).distinct(), "gone")
    release(first, labels)
    twice = table(found.where("stays").groupBy(*names).count().where("count > 1").select(_id, _as), "twice")
    release(found)
    rows = docs.withColumn(_same, F.xxhash64("text"))
    alike = F.col("doc_id").cast("bigint").eqNullSafe(F.col(_id)) & (F.col(_same) == F.col(_as))
    left = rows.join(limited(gone), alike, "left_anti")
    if twice.isEmpty():
        return left.drop(_same)
    again = left.join(limited(twice), alike, "left_semi").dropDuplicates(["doc_id", _same])
    return left.join(limited(twice), alike, "left_anti").unionByName(again).drop(_same)


__all__ = ["component_table", "keep_one", "link", "link_table", "pack"]
