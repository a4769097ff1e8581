"""Matroska: bytes as 8-bit PCM in laced blocks, and a parser that gives packet tables with byte ranges."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, APP, MUXER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, ENTRY, AUDIO, GROUP, POINT, CUE_PLACE}
NONE, XIPH, FIXED, EBML_LACED = range(4)
LACE_NAMES = ("none", "xiph", "fixed", "ebml")
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 4096, 8, 7


def vint(n: int, size: int = 0) -> bytes:
    """A length: as many bytes as the leading zero bits say. All ones is reserved for an unknown size."""
    size = size or next(k for k in range(1, 9) if n < (1 << (7 * k)) - 1)
    return (n | 1 << (7 * size)).to_bytes(size, "big")


def element(i: int, body: bytes) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(i: int, x: float) -> bytes:
    import struct

    return element(i, struct.pack(">d", x))


def lace(frames: list[bytes], mode: int) -> bytes:
    """The lacing header and the frames."""
    if mode == NONE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == XIPH:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif mode == EBML_LACED:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):  # noqa: B905 - the last size follows from the block's
            size = next(k for k in range(1, 9) if abs(b - a) < (1 << (7 * k - 1)) - 1)
            head += vint(b - a + (1 << (7 * size - 1)) - 1, size)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """One track of 8-bit samples. Equal frames have fixed lacing; a last, uneven block has EBML lacing, or Xiph when short."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ms = lambda n: n * frame * 1000 // SAMPLE_RATE
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / SAMPLE_RATE) + element(APP, b"tesserae") + element(MUXER, b"tesserae"))
    audio = element(AUDIO, real(RATE, SAMPLE_RATE) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), laced * blocks):
        body = [uint(TIME, ms(first))]
        for b in range(first, min(first + laced * blocks, len(frames)), laced):
            own = frames[b : min(b + laced, first + laced * blocks)]
            mode = NONE if len(own) == 1 else FIXED if len({len(f) for f in own}) == 1 else XIPH if len(own) == 2 else EBML_LACED
            body.append(element(SIMPLE_BLOCK, vint(1) + (ms(b) - ms(first)).to_bytes(2, "big", signed=True) + bytes([0x80 | mode << 1]) + lace(own, mode)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, uint(CUE_TIME, ms(first)) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    track: int
    time: int
    start: int
    stop: int
    lacing: int
    keyframe: bool


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte offset of the cluster
    clusters: list[int] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    duration: float = 0.0
    scale: int = 1_000_000  # nanoseconds of a tick


def read_vint(data: bytes, at: int, raw: bool = False) -> tuple[int, int, bool]:
    """Value, position after it, and whether it is the reserved unknown size. Raw: an id, with its marker bit."""
    first = data[at] if at < len(data) else 0
    if not first:
        raise ValueError(f"no length marker at {at}")
    size = 9 - first.bit_length()
    if at + size > len(data):
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + size], "big")
    body = n & ((1 << (7 * size)) - 1)
    return (n if raw else body), at + size, body == (1 << (7 * size)) - 1


def elements(data: bytes, at: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, start of the header, start and end of the body. An unknown size ends with the parent or the next cluster's start."""
    while at < stop:
        head = at
        i, at, _ = read_vint(data, at, raw=True)
        n, body, unknown = read_vint(data, at)
        end = stop if unknown else body + n
        if end > stop:
            raise ValueError(f"element at {head} runs over its parent")
        if unknown and i == CLUSTER:
            end = body
            while end < stop and (nxt := read_vint(data, end, raw=True))[0] not in (CLUSTER, CUES, TRACKS, INFO):
                n, b, _ = read_vint(data, nxt[1])
                end = b + n
        yield i, head, body, end
        at = end


def unlace(data: bytes, at: int, stop: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block."""
    if mode == NONE:
        return [(at, stop)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif mode == EBML_LACED:
        for k in range(count - 1):
            begin = at
            n, at, _ = read_vint(data, at)
            sizes.append(n if not k else sizes[-1] + n - ((1 << (7 * (at - begin) - 1)) - 1))
    else:
        if (stop - at) % count:
            raise ValueError("fixed lacing of uneven frames")
        sizes = [(stop - at) // count] * (count - 1)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run over their block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def parse(data: bytes) -> Media:
    """Packets, cues, clusters and tracks. Times are in milliseconds, whatever the scale of the file's ticks."""
    import struct

    m, segment = Media(), 0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    rate, ticks = float(SAMPLE_RATE), 0.0

    def block(a: int, b: int, base: int, simple: bool) -> None:
        track, at, _ = read_vint(data, a)
        rel = int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        mode, time = flags >> 1 & 3, (base + rel) * m.scale / 1e6
        step = 1000 / (m.tracks.get(track, {}).get("rate") or rate)
        for s, e in unlace(data, at + 3, b, mode):
            m.packets.append(Packet(track, round(time), s, e, mode, simple and bool(flags & 0x80)))
            time += (e - s) * step

    def walk(at: int, stop: int, own: dict) -> None:
        nonlocal segment, ticks
        for i, head, a, b in elements(data, at, stop):
            if i == SEGMENT:
                segment = a
                for j, _, c, d in elements(data, a, b):  # what all times rest on, wherever it stands
                    if j in (INFO, TRACKS):
                        walk(c, d, {})
            if i == CLUSTER:
                m.clusters.append(head - segment)
                walk(a, b, {"time": 0})
            elif i in MASTERS:
                below: dict = own if i in (GROUP, AUDIO, CUE_PLACE) else {}
                walk(a, b, below)
                if i == ENTRY:
                    m.tracks[below.get("number", 0)] = below
                elif i == POINT:
                    m.cues.append((round(below.get("time", 0) * m.scale / 1e6), below.get("track", 0), below.get("cluster", 0)))
            elif i in (TIME, CUE_TIME):
                own["time"] = number(a, b)
            elif i == SIMPLE_BLOCK or i == BLOCK:
                block(a, b, own.get("time", 0), i == SIMPLE_BLOCK)
            elif i in (NUMBER, CUE_TRACK):
                own["number" if i == NUMBER else "track"] = number(a, b)
            elif i == SCALE:
                m.scale = number(a, b)
            elif i == CUE_CLUSTER:
                own["cluster"] = number(a, b)
            elif i == CODEC:
                own["codec"] = data[a:b].decode()
            elif i in (RATE, DURATION):
                x = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
                if i == RATE:
                    own["rate"] = x
                else:
                    ticks = x

    walk(0, len(data), {})
    m.duration = ticks * m.scale / 1e6
    return m


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled with zeros to a positive multiple of 64, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


def features(data: bytes, m: Media) -> str:
    laces = Counter(p.lacing for p in m.packets)
    clusters = set(m.clusters)
    good = sum(c in clusters for _, _, c in m.cues)
    lacing = "/".join(f"{LACE_NAMES[k]}:{laces[k]}" for k in sorted(laces))
    total = sum(p.stop - p.start for p in m.packets)
    own = np.frombuffer(data, np.uint8)
    mean = sum(int(own[p.start : p.stop].sum(dtype=np.int64)) for p in m.packets) / max(1, total)
    return f"tracks={len(m.tracks)};packets={len(m.packets)};clusters={len(m.clusters)};cues={good};ms={m.duration:.3f};lacing={lacing};mean={mean:.6f}"


def packet_table(media: DataFrame, key: str, data: str) -> DataFrame:
    """A row for each packet of stored media: key, packet, track, time_ms, start, stop, lacing, keyframe. Null media: none.

    Empty media have no packets; damaged ones raise ValueError. Repeated rows: each for itself. Very long media: one at a
    time, whole. Empty tables: empty results. A packet column whose name the key has gets an underscore."""
    from pyspark.sql import types as T

    taken = key.lower()
    ddl = "packet int, track int, time_ms bigint, start bigint, stop bigint, lacing string, keyframe boolean"
    fields = [T.StructField(f.name + "_" * (f.name == taken), f.dataType) for f in T.StructType.fromDDL(ddl)]
    schema = T.StructType([media.schema[key], *fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k, blob in zip(batch.column(key), batch.column(data), strict=True):
                if blob.is_valid and (found := parse(blob.as_py()).packets):
                    cols = [[k.as_py()] * len(found), list(range(len(found))), [p.track for p in found], [p.time for p in found], [p.start for p in found], [p.stop for p in found], [LACE_NAMES[p.lacing] for p in found], [p.keyframe for p in found]]
                    kinds = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=schema.names)

    return media.select(key, data).mapInArrow(run, schema)


def media_table(docs: DataFrame) -> DataFrame:
    """The digest of op6. Null or empty text: 64 zero bytes. Very long texts: one at a time is in memory, with its stored
    form. Ties and repeated rows: each for itself; equal texts give equal values. Empty tables: empty results. Other
    columns of the table are not read, whatever their names."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")])

    def one(text: str | None) -> tuple:
        payload, n = padded(text)
        stored = write(payload)
        m = parse(stored)
        back = b"".join(stored[p.start : p.stop] for p in m.packets)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(stored, m)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [one(t.as_py()) for t in part.column("text")]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
