"""Files on any Hadoop file system to chunk rows, one task for each file."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.model import DOCUMENT, META, normalize_layer, tagged
from tesserae.sources import extract_json, split_json, xml

CELL = 256 << 20  # bytes of a file up to which it is read as one cell
#: One row for each chunk: bytes, metadata, and the columns of a document.
STAGED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("meta", META), *DOCUMENT.fields])


@dataclass(frozen=True)
class ImportOptions:
    layer: str = ""
    tags: tuple[str, ...] = ()
    properties: tuple[tuple[str, object], ...] = ()
    fallback_crs: str | None = None
    correlation_id: str | None = None
    strict: bool = False
    flatten: bool = False
    import_ts: int = 0
    import_id: str = ""  # begins the names of the chunks, so that those of two imports differ
    splitter: str | Callable = "geojson"  # of files that are not XML; see SPLITTERS
    indexers: tuple[Callable, ...] = ()
    meta_indexers: tuple[Callable, ...] = ()
    mime: str | None = None  # of all files, if it is not to be found out
    strict_pairs: bool = False  # coordinates as x, y, x, y, whatever their nesting
    off_globe: bool = False  # boxes beyond 180 degrees of longitude or 90 of latitude are kept, not dropped


def belongs_to(mime: str, kind: str, suffix: str) -> bool:
    """`application/json`, `application/geo+json` and the like belong to (application, json)."""
    return re.fullmatch(rf"{re.escape(kind)}/([\w.-]+\+)?{re.escape(suffix)}(;.*)?", mime) is not None


def sniff(data: bytes) -> str | None:
    """By the first character that is not blank, within 100 KB."""
    head = data[:100_000].removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    return "application/json" if head in (b"{", b"[") and head else "application/xml" if head == b"<" else None


def unzipped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces of a file, or of what is in it, if it is a gzip file of one or more members."""
    it = iter(pieces)
    first = next(it, b"")
    if first[:2] != b"\x1f\x8b":
        yield from chain([first], it)
        return
    unzip = zlib.decompressobj(31)
    for piece in chain([first], it):
        while piece:
            yield unzip.decompress(piece, split_json.PIECE)
            piece = unzip.unconsumed_tail
            if unzip.eof:
                piece, unzip = unzip.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
    yield unzip.flush()


def rows(data: bytes | Iterable[bytes], filename: str, o: ImportOptions, mime: str | None = None) -> Iterator[dict]:
    """Chunk rows of one file, in order, read piece by piece. A chunk is named by its layer, import, file and number."""
    pieces = unzipped(split_json.pieces_of(data))
    first = next(pieces, b"")
    mime = mime or o.mime or sniff(first)
    data = chain([first], pieces)
    named = f"{o.import_id}{hashlib.sha256(filename.encode()).hexdigest()[:16]}"
    filename = filename.rsplit("/", 1)[-1]
    layer = normalize_layer(o.layer)
    common = {
        "layer": layer,
        "correlation_id": o.correlation_id or named,
        "filename": filename,
        "import_ts": o.import_ts,
        "mime": mime,
        "tags": list(o.tags),
        "props": [tagged(k, v) for k, v in o.properties],
        "gml_ids": [],
        "geojson_ids": [],
        "address": None,
    }
    if mime is not None and (belongs_to(mime, "application", "json") or belongs_to(mime, "text", "json")):
        found = json_rows(data, o)
    elif mime is not None and (belongs_to(mime, "application", "xml") or belongs_to(mime, "text", "xml")):
        found = xml_rows(data, o)
    else:
        raise ValueError(f"{filename}: neither JSON nor XML")
    for n, row in enumerate(found):
        meta = {"mime": mime, "geojson_type": None, "parent_name": None, "header": None, "parents": []} | row.pop("meta")
        box = extract_json.valid(row.pop("box"), o.off_globe) or (None,) * 4
        props = common["props"] + indexed(meta, o.meta_indexers)
        meta_id = hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()
        yield common | {"path": f"{layer or '/'}{named}{n:09d}", "meta": meta, "meta_id": meta_id, "props": props} | dict(zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)) | row


#: How JSON files are split, by name; others can be added, with the type that their files are taken for.
SPLITTERS: dict[str, Callable] = {"geojson": split_json.split_geojson, "json": split_json.split_json}
SPLITTER_TYPES: dict[str, str] = {}
INDEXERS: list[Callable] = []
META_INDEXERS: list[Callable] = []


def resolved(o: ImportOptions) -> ImportOptions:
    """The options with what is registered by name, for tasks, which know nothing of the driver's registers."""
    found = SPLITTERS[o.splitter] if isinstance(o.splitter, str) else o.splitter
    mime = SPLITTER_TYPES.get(o.splitter, o.mime) if isinstance(o.splitter, str) else o.mime
    return replace(o, splitter=found, mime=mime, indexers=(*o.indexers, *INDEXERS), meta_indexers=(*o.meta_indexers, *META_INDEXERS))


def json_rows(data: bytes, o: ImportOptions) -> Iterator[dict]:
    for c in o.splitter(data):
        kind = c.value.get("type") if isinstance(c.value, dict) else None
        yield {
            "data": c.data,
            "meta": {"geojson_type": kind if isinstance(kind, str) else None, "parent_name": c.parent_name},
            "attrs": (extract_json.flattened(c.value) if o.flatten else extract_json.properties(c.value)) + indexed(c.value, o.indexers),
            "geojson_ids": extract_json.feature_ids(c.value),
            "box": extract_json.bounding_box(c.value, o.strict_pairs),
        }


def indexed(value: object, indexers: Iterable[Callable]) -> list[dict]:
    return [tagged(k, v) for f in indexers for k, v in f(value).items()]


def xml_rows(data: bytes, o: ImportOptions) -> Iterator[dict]:
    skip = frozenset(["Envelope"]) if o.strict else frozenset()
    for c in xml.split(data, self_closing=not o.strict, skip=skip, strict=o.strict, fallback_crs=o.fallback_crs, first_text=o.strict):
        address = {k: c.address.get(k) for k in ("Country", "Locality", "Street", "Number")} if c.address else None
        yield {"data": c.data, "meta": {"parents": [c.root.row()]}, "attrs": c.attrs + indexed(c, o.indexers), "gml_ids": c.gml_ids, "address": address, "box": c.box}


def read_files(spark: SparkSession, paths: str | list[str], o: ImportOptions, glob: str | None = None, cell: int = CELL) -> DataFrame:
    """Staged rows of all files that the paths and the optional file name pattern match. gzip is read as it is.

    Files of up to `cell` bytes come as cells of the table of files. Larger ones, which no cell can hold beyond 2 GB, are
    opened by the task that reads them, and are never whole in memory."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = reader.load(paths)
    small = stage(files.where(F.col("length") <= cell), o)
    large = files.where(F.col("length") > cell).select("path", F.lit(None).cast("binary").alias("content"))
    return small if large.isEmpty() else small.union(stage(large.repartition(large.count(), "path"), o))


def opened(path: str) -> Iterator[bytes]:
    """A file's bytes, from any file system that Arrow knows."""
    fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    with fs.open_input_stream(name, compression=None) as f:
        while piece := f.read(split_json.PIECE):
            yield piece


def stage(files: DataFrame, o: ImportOptions) -> DataFrame:
    """Staged rows of files (path, content); a file without content is opened by its path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, o = to_arrow_schema(STAGED), resolved(o)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer()) if content.is_valid else opened(path)
                held, size = [], 0
                for row in rows(data, path, o):
                    held.append(row)
                    size += len(row["data"])
                    if len(held) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, STAGED)
