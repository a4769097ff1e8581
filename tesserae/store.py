"""The store: chunk, document and metadata tables in versions, on any Hadoop file system.

A version is a small manifest: which files and folders make up each table, their schema, and what was imported. Imports
add folders; changes replace the files that have a match. A version becomes current by the exclusive creation of its
manifest, so that two writers can't make the same one: the later builds on the earlier. Readers of older versions go on.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.spatial import curve_column
from tesserae.functions.text import all_values_column, norm_column, token_column
from tesserae.model import DOCUMENT, META, normalize_layer
from tesserae.operators import merge as merging
from tesserae.operators import mutate, select, words
from tesserae.plans.lower import plan
from tesserae.plans.translate import index_columns
from tesserae.sources.files import ImportOptions, read_files, stage

TABLES = ("documents", "chunks", "chunk_meta", "postings")
_TEXT = T.StringType()
EMPTY = {
    "documents": T.StructType([*DOCUMENT, T.StructField("tokens", T.ArrayType(_TEXT)), T.StructField("text_norm", _TEXT)]),
    "chunks": T.StructType([T.StructField("path", _TEXT), T.StructField("data", T.BinaryType())]),
    "chunk_meta": T.StructType([T.StructField("meta_id", _TEXT), T.StructField("meta", META)]),
    "postings": T.StructType([T.StructField("word", _TEXT), T.StructField("path", _TEXT), T.StructField("place", T.IntegerType())]),
}


def _wider(old: str | None, new: str) -> str:
    """A schema with the columns of both."""
    if old is None:
        return new
    have, more = (T.StructType.fromJson(json.loads(x)) for x in (old, new))
    return T.StructType([*have, *(f for f in more if f.name not in have.names)]).json()


class NoMatch(LookupError):
    """A query that selects nothing."""


class MissingChunk(LookupError):
    """Paths without bytes."""


class Conflict(RuntimeError):
    """Files that a change is about were replaced meanwhile; the change is made again, on the newer version."""


@dataclass
class Manifest:
    """For each table the files and folders that make it up; the documents' columns and indexed fields; the imports."""

    version: int = 0
    documents: list[str] = field(default_factory=list)
    chunks: list[str] = field(default_factory=list)
    chunk_meta: list[str] = field(default_factory=list)
    postings: list[str] = field(default_factory=list)
    columns: dict[str, str] = field(default_factory=dict)
    indexed: list[str] | None = None
    cells: bool | None = None
    log: list[dict] = field(default_factory=list)


class Store:
    """`indexed_fields` get range columns that Parquet statistics can prune by, for a new store; see `add_index` for one
    that has data. `cells`: postings of spatial cells that box queries look up first, for a new store."""

    def __init__(self, spark: SparkSession, root: str, indexed_fields: tuple[str, ...] = (), cells: bool = False, dialect: str = "prefix", codec: str = "zstd") -> None:
        self.spark, self.root, self.indexed, self.cells, self.dialect, self.codec = spark, root.rstrip("/"), list(indexed_fields), cells, dialect, codec

    # -- versions

    def _path(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith(("file:", "/")) else f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def _publish(self, name: str, text: str) -> bool:
        """Makes a file appear, whole, unless there is one of that name; False if there is."""
        temp, fs = self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._path(name)
        if fs.getScheme() == "file":  # renaming replaces files there; a link does not
            try:
                os.link(temp.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                fs.delete(temp, False)
            return True
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, target, options)
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        p, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v=(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> Manifest:
        """That version, by default the newest."""
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(self._read(f"v={version}.json"))) if version else Manifest()

    def commit(self, change: Callable[[Manifest], None]) -> int:
        """Applies a change to the newest version and makes the result visible, again if another writer was faster."""
        while True:
            m = self.manifest()
            change(m)
            m.version += 1
            if self._publish(f"v={m.version}.json", json.dumps(m.__dict__)):
                return m.version

    def _table(self, m: Manifest, name: str) -> DataFrame:
        """A table by the schema in its manifest; no footers are read for it. Columns that old files lack are null."""
        parts, kinds = getattr(m, name), m.columns.get(name)
        if not parts or not kinds:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(kinds)) if kinds else EMPTY[name])
        return self.spark.read.schema(T.StructType.fromJson(json.loads(kinds))).parquet(*(f"{self.root}/{f}" for f in parts))

    def documents(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        docs = self._table(m, "documents")
        wanted = set(index_columns(m.indexed)) if m.indexed else set()
        return docs.drop(*(c for c in docs.columns if c.startswith("ix_") and c not in wanted))

    def chunks(self) -> DataFrame:
        return self._table(self.manifest(), "chunks")

    def chunk_meta(self) -> DataFrame:
        return self._table(self.manifest(), "chunk_meta").dropDuplicates(["meta_id"])

    def postings(self) -> DataFrame:
        """Where each word stands: word, path and its places in the document's words."""
        return self._table(self.manifest(), "postings")

    def import_log(self) -> DataFrame:
        """What each import brought."""
        schema = "correlation_id string, import_ts bigint, seconds double, chunks bigint"
        return self.spark.createDataFrame([tuple(x[k] for k in ("correlation_id", "import_ts", "seconds", "chunks")) for x in self.manifest().log], schema)

    # -- import

    def import_files(self, paths: str | list[str], glob: str | None = None, **options: object) -> int:
        """Splits and indexes files; gives the number of chunks. Options: those of ImportOptions.

        Every import makes chunks of its own: their paths begin with the layer and an id of the import."""
        o = self._options(options)
        return self._import(read_files(self.spark, paths, o, glob), o)

    def import_binary(self, files: DataFrame, mark: str | None = None, **options: object) -> int:
        """The same for rows of (path, content), as a stream of files has them. `mark`: stands in the log from the same
        moment as the chunks; files under a mark that is there already are not imported again."""
        if mark is not None and any(x.get("mark") == mark for x in self.manifest().log):
            return 0
        o = self._options(options)
        return self._import(stage(files, o), o, mark)

    def _options(self, options: dict) -> ImportOptions:
        tags, props = tuple(options.pop("tags", ())), options.pop("properties", {})
        given = {"import_ts": int(time.time() * 1000), "import_id": uuid.uuid4().hex[:12]} | options
        return ImportOptions(tags=tags, properties=tuple(dict(props).items()), **given)

    def shaped(self, staged: DataFrame, indexed: list[str] | None = None) -> DataFrame:
        """Document columns with those derived from them: words and range columns."""
        indexed = self.indexed if indexed is None else indexed
        docs = staged.select(*(f.name for f in DOCUMENT)).withColumn("tokens", token_column(all_values_column(F.col("attrs"))))
        return docs.withColumn("text_norm", norm_column(F.col("tokens"))).withColumns(index_columns(indexed) if indexed else {})

    def _write(self, df: DataFrame, folder: str) -> str:
        df.write.option("compression", self.codec).parquet(f"{self.root}/{folder}")
        return df.schema.json()

    def _near(self, docs: DataFrame) -> DataFrame:
        """Documents in files by layer and place, so that a box or a layer is in few files, not in a part of each."""
        spread = docs.withColumn("_curve", curve_column()).repartitionByRange("layer", "_curve", "path")
        return spread.sortWithinPartitions("layer", "_curve", "path").drop("_curve")

    def _import(self, staged: DataFrame, o: ImportOptions, mark: str | None = None) -> int:
        began, batch = time.time(), uuid.uuid4().hex
        folders = {t: f"{t}/{batch}" for t in (*TABLES, "staged")}
        first = self.manifest()
        indexed = self.indexed if first.indexed is None else first.indexed
        cells = self.cells if first.cells is None else first.cells
        self._write(staged, folders["staged"])  # files are parsed once
        kept = self.spark.read.schema(staged.schema).parquet(f"{self.root}/{folders['staged']}")
        kinds = {"documents": self._write(self._near(self.shaped(kept, indexed)), folders["documents"])}
        kinds["chunks"] = self._write(kept.select("path", "data").sortWithinPartitions("path"), folders["chunks"])
        kinds["chunk_meta"] = self._write(kept.select("meta_id", "meta").dropDuplicates(["meta_id"]), folders["chunk_meta"])
        written = self.spark.read.schema(T.StructType.fromJson(json.loads(kinds["documents"]))).parquet(f"{self.root}/{folders['documents']}")
        kinds["postings"] = self._write(words.postings(written, cells), folders["postings"])
        count = kept.count()
        p, fs = self._path(folders["staged"])
        fs.delete(p, True)
        entry = {"correlation_id": o.correlation_id, "import_ts": o.import_ts, "seconds": time.time() - began, "chunks": count, "mark": mark}

        def add(m: Manifest) -> None:
            if m.version and (m.indexed or []) != indexed:
                raise Conflict("the index was changed during an import")
            if mark is not None and any(x.get("mark") == mark for x in m.log):
                raise Conflict(f"{mark} was imported meanwhile")
            m.indexed, m.cells = indexed, cells
            for t in TABLES:
                getattr(m, t).append(folders[t])
                m.columns[t] = _wider(m.columns.get(t), kinds[t])
            m.log.append(entry)

        self.commit(add)
        return count

    # -- selection

    def select(self, query: object = None, layer: str | None = None, dialect: str | None = None) -> DataFrame:
        """The matching documents. Words that they must have are looked up in the postings first."""
        m = self.manifest()
        return self._matching(m, self.documents(m.version), query, layer, dialect)

    def _matching(self, m: Manifest, docs: DataFrame, query: object, layer: str | None, dialect: str | None = None) -> DataFrame:
        tree = plan(query, dialect or self.dialect, layer)
        if m.postings and (wanted := words.required(tree, bool(m.cells))):
            docs = docs.join(words.lookup(self._table(m, "postings"), wanted), "path", "left_semi")
            tree = words.without(tree, wanted)
        return docs.where(select.condition(docs, tree))

    def paths(self, query: object = None, layer: str | None = None) -> DataFrame:
        return self.select(query, layer).select("path")

    def meta(self, query: object = None, layer: str | None = None) -> DataFrame:
        return self.select(query, layer).select("path", "meta_id").join(self.chunk_meta(), "meta_id", "left").select("path", "meta_id", "meta")

    def distinct_meta(self, query: object = None, layer: str | None = None) -> DataFrame:
        return self.select(query, layer).select("meta_id").distinct().join(self.chunk_meta(), "meta_id")

    def get(self, paths: DataFrame, check: bool = True) -> DataFrame:
        """Bytes by path: late, after the selection. `check`: paths without bytes are an error."""
        wanted = paths.select("path")
        if check and (lost := wanted.join(self.chunks().select("path"), "path", "left_anti").limit(1).collect()):
            raise MissingChunk(lost[0]["path"])
        return wanted.join(self.chunks(), "path")

    def page(self, query: object = None, size: int = 100, scroll_id: str | None = None, layer: str | None = None) -> tuple[list, str | None]:
        """Rows of one page and the scroll id of the next; None when the page is empty."""
        found = select.page(self.documents(), query, size, scroll_id, dialect=self.dialect, layer=layer).select("path", "meta_id").collect()  # at most `size`
        return found, found[-1]["path"] if found else None

    def property_values(self, name: str, query: object = None, layer: str | None = None) -> DataFrame:
        return select.property_values(self.documents(), name, query, dialect=self.dialect, layer=layer)

    def attribute_values(self, name: str, query: object = None, layer: str | None = None) -> DataFrame:
        return select.attribute_values(self.documents(), name, query, dialect=self.dialect, layer=layer)

    def layers(self) -> DataFrame:
        return select.layers(self.documents())

    def layer_exists(self, name: str) -> bool:
        return select.layer_exists(self.documents(), name)

    # -- documents out

    def _ordered(self, found: DataFrame) -> Iterator[merging.Chunk]:
        """Bytes and metadata in path order, a partition at a time; never all of them in the driver."""
        rows = found.join(self.chunk_meta(), "meta_id", "left").join(self.chunks(), "path").select("path", "meta", "data").orderBy("path")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield bytes(r["data"]), r["meta"].asDict(recursive=True)

    def search(self, query: object = None, layer: str | None = None, optimistic: bool = False, extra: dict | None = None, unmerged: list | None = None, first_root: bool = False) -> Iterator[bytes]:
        """One document of all matches, piece by piece. NoMatch if there are none."""
        found = self.select(query, layer).select("path", "meta_id")
        metas = [] if optimistic or first_root else [r["meta"].asDict(recursive=True) for r in self.distinct_meta(query, layer).orderBy("meta_id").collect()]  # few: one for each kind of root
        chunks = self._ordered(found)
        body = merging.merge_xml_first_root(chunks) if first_root else merging.merge(chunks, metas, optimistic, extra, unmerged)
        empty = True
        for piece in body:
            empty = False
            yield piece
        if empty:
            raise NoMatch(str(query))

    def export(self, layer: str | None = None) -> Iterator[bytes]:
        return self.search(None, layer)

    def export_files(self, folder: str, query: object = None, layer: str | None = None) -> None:
        """The same document as text files, written by as many tasks as there is data for: one after the other, in order of
        their names, they are one document. Nothing but the distinct metadata goes through the driver."""
        metas = [r["meta"].asDict(recursive=True) for r in self.distinct_meta(query, layer).orderBy("meta_id").collect()]
        if not metas:
            raise NoMatch(str(query))
        head, tail, before = merging.frame(metas)
        found = self.select(query, layer).select("path", "meta_id")
        first = found.agg(F.min("path")).first()[0]
        bare = self.chunk_meta().select("meta_id", F.col("meta.geojson_type").alias("kind"))
        rows = found.join(bare, "meta_id").join(self.chunks(), "path")
        text = F.decode("data", "UTF-8")
        if merging.is_geojson(metas[0]):
            wrapped = F.concat(F.lit('{"type":"Feature","geometry":'), text, F.lit("}"))
            text = F.when(F.col("kind").eqNullSafe("Feature") | F.lit("geometries" in head), text).otherwise(wrapped)
        lines = rows.select(F.lit(1).alias("k"), "path", F.concat(F.when(F.col("path") == first, F.lit("")).otherwise(F.lit(before)), text).alias("value"))
        ends = self.spark.createDataFrame([(0, "", head), (2, "", tail)], "k int, path string, value string")
        lines.union(ends).repartitionByRange("k", "path").sortWithinPartitions("k", "path").select("value").write.text(folder)

    # -- changes

    def _files(self, parts: list[str]) -> list[str]:
        """The data files of these files and folders, below the root."""
        out = []
        for part in parts:
            p, fs = self._path(part)
            if fs.getFileStatus(p).isDirectory():
                out += [f"{part}/{s.getPath().getName()}" for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]
            else:
                out.append(part)
        return out

    def _replace(self, table: str, part: list[str], change: Callable[[DataFrame], DataFrame], base: Manifest, **also: object) -> int:
        """Writes what `change` makes of some of a table's files, and puts that in their place."""
        old = self._table(base, table) if not part else self.spark.read.schema(self._table(base, table).schema).parquet(*(f"{self.root}/{f}" for f in part))
        folder = f"{table}/{uuid.uuid4().hex}"
        kind = self._write(change(old), folder)
        files = set(part or self._files(getattr(base, table)))

        def put(m: Manifest) -> None:
            now = self._files(getattr(m, table))
            if not files <= set(now):
                raise Conflict(f"{table} were changed meanwhile")
            setattr(m, table, [*(f for f in now if f not in files), folder])
            m.columns[table] = _wider(m.columns.get(table), kind)
            for k, v in also.items():
                setattr(m, k, v)

        return self.commit(put)

    def _rewrite(self, change: Callable[..., DataFrame], query: object, layer: str | None) -> int:
        """Applies a change to the files that hold a match, and to no others; their names are all that the driver sees."""
        while True:
            base = self.manifest()
            if not base.documents:
                return base.version
            docs = self.documents(base.version)
            named = docs.select("*", F.col("_metadata.file_name").alias("_file"))
            names = {r["_file"] for r in self._matching(base, named, query, layer).select("_file").distinct().collect()}
            part = [f for f in self._files(base.documents) if f.rsplit("/", 1)[-1] in names]
            if not part:
                return base.version
            try:
                return self._replace("documents", part, lambda docs: self._reshaped(change(docs, query, self.dialect, layer), base.indexed or []), base)
            except Conflict:
                continue

    def _reshaped(self, docs: DataFrame, indexed: list[str]) -> DataFrame:
        return docs.drop(*(c for c in docs.columns if c.startswith("ix_"))).withColumns(index_columns(indexed)) if indexed else docs

    def add_tags(self, tags: list[str], query: object = None, layer: str | None = None) -> int:
        return self._rewrite(lambda docs, *a: mutate.add_tags(docs, tags, *a), query, layer)

    def remove_tags(self, tags: list[str], query: object = None, layer: str | None = None) -> int:
        return self._rewrite(lambda docs, *a: mutate.remove_tags(docs, tags, *a), query, layer)

    def set_properties(self, props: dict, query: object = None, layer: str | None = None) -> int:
        return self._rewrite(lambda docs, *a: mutate.set_properties(docs, props, *a), query, layer)

    def remove_properties(self, keys: list[str], query: object = None, layer: str | None = None) -> int:
        return self._rewrite(lambda docs, *a: mutate.remove_properties(docs, keys, *a), query, layer)

    def delete(self, query: object = None, layer: str | None = None) -> int:
        """Gives how many documents went. Their bytes and postings stay until `vacuum`."""
        before = self.documents().count()
        self._rewrite(mutate.delete, query, layer)
        return before - self.documents().count()

    def add_index(self, fields: list[str]) -> int:
        """Range columns for more fields, over the documents that are there and those that come."""
        base = self.manifest()
        every = sorted({*(base.indexed or []), *fields})
        if not base.documents:
            self.indexed = every
            return self.commit(lambda m: setattr(m, "indexed", every))
        return self._replace("documents", [], lambda docs: self._near(self._reshaped(docs, every)), base, indexed=every)

    def drop_index(self, fields: list[str]) -> int:
        """Queries stop using the range columns; files that are rewritten lose them."""
        return self.commit(lambda m: setattr(m, "indexed", [x for x in m.indexed or [] if x not in fields]))

    def compact(self) -> int:
        """The documents of many imports in few files, in order of layer and place."""
        return self._replace("documents", [], self._near, self.manifest())

    def vacuum(self) -> None:
        """Rewrites the bytes and postings that are still referred to, and drops files that the current version doesn't name."""
        for t in ("chunks", "postings"):
            m = self.manifest()
            if getattr(m, t):
                alive = self.documents(m.version).select("path")
                self._replace(t, [], lambda rows, alive=alive, t=t: words.ordered(rows.join(alive, "path", "left_semi")) if t == "postings" else rows.join(alive, "path", "left_semi"), m)
        m = self.manifest()
        for t in TABLES:
            named = {f for part in getattr(m, t) for f in (part, part.split("/")[0] + "/" + part.split("/")[1])}
            p, fs = self._path(t)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                folder = f"{t}/{s.getPath().getName()}"
                if folder not in named:
                    fs.delete(s.getPath(), True)
                elif folder not in getattr(m, t):
                    for f in fs.listStatus(s.getPath()):
                        if f"{folder}/{f.getPath().getName()}" not in getattr(m, t) and f.getPath().getName().endswith(".parquet"):
                            fs.delete(f.getPath(), False)

    def layer_of(self, name: str) -> str:
        return normalize_layer(name)
