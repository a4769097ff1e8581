"""Byte-level BPE: a queue of merge ranks over a doubly linked list of symbols; decoding joins vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserae.llm.shared import table, tidy, unused

CACHE = 200_000  # words in each of the two generations that are kept (50 MB)
#: Fixed value: the published pattern that cuts a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Tokenizer:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file, given by path or as its bytes."""

    def __init__(self, file: str | bytes) -> None:
        if isinstance(file, str):
            with open(file, "rb") as f:
                file = f.read()
        spec = json.loads(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.strings[i] = bytes(of_letter[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.numbers = list(range(size))
        self.decimal = [str(i) for i in self.numbers]
        self.single = [self.numbers[vocab[letters[b]]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, self.numbers[vocab[a + b]])
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The lowest rank first, the leftmost of equals; entries whose symbols have changed since are skipped."""
        ids: list[int] = [self.single[b] for b in word]
        n, ranks = len(ids), self.ranks
        if n == 1:
            return tuple(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return tuple(x for x in ids if x >= 0)

    def word(self, w: str) -> tuple[int, ...]:
        if (found := self.old.get(w)) is None:
            found = self.merge(w.encode())
        if len(w) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[w] = found
        return found

    def ids(self, text: str) -> list[int]:
        """Token ids. Strings of special tokens are those tokens, as in the library."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                words = self.pattern.findall(part)
                for at in range(0, len(words), 4096):
                    some = words[at : at + 4096]
                    young = self.young
                    found = list(map(young.get, some))
                    if None in found:
                        found = [self.word(w) if f is None else f for f, w in zip(found, some, strict=True)]
                    out.extend(chain.from_iterable(found))
        return out

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def vocabulary(spark, path: str) -> object:  # noqa: ANN001
    """The file's bytes as a broadcast, for executors that have no such path. Its size is the vocabulary's."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _local(path: str, data: object) -> Tokenizer:
    if path not in _LOADED:
        if os.path.exists(path):
            return tokenizer(path)
        _LOADED[path] = Tokenizer(data.value)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with ids (array of int). Null or empty text: no tokens. One row in, one row out.

    Ties and repeated rows: each for itself, though a text is encoded once where it stands in neighbouring rows. Very long
    texts: whole, word by word. Empty tables: empty results. Columns of the table stay as they are; a new one whose name
    is taken has underscores behind it."""
    return _run(docs, path, keep, "ids array<int>", lambda t, ids: (ids,), [pa.list_(pa.int32())])


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest of op4: counts and checksums of the ids and of the text decoded from them. Odd rows as in `encode`.

    It is made here and now, and written, so that texts come in batches of bounded size whoever reads the result."""

    def digest(t: Tokenizer, ids: list[int]) -> tuple:
        joined = ",".join(map(t.decimal.__getitem__, ids))
        back = t.text(ids)
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return table(_run(docs, path, ["doc_id"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()]), "tokens")


def _run(docs: DataFrame, path: str | None, keep: list[str] | None, ddl: str, make, kinds: list[pa.DataType]) -> DataFrame:  # noqa: ANN001
    from pyspark.sql import types as T

    path = path or default_path()
    kept = list(keep or docs.columns)
    data = vocabulary(docs.sparkSession, path)
    new = T.StructType([T.StructField(unused(docs.select(*(f"`{c}`" for c in kept)), f.name), f.dataType) for f in T.StructType.fromDDL(ddl)])
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _local(path, data)
        text, found = "", make(t, [])
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for x in part.column("text"):
                    if (own := x.as_py() or "") != text:
                        text, found = own, make(t, t.ids(own))
                    rows.append(found)
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *new.names])

    return docs.select(*(f"`{c}`" for c in kept), *([] if "text" in kept else ["text"])).mapInArrow(tidy(run), schema)
