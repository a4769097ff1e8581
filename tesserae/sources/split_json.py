"""JSON and GeoJSON files into chunks: exact source bytes, with the array that they were found in."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()
#: Arrays of a GeoJSON collection whose members are chunks.
COLLECTIONS = ("features", "geometries")


@dataclass(frozen=True)
class JsonChunk:
    data: bytes
    value: object
    parent_name: str | None


class JsonSyntaxError(ValueError):
    """A file that is not JSON."""


PIECE = 1 << 20


def pieces_of(data: bytes | Iterable[bytes]) -> Iterator[bytes]:
    if isinstance(data, (bytes, bytearray, memoryview)):
        yield from (bytes(data[a : a + PIECE]) for a in range(0, len(data), PIECE))
    else:
        yield from data


class Window:
    """The part of a file's text that is looked at: it is read as far as it is needed, and what is done with is dropped.

    Places are counted from the beginning of the file."""

    def __init__(self, data: bytes | Iterable[bytes]) -> None:
        self.pieces, self.decode = pieces_of(data), codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.base, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads as much again as there is; False at the end of the file."""
        found, size = [], 0
        while not self.ended and size < max(PIECE, len(self.text)):
            piece = next(self.pieces, None)
            self.ended = piece is None
            found.append(self.decode.decode(piece or b"", self.ended))
            size += len(found[-1])
        self.text += "".join(found)
        return size > 0

    def drop(self, before: int) -> None:
        if before - self.base > 4 * PIECE:
            self.text, self.base = self.text[before - self.base :], before

    def skip(self, at: int) -> int:
        """The next place that is not blank."""
        while (end := _SPACE.match(self.text, at - self.base).end()) == len(self.text) and self.more():
            pass
        return end + self.base

    def mark(self, at: int) -> str:
        """The character at a place; empty at the end."""
        while at - self.base >= len(self.text) and self.more():
            pass
        return self.text[at - self.base : at - self.base + 1]

    def value(self, at: int) -> tuple[object, int]:
        """The value that begins at a place, and where it ends."""
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, at - self.base)
                if end < len(self.text) or not self.more():  # else a number might go on
                    return found, end + self.base
            except ValueError as e:
                if not self.more():
                    raise JsonSyntaxError(str(e)) from e

    def between(self, a: int, b: int) -> bytes:
        return self.text[a - self.base : b - self.base].encode()


def _items(w: Window, at: int) -> Iterator[int]:
    """Where the elements of the array at `at` begin; the caller sends back where each ended. Ends past the bracket."""
    at = w.skip(at + 1)
    if w.mark(at) == "]":
        yield -(at + 1)
        return
    while True:
        at = yield at
        at = w.skip(at)
        mark = w.mark(at)
        if mark == "]":
            yield -(at + 1)
            return
        if mark != ",":
            raise JsonSyntaxError(f"expected a comma at {at}")
        at = w.skip(at + 1)


def _members(w: Window, at: int) -> Iterator[tuple[str, int]]:
    """Names and value positions of the object at `at`, in the manner of _items."""
    at = w.skip(at + 1)
    if w.mark(at) == "}":
        yield "", -(at + 1)
        return
    while True:
        name, at = w.value(at)
        at = w.skip(at)
        if not isinstance(name, str) or w.mark(at) != ":":
            raise JsonSyntaxError(f"expected a member at {at}")
        at = yield name, w.skip(at + 1)
        at = w.skip(at)
        mark = w.mark(at)
        if mark == "}":
            yield "", -(at + 1)
            return
        if mark != ",":
            raise JsonSyntaxError(f"expected a comma at {at}")
        at = w.skip(at + 1)


def _ended(w: Window, at: int) -> None:
    if w.mark(end := w.skip(at)):
        raise JsonSyntaxError(f"more text at {end}")


def _whole(w: Window) -> Iterator[JsonChunk]:
    at = w.skip(0)
    value, end = w.value(at)
    _ended(w, end)
    yield JsonChunk(w.between(at, end), value, None)


def split_geojson(data: bytes | Iterable[bytes]) -> Iterator[JsonChunk]:
    """Members of `features` or `geometries`; a file without either is one chunk. Other arrays hold no chunks, and an
    empty collection has none. Of a collection, no more than a member and a window is in memory."""
    w = Window(data)
    at = w.skip(0)
    if w.mark(at) != "{":
        yield from _whole(w)
        return
    found, members = False, _members(w, at)
    name, pos = next(members)
    while pos >= 0:
        if name in COLLECTIONS and w.mark(pos) == "[":
            found, items = True, _items(w, pos)
            a = next(items)
            while a >= 0:
                value, end = w.value(a)
                if isinstance(value, dict):
                    yield JsonChunk(w.between(a, end), value, name)
                w.drop(end)
                a = items.send(end)
            end = -a
        else:
            _, end = w.value(pos)
        name, pos = members.send(end)
    _ended(w, -pos)
    if not found:
        yield from _whole(w)


def split_json(data: bytes | Iterable[bytes]) -> Iterator[JsonChunk]:
    """The outermost objects inside any array, with the array's name; a file without any is one chunk."""
    w = Window(data)
    found = False

    def walk(pos: int, name: str | None, in_array: bool) -> Iterator[JsonChunk]:
        nonlocal found, last
        mark = w.mark(pos)
        if mark == "{" and in_array:
            value, last = w.value(pos)
            found = True
            yield JsonChunk(w.between(pos, last), value, name)
            w.drop(last)
        elif mark == "{":
            members = _members(w, pos)
            key, a = next(members)
            while a >= 0:
                yield from walk(a, key, False)
                key, a = members.send(last)
            last = -a
        elif mark == "[":
            items = _items(w, pos)
            a = next(items)
            while a >= 0:
                yield from walk(a, name, True)
                a = items.send(last)
            last = -a
        else:
            _, last = w.value(pos)

    last = 0
    yield from walk(w.skip(0), None, False)
    _ended(w, last)
    if not found:
        yield from _whole(w)
