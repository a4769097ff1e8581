"""XML files into chunks, one for each child of the root, with exact source bytes; and what is indexed of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from tesserae.functions.crs import UnknownCRS, to_wgs84
from tesserae.model import guess, tagged
from tesserae.sources.extract_json import Box, bounds
from tesserae.sources.split_json import pieces_of

#: Namespaces and element names of the formats that are read.
GML = ("http://www.opengis.net/gml", "http://www.opengis.net/gml/3.2")
XAL = "urn:oasis:names:tc:ciq:xsdschema:xAL:2.0"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
ATTRIBUTE_KINDS = {"stringAttribute", "intAttribute", "doubleAttribute", "dateAttribute", "uriAttribute", "measureAttribute"}
ADDRESS_PARTS = {"CountryName": "Country", "LocalityName": "Locality", "ThoroughfareName": "Street", "ThoroughfareNumber": "Number"}
COORDINATES = {"lowerCorner", "upperCorner", "pos", "posList"}


class CoordinateError(ValueError):
    """Coordinates whose count or reference system makes no sense."""


@dataclass
class Root:
    """An element above the chunks."""

    prefix: str | None
    name: str
    namespaces: list[tuple[str | None, str]]
    attributes: list[tuple[str | None, str, str]]

    def row(self) -> dict:
        return {
            "prefix": self.prefix,
            "name": self.name,
            "namespaces": [{"prefix": p, "uri": u} for p, u in self.namespaces],
            "attributes": [{"prefix": p, "name": n, "value": v} for p, n, v in self.attributes],
        }


@dataclass
class XmlChunk:
    data: bytes
    root: Root
    attrs: list[dict] = field(default_factory=list)
    gml_ids: list[str] = field(default_factory=list)
    address: dict[str, str] = field(default_factory=dict)
    box: Box | None = None


def cut(name: str) -> tuple[str | None, str]:
    prefix, colon, local = name.rpartition(":")
    return (prefix if colon else None), local


def start_of(name: str, attributes: list[str]) -> Root:
    prefix, local = cut(name)
    namespaces, own = [], []
    for k, v in zip(attributes[::2], attributes[1::2], strict=True):
        p, n = cut(k)
        if k == "xmlns" or p == "xmlns":
            namespaces.append((n if p else None, v))
        else:
            own.append((p, n, v))
    return Root(prefix, local, namespaces, own)


class Extractor:
    """Follows the elements of one chunk and gathers what is indexed of it."""

    def __init__(self, strict: bool, fallback_crs: str | None, scopes: list[tuple[str | None, int | None]], skip: frozenset[str], first_text: bool) -> None:
        self.strict, self.fallback, self.skip, self.first_text = strict, fallback_crs, skip, first_text
        self.scopes = list(scopes)  # reference system and dimension of the elements above
        self.names: list[str] = []
        self.attrs: dict[str, dict] | list[dict] = [] if first_text else {}
        self.ids: list[str] = []
        self.address: dict[str, str] = {}
        self.points: list[tuple[float, float]] = []
        self.attribute: str | None = None
        self.text: list[str] | None = None
        self.hidden = 0
        self.failed: Exception | None = None

    def start(self, e: Root, uris: dict[str | None, str]) -> None:
        self.names.append(e.name)
        srs, dim = self.scopes[-1] if self.scopes else (None, None)
        own = {(p, n): v for p, n, v in e.attributes}
        srs = own.get((None, "srsName"), srs)
        if (d := own.get((None, "srsDimension"))) is not None and d.strip().isdigit():
            dim = int(d)
            if self.strict and dim < 2:
                self.failed = CoordinateError(f"srsDimension {dim}")
        self.scopes.append((srs, dim))
        if e.name == "Envelope" and len(self.scopes) > 2:  # its system holds for the bounded feature
            self.scopes[-3] = (srs, dim or self.scopes[-3][1])
        if self.hidden or e.name in self.skip:
            self.hidden += 1
            return
        for (p, n), v in own.items():
            if n == "id" and uris.get(p) in GML and p and v not in self.ids:
                self.ids.append(v)
        if e.name in ATTRIBUTE_KINDS:
            named = own.get((None, "name"))
            self.attribute = next((v for (_, n), v in own.items() if n == "name"), None) if named is None and self.first_text else named
        uri = uris.get(e.prefix)
        if e.name == "value" and self.attribute is not None or e.name in COORDINATES or e.name in ADDRESS_PARTS and uri == XAL:
            self.text = []

    def characters(self, s: str) -> None:
        if self.text is not None and not self.hidden:
            self.text.append(s)

    def end(self, prefix_uri: str | None) -> None:
        name = self.names.pop()
        srs, dim = self.scopes.pop()
        if self.hidden:
            self.hidden -= 1
            return
        if self.text is not None:
            text, self.text = "".join(self.text), None
            if name == "value" and self.attribute is not None:
                t = tagged(self.attribute, guess(text.strip()))
                if isinstance(self.attrs, list):
                    self.attrs.append(t)
                else:
                    self.attrs.setdefault(self.attribute, t)
                if self.first_text:
                    self.attribute = None
            elif name in ADDRESS_PARTS and prefix_uri == XAL:
                self.address[ADDRESS_PARTS[name]] = text.strip()
            elif name in COORDINATES:
                self.place(text, srs or self.fallback, dim)
        if name in ATTRIBUTE_KINDS:
            self.attribute = None

    def place(self, text: str, srs: str | None, dim: int | None) -> None:
        try:
            n = [float(x) for x in text.split()]
            size = dim or (3 if len(n) % 3 == 0 else 2 if len(n) % 2 == 0 else 0)
            if not size or size < 2 or len(n) % size:
                raise CoordinateError(f"{len(n)} numbers in {size or 'no'} dimensions")
            if srs is None:
                raise CoordinateError("no reference system")
            pairs = [(n[i], n[i + 1]) for i in range(0, len(n), size)]
            if self.strict and (b := bounds(pairs)):  # the corners alone are projected
                pairs = [(b[0], b[1]), (b[2], b[3])]
            self.points += to_wgs84(srs, pairs)
        except (CoordinateError, UnknownCRS, ValueError) as e:
            if self.strict:
                self.failed = e

    def result(self, data: bytes, root: Root) -> XmlChunk:
        if self.failed:
            raise self.failed
        attrs = self.attrs if isinstance(self.attrs, list) else list(self.attrs.values())
        return XmlChunk(data, root, attrs, self.ids, self.address, bounds(self.points))


def split(
    data: bytes | Iterable[bytes],
    self_closing: bool = True,
    skip: frozenset[str] = frozenset(),
    strict: bool = False,
    fallback_crs: str | None = None,
    first_text: bool = False,
) -> Iterator[XmlChunk]:
    """Chunks of a file. Without `self_closing`, empty-element tags below the root are none; elements named in `skip` give
    no data; `strict`: bad coordinates are errors; `first_text`: all of equal attribute keys are kept.

    The first reference system that a file names holds for chunks that have none, else `fallback_crs`. No more of a file
    than a chunk and a window is in memory."""
    window, base = bytearray(), 0
    found: list[XmlChunk] = []
    depth, begin, bare = 0, 0, False  # bare: nothing has come since a start tag
    root: Root | None = None
    uris: list[dict[str | None, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
    elements: list[str | None] = []
    own: Extractor | None = None
    seen_crs, above = fallback_crs, (None, None)
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True

    def start(name: str, attributes: list[str]) -> None:
        nonlocal depth, begin, root, own, seen_crs, above, bare
        bare = True
        e = start_of(name, attributes)
        uris.append(uris[-1] | dict(e.namespaces) if e.namespaces else uris[-1])
        elements.append(uris[-1].get(e.prefix))
        if seen_crs is None:
            seen_crs = next((v for p, n, v in e.attributes if p is None and n == "srsName"), None)
        if depth == 0:
            root = e
            a = {n: v for p, n, v in e.attributes if p is None}
            above = (a.get("srsName"), None)
        else:
            if depth == 1:
                begin = parser.CurrentByteIndex
                own = Extractor(strict, seen_crs, [above], skip, first_text)
            own.fallback = own.fallback or seen_crs
            own.start(e, uris[-1])
        depth += 1

    def text(s: str) -> None:
        nonlocal bare
        bare = False
        if own is not None:
            own.characters(s)

    def end(name: str) -> None:
        nonlocal depth, own, bare
        depth -= 1
        uri = elements.pop()
        if own is not None:
            own.end(uri)
        uris.pop()
        if depth == 1:
            at = parser.CurrentByteIndex  # of the closing tag, or behind an empty-element tag, whatever comes next
            closing = not (bare and window[at - base - 2 : at - base] == b"/>")
            if closing or self_closing:
                stop = window.index(b">", at - base) + 1 if closing else at - base
                found.append(own.result(bytes(window[begin - base : stop]), root))
            own = None
        bare = False

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = text
    for n, piece in enumerate(pieces_of(data)):
        if not n:
            piece = piece.removeprefix(b"\xef\xbb\xbf")
        for a in range(0, len(piece), 1 << 16):
            window += piece[a : a + (1 << 16)]
            parser.Parse(piece[a : a + (1 << 16)], False)
            yield from found
            found.clear()
            done = (begin if own is not None else max(base, base + len(window) - (1 << 16))) - base
            if done > 1 << 16:
                del window[:done]
                base += done
    parser.Parse(b"", True)
    yield from found
