"""Points at which others can add to the engine: splitters, indexers of chunks and metadata, query compilers, mergers.

What is registered in the driver goes along with the tasks that need it; nothing has to be installed on executors.

splitter(pieces)            bytes of a file, piece by piece -> chunks with `data`, `value` and `parent_name`
indexer(value)              a chunk's parsed value -> {attribute: value}
meta indexer(meta)          a chunk's metadata -> {property: value}
compiler(term, dialect)     a term of the surface language -> a predicate, or None if it is not its own
merger(chunks, metas)       (bytes, metadata) pairs -> the pieces of one document
"""

from __future__ import annotations

from collections.abc import Callable

from tesserae.operators import merge
from tesserae.plans import lower
from tesserae.sources import files


def add_splitter(name: str, split: Callable, mime: str = "application/json") -> None:
    """Files of that type can be split so, by `splitter=name` at import."""
    files.SPLITTERS[name] = split
    files.SPLITTER_TYPES[name] = mime


def add_indexer(index: Callable[[object], dict]) -> None:
    """Every chunk of later imports gets these attributes too, behind its own."""
    files.INDEXERS.append(index)


def add_meta_indexer(index: Callable[[dict], dict]) -> None:
    """Every chunk of later imports gets these properties too."""
    files.META_INDEXERS.append(index)


def add_compiler(compile_term: Callable[[object, str], object]) -> None:
    """Terms are offered to it before the engine reads them."""
    lower.COMPILERS.append(compile_term)


def add_merger(accepts: Callable[[dict], bool], merge_chunks: Callable) -> None:
    """Documents all of whose chunks it accepts, by their metadata, are merged by it."""
    merge.MERGERS.append((accepts, merge_chunks))


def clear() -> None:
    """Forgets all that was added."""
    for name in [*files.SPLITTER_TYPES]:
        files.SPLITTERS.pop(name), files.SPLITTER_TYPES.pop(name)
    for found in (files.INDEXERS, files.META_INDEXERS, lower.COMPILERS, merge.MERGERS):
        found.clear()
