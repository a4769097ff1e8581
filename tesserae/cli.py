"""Command line: import, search, export, delete, tag, property, collections, index, log, compact, vacuum."""

from __future__ import annotations

import argparse
import sys

from tesserae.config import Settings
from tesserae.plans.labels import parse_properties, parse_tags
from tesserae.session import builder
from tesserae.store import NoMatch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("--store", help="folder of the store, on any Hadoop file system")
    p.add_argument("--config", help="a JSON file of settings")
    p.add_argument("--dialect", choices=("prefix", "infix"))
    sub = p.add_subparsers(dest="command", required=True)
    imp = sub.add_parser("import", help="files, folders or globs")
    imp.add_argument("paths", nargs="+")
    imp.add_argument("--layer", default="")
    imp.add_argument("--tags", default="")
    imp.add_argument("--properties", default="")
    imp.add_argument("--fallback-crs")
    imp.add_argument("--splitter")
    for name in ("search", "delete", "export", "collections"):
        q = sub.add_parser(name)
        q.add_argument("--layer")
        if name in ("search", "delete"):
            q.add_argument("query", nargs="?")
        if name == "search":
            q.add_argument("--optimistic", action="store_true")
        if name == "export":
            q.add_argument("--folder", help="write it there, as files that are one document together")
    for name, actions in (("tag", ("add", "rm")), ("property", ("get", "set", "rm")), ("index", ("add", "rm"))):
        q = sub.add_parser(name)
        q.add_argument("action", choices=actions)
        q.add_argument("values")
        if name != "index":
            q.add_argument("--query")
            q.add_argument("--layer")
    for name in ("log", "compact", "vacuum"):
        sub.add_parser(name)
    return p


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    settings = Settings.read(o.config, store=o.store, dialect=o.dialect, fallback_crs=getattr(o, "fallback_crs", None), splitter=getattr(o, "splitter", None))
    store = settings.open(builder("tesserae").getOrCreate())
    out = sys.stdout
    try:
        if o.command == "import":
            tags, props = parse_tags(o.tags) if o.tags else [], parse_properties(o.properties) if o.properties else {}
            print(store.import_files(o.paths, layer=o.layer, tags=tags, properties=props, **settings.import_options()), file=out)
        elif o.command == "export" and o.folder:
            store.export_files(o.folder, layer=o.layer)
        elif o.command in ("search", "export"):
            body = store.search(o.query, o.layer, o.optimistic) if o.command == "search" else store.export(o.layer)
            for piece in body:
                out.buffer.write(piece) if hasattr(out, "buffer") else out.write(piece.decode())
        elif o.command == "delete":
            print(store.delete(o.query, o.layer), file=out)
        elif o.command == "collections":
            for r in store.layers().orderBy("layer").toLocalIterator():
                print(r["layer"], file=out)
        elif o.command == "log":
            for r in store.import_log().collect():
                print(r["correlation_id"] or "-", r["chunks"], f"{r['seconds']:.1f}", file=out)
        elif o.command in ("compact", "vacuum"):
            getattr(store, o.command)()
        elif o.command == "index":
            (store.add_index if o.action == "add" else store.drop_index)(parse_tags(o.values))
        elif o.command == "tag":
            (store.add_tags if o.action == "add" else store.remove_tags)(parse_tags(o.values), o.query, o.layer)
        elif o.action == "get":
            for r in store.property_values(o.values, o.query, o.layer).orderBy("value").toLocalIterator():
                print(r["value"], file=out)
        elif o.action == "set":
            store.set_properties(parse_properties(o.values), o.query, o.layer)
        else:
            store.remove_properties(parse_tags(o.values), o.query, o.layer)
    except NoMatch:
        print("no match", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
