"""Settings of a store and of imports, from a JSON file, with the command line's own values above them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from tesserae.store import Store


@dataclass(frozen=True)
class Settings:
    """`store`: the folder of a store, on any Hadoop file system. `indexed_fields` and `cells` hold for a new store."""

    store: str = ""
    dialect: str = "prefix"
    indexed_fields: tuple[str, ...] = ()
    cells: bool = False
    codec: str = "zstd"
    fallback_crs: str | None = None
    strict: bool = False
    flatten: bool = False
    splitter: str = "geojson"
    strict_pairs: bool = False
    page_size: int = 100

    @classmethod
    def read(cls, path: str | None = None, **own: object) -> Settings:
        """The file's settings, if there is one, and over them those of `own` that are not None. Unknown names are errors."""
        given: dict = {}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        given |= {k: v for k, v in own.items() if v is not None}
        known = {f.name for f in fields(cls)}
        if wrong := sorted(set(given) - known):
            raise ValueError(f"no such setting: {', '.join(wrong)}")
        if given.get("dialect", "prefix") not in ("prefix", "infix"):
            raise ValueError(f"no such dialect: {given['dialect']}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def open(self, spark: SparkSession) -> Store:
        if not self.store:
            raise ValueError("the setting `store` is missing")
        return Store(spark, self.store, self.indexed_fields, self.cells, self.dialect, self.codec)

    def import_options(self) -> dict:
        """What an import takes from the settings."""
        return {k: getattr(self, k) for k in ("fallback_crs", "strict", "flatten", "splitter", "strict_pairs")}
