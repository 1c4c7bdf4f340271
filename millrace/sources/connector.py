"""A connector as a Python data source: `spark.read.format("millrace").option("crawler", "package.module:Class")`.

A crawler class has `scan()`, the names of its parts, and `update(part)`, which yields dicts of a document's fields;
each part is read by a task of its own.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, title string, body string, type string, last_modified long, acl_allow array<string>, acl_denied array<string>"
_FIELDS = ("url", "title", "body", "type", "last_modified", "acl_allow", "acl_denied")


class Part(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _crawler(self):
        module, _, name = self.options["crawler"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self._crawler().scan()]

    def read(self, partition: Part) -> Iterator[tuple]:
        for d in self._crawler().update(partition.value):
            if d.get("url") and d.get("title"):
                yield tuple(d.get(k) if k not in ("acl_allow", "acl_denied") else list(d.get(k) or (["Everyone"] if k == "acl_allow" else [])) for k in _FIELDS)


class Connector(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class Numbers:
    """A crawler for trials: `parts` parts of `size` documents."""

    def __init__(self, options: dict[str, str]):
        self.parts, self.size = int(options.get("parts", 2)), int(options.get("size", 3))

    def scan(self) -> list[str]:
        return [str(k) for k in range(self.parts)]

    def update(self, part: str) -> Iterator[dict]:
        for k in range(self.size):
            yield {"url": f"http://www.example.com/{part}/{k}", "title": f"{part}.{k}", "body": f"number {k}", "type": "txt", "last_modified": k}
