"""Pages of binary documents as a Spark data source: only the pages asked for are opened, and no row set holds a document."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, doc_id string, page int, content binary"


class PageReader(Protocol):
    """What reads a format. ``file`` can be read from any place, so a reader needs to take only what a page is made of."""

    def count(self, file: BinaryIO) -> int: ...

    def page(self, file: BinaryIO, number: int) -> bytes:
        """The page of that number, from 1."""


@dataclass
class Pages(InputPartition):
    """Whole files or, of one large file, pages ``first`` to ``last`` (both included; ``last`` None: to the end)."""

    paths: list[str]
    first: int
    last: int | None


def opened(path: str):
    """A file system of any kind that Arrow knows (local, s3, gs, hdfs), and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, pages: PageReader, options: dict[str, str]):
        self.pages, self.path, self.pattern = pages, options["path"], options.get("pattern", "*")
        self.split, self.step = int(options.get("splitbytes", 64 << 20)), int(options.get("pagespertask", 256))
        self.first, self.last = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ``page`` are taken over; what else there is stays with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(x for x in (self.last, f.value - isinstance(f, LessThan)) if x is not None)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Small files together up to ``splitBytes``; of a larger file ranges of ``pagesPerTask`` pages, for which its pages are counted."""
        from pyarrow import fs

        store, root = opened(self.path)
        infos = [store.get_file_info(root)]
        if infos[0].type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern))
        scheme = self.path.rstrip("/").removesuffix(root.rstrip("/"))  # and the host, where the store's own paths lack it
        out, own, held = [], [], 0
        for path, size in files:
            if size > self.split:
                last = self.last
                if last is None:
                    with store.open_input_file(path) as file:
                        last = self.pages.count(file)
                out += [Pages([scheme + path], a, min(a + self.step - 1, last)) for a in range(self.first, last + 1, self.step)]
                continue
            if own and held + size > self.split:
                out.append(Pages(own, self.first, self.last))
                own, held = [], 0
            own, held = [*own, scheme + path], held + size
        return out + ([Pages(own, self.first, self.last)] if own else []) or [Pages([], 1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for path in partition.paths:
            store, own = opened(path)
            name = own.rsplit("/", 1)[-1]
            doc_id = name.rsplit(".", 1)[0] or name
            with store.open_input_file(own) as file:
                last = self.pages.count(file)
                for number in range(partition.first, min(last, partition.last if partition.last is not None else last) + 1):
                    yield path, doc_id, number, self.pages.page(file, number)


def page_source(pages: PageReader, name: str = "document_pages") -> type[DataSource]:
    """A data source over ``pages``, to be registered with ``spark.dataSource.register``. Options: path, pattern, splitBytes, pagesPerTask."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(pages, {k.lower(): v for k, v in self.options.items()})

    return Source


def read_pages(spark: SparkSession, path: str, pages: PageReader, first: int | None = None, last: int | None = None, name: str = "document_pages", **options: str | int) -> DataFrame:
    """One row per page of the documents under ``path``: path, doc_id, page, content.

    Pages ``first`` to ``last``, counted from 1, both included; ``last`` counts only with ``first``. They are filters on ``page``, and these, as any
    that a query puts on it, are handed down to the readers: other pages are not opened.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(pages, name))
    rows = spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load(path)
    if first is not None:
        rows = rows.where(F.col("page") >= first) if last is None else rows.where(F.col("page").between(first, last))
    return rows
