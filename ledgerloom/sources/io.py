"""Readers and writers. Tables live as Parquet; other formats come in and go out at the edges."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, doc_id (base name), length of the files under ``path``, sorted by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", basename(F.col("path")).alias("doc_id"), "length").orderBy("path")


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt", encoding: str = "ISO-8859-1") -> DataFrame:
    """doc_id, text of whole files in a one-byte encoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(basename(F.col("path")).alias("doc_id"), F.decode("content", encoding).alias("text"))


def decrypted(files: DataFrame, is_encrypted: Callable[[bytes], bool], decrypt: Callable[[bytes], bytes]) -> DataFrame:
    """Binary documents in the clear: what is not encrypted stays as it is. ``was_encrypted`` tells which were; the source is left alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            locked = [bool(is_encrypted(c)) for c in batch["content"]]
            yield batch.assign(content=[decrypt(c) if k else c for c, k in zip(batch["content"], locked, strict=True)], was_encrypted=locked)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{own}, was_encrypted boolean")


def read_documents(spark: SparkSession, path: str, pages: Callable[[bytes], Iterator[bytes | str]], pattern: str = "*.pdf", first: int | None = None, last: int | None = None, schema: str = "doc_id string, page int, content binary") -> DataFrame:
    """One row per page of binary documents, by a reader for the format (decryption included).

    Pages ``first`` to ``last``, both counted from 1 and included; ``last`` counts only with ``first``. The reader gets a document as a
    whole and is stopped after ``last``; ``pages.read_pages`` opens only what is asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(basename(F.col("path")).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                for i, page in enumerate(pages(content), 1):
                    if first is not None and last is not None and i > last:
                        break
                    if first is None or i >= first:  # page by page: a frame never holds a document
                        yield pd.DataFrame([(doc_id, i, page)], columns=["doc_id", "page", "content"])

    return files.mapInPandas(run, schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; cells may hold line ends and doubled quotes."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def union_sources(*tables: DataFrame) -> DataFrame:
    """S7, U-1: all rows of all tables, by column name."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def clean_headers(df: DataFrame) -> DataFrame:
    """Lower case, blanks to underscores."""
    return df.toDF(*(c.lower().replace(" ", "_") for c in df.columns))


def write_table(df: DataFrame, path: str, one_csv: bool = False) -> None:
    """K1, K2: Parquet, or a single CSV for readers outside Spark."""
    if one_csv:
        df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").parquet(path)


def write_by_group(df: DataFrame, path: str, group: str, column: str) -> None:
    """K3: one folder of CSV per value of ``group``, with ``column`` only."""
    df.select(group, column).write.mode("overwrite").partitionBy(group).csv(path, escape='"')


class StageStore:
    """Results of stages kept as Parquet, by stage and by what they are made of, for ``ttl`` seconds.

    What a stage is made of: its parameters, the meaning of its plan, and the files that the plan reads (path, length, time of change). So
    a changed file, parameter or plan makes a stage anew. Each result is a version in a folder of its own, written
    beside it and published by a rename; a reader sees the old version or the new one, as a whole. The
    version before stays for those who still read it; older ones are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, ttl: float = 7 * 86400):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def fingerprint(self, made: DataFrame, **inputs: object) -> str:
        """Of the listed files, summed up by Spark, the plan and the parameters."""
        files = made.inputFiles()
        listed = None
        if files:
            rows = self.spark.read.format("binaryFile").load(files).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
            listed = rows.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).first()
        told = [made.semanticHash(), list(listed) if listed else None, inputs]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def versions(self, stage: str, digest: str) -> list[tuple[int, str]]:
        """Time of publishing (milliseconds) and path of every whole version, the newest last."""
        folder = self._path(f"{self.root}/{stage}/{digest}")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted((int(p.getName()[1:].split("-")[0]), p.toString()) for p in found if p.getName().startswith("v") and self._fs.exists(self._path(p, "_SUCCESS")))

    def get(self, stage: str, make: Callable[[], DataFrame], **inputs: object) -> DataFrame:
        """The stage's result; ``make`` describes it, and is run only if no fresh version is there."""
        made = make()
        digest = self.fingerprint(made, **inputs)
        there = self.versions(stage, digest)
        if not there or time.time() - there[-1][0] / 1000 > self.ttl:
            making, own = f"{self.root}/{stage}/.making-{uuid.uuid4().hex}", f"{self.root}/{stage}/{digest}"
            made.write.parquet(making)
            self._fs.mkdirs(self._path(own))
            if not self._fs.rename(self._path(making), self._path(f"{own}/v{time.time_ns() // 1_000_000}-{uuid.uuid4().hex[:8]}")):
                raise OSError(f"{making} could not be published")
            there = self.versions(stage, digest)
            for _, old in there[:-2]:
                self._fs.delete(self._path(old), True)
        return self.spark.read.schema(made.schema).parquet(there[-1][1])
