"""What the training-text operators share: tables, the shared folder and small Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a folder of this machine is used;
    on a cluster that would lose data, so there it is an error.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "ledgerloom-shared")


#: The lists that tables written in this thread (or context) add their paths to, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there.

    Cuts the lineage: a lost executor costs a reread, and what depends on the
    order of rows (numbers given to rows) can't come out differently twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _SCOPES.get():
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``written`` has made and that nothing reads any more."""
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of all tables that ``written`` makes inside, in order; those that other threads write meanwhile are not among them."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield paths
    finally:
        _SCOPES.reset(token)


def _relation(plan):
    """The one relation of which a logical plan only picks columns and rows, if it is such a plan."""
    name = plan.nodeName()
    if name in ("Project", "Filter", "SubqueryAlias"):
        return _relation(plan.children().apply(0)) if plan.deterministic() else None
    return plan.relation() if name == "LogicalRelation" else None


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a read of Parquet files, of which columns or rows are picked at most; else what it gives, written once.

    Of the result ``place`` tells the rows apart, in every read alike. A read that lists a file
    twice has two rows for each place; such a one is written, too.
    """
    relation = _relation(docs._jdf.queryExecution().analyzed())
    if relation is not None and "_metadata" not in docs.columns:
        try:
            docs.select("_metadata.row_index")
            if len(relation.location().inputFiles()) == len(docs._jdf.inputFiles()):  # with repeats, and without
                return docs
        except AnalysisException:
            pass
    return written(docs, "rows")


def place() -> Column:
    """16 bytes that stand for the row's file and its number there: the same however the files are split, so two reads agree."""
    at = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return F.unhex(F.md5(at.cast("binary")))


def parts(df: DataFrame) -> int:
    """How many partitions a shuffle of the rows of ``df`` gets: as set, and at least as many as the scan has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def documents(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Only ``columns`` of ``docs``, a null text as an empty one. Other columns, whatever their names, go."""
    return docs.select(*(F.coalesce(F.col("text"), F.lit("")).alias("text") if isinstance(c, str) and c == "text" else c for c in columns))


def exact_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` as pandas gets it: nulls of ``column`` as zeros and named by ``no_id``. (A null among whole numbers would turn all of them into floating ones.)"""
    return df.withColumns({column: F.coalesce(F.col(column).cast("long"), F.lit(0)), "no_id": F.col(column).isNull()})


def ids(batch: pd.DataFrame, column: str = "doc_id") -> pd.Series:
    """The nullable whole numbers that ``exact_ids`` has passed."""
    return batch[column].astype("Int64").mask(batch["no_id"])
