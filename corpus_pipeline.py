"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage applies one operator to all rows that its predecessor kept. Rows are told
apart by their place in the files they are read from, which every read gives alike, and
not by doc_id or by numbers given while reading; so repeated ids, columns of any
name and a change of cores between two reads pass. A stage whose input is no plain read
of files writes it once first. All stages but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerloom.llm.common import discard, on_files, place, scope, table, written


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells the rows apart, and its name."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return on_files(docs).withColumn(row, place()), row


def _kept(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    placed, row = _placed(docs)
    stay = decide(placed, row).where("kept").select(F.col("row").alias(row))
    return placed.join(stay, row, "left_semi").select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, scores below 0.5."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(lexicon)(F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, lambda rows, row: exact_dedup.exact_groups(rows, row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _kept(docs, lambda rows, row: near_dedup.near_duplicates(rows, row=row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut once more if at least half of it is taken."""
    placed, row = _placed(docs)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mixing.mix(placed, row=row).where("size > 0").select(F.col("row").alias(row), F.explode(F.sequence(F.lit(0), copies)).alias("copy")).where("copy > 0")
    return placed.join(taken.select(row), row).select(*docs.columns)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_best_fit),
]

# SQL can't express the learned lexicon, the signatures or the packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table ``documents``. Of the tables written on the way only the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as paths:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before, *paths[:-1])
        before = paths[-1:]
    return docs
