"""Pages to text, text to sentences, and which sentences carry numeric facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_sentences, text_filter

NUMERIC = ("CARDINAL", "PERCENT", "MONEY")


def pages_to_text(pages: DataFrame, limit: int = 9_999_999, least: int = 100) -> DataFrame:
    """S3: the first ``limit`` pages of each document joined by blanks. ``ok`` is false under ``least`` characters (a scan without a text layer)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ")
    return pages.where(F.col("page") < limit).groupBy("doc_id").agg(joined.alias("text")).withColumn("ok", F.length("text") >= least)


def sentence_id(doc_id: Column | str = "doc_id", sent_pos: Column | str = "sent_pos") -> Column:
    """The key of a sentence: document and place, as text, so that ids of any kind and size and documents of any length pass."""
    as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.coalesce(as_text(doc_id), F.lit("")), F.lit(":"), as_text(sent_pos))


def rule_segments(docs: DataFrame) -> DataFrame:
    """P3's default: doc_id, sent_pos, text by the rule."""
    return docs.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("sent_pos", "text"))


def sentences(docs: DataFrame, split: Callable[[DataFrame], DataFrame] = rule_segments) -> DataFrame:
    """doc_id, sent_pos, sent_id, text. ``split``: from (doc_id, text) to (doc_id, sent_pos, text), as ``annotators.segmenter`` gives one."""
    return split(docs.select("doc_id", text_filter(F.col("text")).alias("text"))).withColumn("sent_id", sentence_id())


def sentence_filter(annotated: DataFrame, require_digit: bool = True) -> DataFrame:
    """P4 (P4b without the digit): adds ``accepted``; no row is dropped."""
    accepted = F.arrays_overlap("ent_labels", F.array(*map(F.lit, NUMERIC))) & (F.col("n_nouns") >= 2) & (F.col("n_verbs") >= 1)
    if require_digit:
        # First, since it is the cheapest and fails the most: what follows is then not computed.
        accepted = F.col("text").rlike("[0-9]") & accepted
    return annotated.withColumn("accepted", accepted)


def accepted(sents: DataFrame, keep: bool = True) -> DataFrame:
    """P5: the accepted sentences, or the others."""
    return sents.where(F.col("accepted") if keep else ~F.col("accepted"))


def parted(sents: DataFrame) -> DataFrame:
    """P5, both at once: ``part`` is accepted or rejected. One pass; rows whose flag is null are neither, as in both filters."""
    part = F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected")
    # The one-row generator keeps the filter from being pushed below, where it would compute the flag again.
    return sents.withColumn("part", F.explode(F.array(part))).where(F.col("part").isNotNull())
