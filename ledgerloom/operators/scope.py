"""Which sentences are in scope, from keyword topics and classifier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "outofscope"


def classified(topics: DataFrame, esg: DataFrame) -> DataFrame:
    """J-1: topics with the classifier's columns, where these come from elsewhere. A classifier that is an annotator needs no join: it adds its columns to the rows."""
    return topics.join(esg.select("sent_id", "esg_topic", "esg_score"), "sent_id")


def relabel(rows: DataFrame, column: str = "esg2") -> DataFrame:
    """``column`` is the classifier's topic, or out of scope where its score is under 0.5 and no keyword stands."""
    weak = (F.col("esg_score") < 0.5) & (F.col("ntopics") == 0)
    return rows.withColumn(column, F.when(weak, F.lit(OUT)).otherwise(F.col("esg_topic")))


def inscope(rows: DataFrame) -> DataFrame:
    """Relabelled, and only what is in scope."""
    return relabel(rows, "esg_topic").where(F.col("esg_topic") != OUT)
