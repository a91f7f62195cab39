"""Stage results put together by sentence, and held against labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the table of features.
FEATURES = ("kpi_ngram", "kpi_sent", "kw_topic1", "esg_topic", "ducks", "ngram", "ntopics", "keywords1", "score_sent", "score_ngram", "esg_score")


def aggregate(scope: DataFrame, *stages: DataFrame) -> DataFrame:
    """J-2: the eleven features of every sentence in scope, from its own columns and those of the stages; what a stage lacks is null."""
    joined = reduce(lambda a, b: a.join(b, "sent_id", "left"), stages, scope)
    return joined.select("sent_id", *FEATURES)


def same(a: Column | str, b: Column | str) -> Column:
    """Equal and both known."""
    return F.coalesce(F.expr(a) == F.expr(b) if isinstance(a, str) else a == b, F.lit(False))


def compare_clean(labels: DataFrame, matches: DataFrame, names: Iterable[str]) -> DataFrame:
    """J-3: labels with the match of each field (kpi, topic, value), its score under a name of its own, and a flag for each, from one table of matches (``embed.compare_lists``)."""
    return labels.join(matches, "sent_id").withColumns({f"{name}_match": same(F.col(name), F.col(f"A{name}")) for name in names})


def ngram_vs_sent(ngrams: DataFrame, sents: DataFrame) -> DataFrame:
    """J-4: left join; every match of a repeated key stays."""
    return ngrams.join(sents, "sent_id", "left")


def kpi_disagreement(matches: DataFrame, above: float = 0.9, below: float = 0.8) -> DataFrame:
    """Rows whose n-gram and sentence name different indicators (null differs from any), by score."""
    differ = ~F.col("kpi_ngram").eqNullSafe(F.col("kpi_sent")) | F.col("kpi_ngram").isNull()
    return matches.where(differ & (F.col("score_ngram") > above) & (F.col("score_sent") < below))


def labelled_matches(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """J-5, A11: matches with their true label where there is one; ``correct`` and ``correct_sent``."""
    return matches.join(truth, "sent_id", "left").withColumns({"correct": same(F.col("kpi_ngram"), F.col("true_kpi")), "correct_sent": same(F.col("kpi_sent"), F.col("true_kpi"))})
