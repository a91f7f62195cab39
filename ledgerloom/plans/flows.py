"""The flows: pages to flagged sentences, report to scoped sentences, sentences to features, features against labels.

A classifier is an annotator: it adds esg_topic and esg_score to the rows it is given, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.annotators import Annotator, rule_annotator
from ..functions.text import numbers
from ..operators import embed, evaluate, layout, scope, text, topics


#: From (doc_id, text) to sentences (doc_id, sent_pos, text).
Segmenter = Callable[[DataFrame], DataFrame]


def preprocess(pages: DataFrame, annotate: Annotator = rule_annotator, limit: int = 9_999_999, split: Segmenter = text.rule_segments) -> DataFrame:
    """Pages with a text layer to sentences, each flagged; documents whose text is too short to be one are left out."""
    docs = text.pages_to_text(pages, limit).where("ok").select("doc_id", "text")
    return text.sentence_filter(annotate(text.sentences(docs, split)))


def counted(rows: DataFrame, counts: Observation | None, **of: Column) -> DataFrame:
    """``rows``, of which ``counts`` learns how many there are (``n``) and the counts ``of`` conditions when they are computed: no pass of its own."""
    return rows if counts is None else rows.observe(counts, F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in of.items()))


def report_flow(
    blocks: DataFrame,
    dictionary: dict[str, list[str]] | DataFrame,
    classify: Annotator,
    annotate: Annotator = rule_annotator,
    split: Segmenter = text.rule_segments,
    lemmas: topics.Lemmas = topics.rule_lemmas,
    flagged: Observation | None = None,
    scoped: Observation | None = None,
) -> DataFrame:
    """Entry A: layout blocks to text in reading order, its numeric sentences, and those in scope.

    No task holds a document: blocks are merged and cut into sentences run by run. ``flagged`` learns the counts of
    sentences and of accepted ones, ``scoped`` those of sentences with a keyword topic and in scope, as the flow runs.
    """
    ordered = layout.reading_order(layout.column_clusters(layout.text_not_in_figure(blocks)))
    sents = text.sentence_filter(annotate(layout.sentences_of_blocks(ordered, split)))
    found = classify(topics.kwtopics(text.accepted(counted(sents, flagged, accepted=F.col("accepted"))), dictionary, lemmas=lemmas))
    return scope.inscope(observed_scope(found, scoped))


def observed_scope(rows: DataFrame, counts: Observation | None) -> DataFrame:
    """``rows`` with topics and classes, of which ``counts`` learns ``n``, ``inscope`` and ``with_topic``."""
    relabelled = scope.relabel(rows, "esg2_") if counts is not None else rows
    return counted(relabelled, counts, inscope=F.col("esg2_") != scope.OUT, with_topic=F.col("ntopics") > 0).select(*rows.columns)


def create_features(sents: DataFrame, token_feats: DataFrame, kpis: DataFrame, dictionary: dict[str, list[str]] | DataFrame, classify: Annotator, lemmas: topics.Lemmas = topics.rule_lemmas, scoped: Observation | None = None) -> DataFrame:
    """Entry B: topics, scope, entities and best indicators of sentences, in one table."""
    found = scope.inscope(observed_scope(classify(topics.kwtopics(sents, dictionary, lemmas=lemmas)), scoped)).withColumn("ducks", F.array_join(numbers(F.col("text")), "|"))
    return evaluate.aggregate(found, embed.compare_both(token_feats, kpis))


def evaluate_labels(labels: DataFrame, token_feats: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Entry C: labels with the best match in each list of indicators, and whether it is right."""
    return evaluate.compare_clean(labels, embed.compare_lists(token_feats, lists), lists)
