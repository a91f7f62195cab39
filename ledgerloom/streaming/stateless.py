"""The sentence stages on a stream of documents: none keeps state, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.annotators import Annotator, rule_annotator
from ..operators.text import accepted, sentence_filter, sentences
from ..operators.topics import kwtopics


def numeric_sentences(docs: DataFrame, topics: dict[str, list[str]], annotate: Annotator = rule_annotator) -> DataFrame:
    """Accepted sentences with their topics, for a batch or a streaming table of doc_id and text."""
    return kwtopics(accepted(sentence_filter(annotate(sentences(docs)))), topics)
