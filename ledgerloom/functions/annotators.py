"""Where models plug in: an annotator adds columns to a table of sentences (those of tokens and of layouts make rows).

The defaults are rules in place of models, so that everything around them can
run and be tested; they don't claim a model's results.
"""

from __future__ import annotations

import http.client
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


#: Number words that the rules know.
NUMBERS = "one|two|three|un|une|deux|ein|eine|zwei|uno|una|dos"


class Annotator(Protocol):
    def __call__(self, sents: DataFrame) -> DataFrame: ...


def rule_annotator(sents: DataFrame) -> DataFrame:
    """n_nouns, n_verbs, ent_labels by the shapes of words."""
    words = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    number = F.when(F.col("text").rlike(f"[0-9]|(?:^| )(?:{NUMBERS})(?: |$)"), F.lit("CARDINAL"))
    percent = F.when(F.col("text").rlike("[0-9]%"), F.lit("PERCENT"))
    return sents.withColumns({"n_nouns": words("[A-Za-z]{5,}"), "n_verbs": words("(?:ed|ing|en)(?:[^A-Za-z]|$)"), "ent_labels": F.filter(F.array(number, percent), lambda x: x.isNotNull())})


def model_annotator(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> Annotator:
    """An annotator around a Python model: loaded once per task, fed batches, its columns given by ``schema``."""

    def annotate(sents: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                yield pd.concat([batch.reset_index(drop=True), model(batch).reset_index(drop=True)], axis=1)

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.schema)
        return sents.mapInPandas(run, f"{own}, {schema}")

    return annotate


#: Tokens that models of text take at most.
TOKENS = 512


def _cut(text: str, tokens: int | None, chars: int | None) -> str:
    """The beginning of ``text``, up to so many words and characters."""
    text = (text or "")[:chars]
    if tokens is None:
        return text
    end = 0
    for n, m in enumerate(re.finditer(r"\S+", text), 1):
        if n > tokens:
            return text[:end]
        end = m.end()
    return text


def classifier_annotator(load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], tokens: int | None = TOKENS, chars: int | None = None) -> Annotator:
    """esg_topic, esg_score: the label with the highest score, the first of equals.

    The model gives, for a batch of texts, each one's labels with scores; it is loaded once per task. It sees at most ``tokens``
    words of a text (what a model's own tokens are is up to it: it must not take more of them than it can), and ``chars`` characters.
    A text that it gives no label has nulls.
    """

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        model = load()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            results = model([_cut(t, tokens, chars) for t in batch["text"]]) if len(batch) else []
            best = [max(r, key=lambda x: x[1]) if r else (None, None) for r in results]
            return pd.DataFrame(best, columns=["esg_topic", "esg_score"]).astype({"esg_score": "Float64"})

        return run

    return model_annotator(start, "esg_topic string, esg_score double")


def token_annotator(load: Callable[[], Callable[[str], list[tuple[str, list[float]]]]], limit: int = TOKENS) -> Annotator:
    """Rows of sent_id, pos, token, v for the first ``limit`` tokens of every sentence, by a model of one text."""

    def annotate(sents: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                rows = [(i, pos, token, list(v)) for i, text in zip(batch["sent_id"], batch["text"], strict=True) for pos, (token, v) in enumerate(islice(model(text or ""), limit))]
                yield pd.DataFrame(rows, columns=["sent_id", "pos", "token", "v"])

        own = sents.schema["sent_id"].dataType.simpleString()
        return sents.select("sent_id", "text").mapInPandas(run, f"sent_id {own}, pos int, token string, v array<double>")

    return annotate


def entity_annotator(load: Callable[[], Callable[[str], list[tuple[str, str, int, int]]]]) -> Annotator:
    """``entities``, an array of (text, label, start, end) by a model of one text, and ``ent_labels`` for the filter of sentences."""

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        model = load()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            found = [[dict(zip(("text", "label", "start", "end"), e, strict=True)) for e in model(t or "")] for t in batch["text"]]
            return pd.DataFrame({"entities": found, "ent_labels": [[e["label"] for e in own] for own in found]})

        return run

    return model_annotator(start, "entities array<struct<text: string, label: string, start: int, end: int>>, ent_labels array<string>")


def segmenter(load: Callable[[], Callable[[str], list[str]]]) -> Callable[[DataFrame], DataFrame]:
    """P3's plug: sentences of documents by a model of one text, as a table function that is joined laterally to the rows (doc_id, text).

    Gives doc_id, sent_pos, text; the model is loaded once per task. ``text.sentences`` takes it as ``split``.
    """

    class Segments:
        def __init__(self):
            self.model = load()

        def eval(self, text: str):
            yield from enumerate(self.model(text or ""))

    cut = udtf(Segments, returnType="sent_pos: int, sentence: string")

    def split(docs: DataFrame) -> DataFrame:
        return docs.lateralJoin(cut(F.col("text").outer())).select("doc_id", "sent_pos", F.col("sentence").alias("text"))

    return split


def lemma_annotator(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """T3's plug: from an array of texts to their lemmas, by a model of many texts at once, loaded once per task.

    A batch's arrays go to the model as one list. A null text keeps a null lemma. ``topics.kwtopics`` and ``topics.topic_keywords`` take it as ``lemmas``.
    """

    @F.pandas_udf("array<string>")
    def lemmas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            flat = [t for own in batch if own is not None for t in own if t is not None]
            made = iter(model(flat) if flat else [])
            yield pd.Series([None if own is None else [None if t is None else next(made) for t in own] for own in batch], dtype=object)

    return lemmas


def form_text(text: str) -> bytes:
    """A form of one field, ``text``."""
    return urllib.parse.urlencode({"text": text}).encode()


def service_annotator(url: str, form: Callable[[str], bytes] = form_text, timeout: float = 10.0, retries: int = 2, wait: float = 0.2, at_once: int = 8, batch: int = 256) -> Annotator:
    """``reply`` (the service's JSON, for ``text.entity_reply``) and ``error`` of every text, by POST requests.

    A task has at most ``at_once`` requests open and holds ``batch`` rows. A request that takes over ``timeout`` seconds or fails is tried
    again ``retries`` times, after ``wait`` seconds, twice as long each time; a text that the service refuses (a status of the
    400s) is not. What fails for good has a null reply and its error; no row is lost, and no other row waits for it beyond the batch.
    """

    def annotate(sents: DataFrame) -> DataFrame:
        places = [f.name for f in sents.schema].index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(at_once) as pool:
                for whole in batches:
                    for start in range(0, whole.num_rows, batch):
                        part = whole.slice(start, batch)
                        found = [*pool.map(lambda t: _ask(url, form(t or ""), timeout, retries, wait), part.column(places).to_pylist())]
                        columns = [*part.columns, pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "reply", "error"])

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.schema)
        return sents.mapInArrow(run, f"{own}, reply string, error string")

    return annotate


def _ask(url: str, body: bytes, timeout: float, retries: int, wait: float) -> tuple[str | None, str | None]:
    error = None
    for k in range(retries + 1):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, method="POST"), timeout=timeout) as reply:
                return reply.read().decode(), None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code < 500:
                break
        except (OSError, http.client.HTTPException, UnicodeDecodeError) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error
