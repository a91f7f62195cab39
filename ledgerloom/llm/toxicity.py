"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters and
turns all else into single blanks. Lexicon entries are word beginnings or whole
words. An entry's weight is the logarithm of how much oftener it stands in toxic
training texts; exception phrases (words or pairs of words that contain an entry
without being toxic) cancel the matches inside them. The weights of the distinct
words matched, set against the length of the text, give the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, table

#: Labelled rows that the lexicon is learned from, at most: those of the smallest hashed ids. And bytes of their texts, in the same order; a text beyond them is not learned from.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20

# Letters that look like others, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "i", "ƽ": "s",
    **{chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF4C): "i"},
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Characters that are not seen.
HIDDEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])

# A one stands for an i or an l, so both letters are folded to one.
_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, "l": "i"}) | HIDDEN
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|€]+(?=[^\W\d_])")
_REST = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The words of ``text``, folded, each between two single blanks."""
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text or "!" in text or "|" in text or "€" in text:
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return f" {_REST.sub(' ', text).strip()} "


class Lexicon:
    """Entries with weights, exception phrases, and the four numbers that turn matches into a score."""

    def __init__(self, entries: dict[str, float], exceptions: set[str], scale: list[float]):
        self.entries, self.exceptions, self.scale, self._automaton = entries, exceptions, scale, None

    def __getstate__(self):
        return self.entries, self.exceptions, self.scale

    def __setstate__(self, state):
        self.entries, self.exceptions, self.scale = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e in self.exceptions:
                self._automaton.add_word(e, (len(e), None, e in self.entries and self.entries[e]))
            for e, w in self.entries.items():
                if e not in self.exceptions:
                    self._automaton.add_word(e, (len(e), w, False))
            if self._automaton:
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[str, float]:
        """The distinct words matched, with the largest weight of each, without those inside exceptions."""
        found, clear = [], []
        if not self.automaton():
            return {}
        for end, (n, weight, _) in self.automaton().iter(folded):
            (clear if weight is None else found).append((end - n + 1, end, weight or 0.0))
        out: dict[str, float] = {}
        # In order of their starts; of the exceptions that began by then the one that reaches farthest decides.
        clear.sort(reverse=True)
        reach = -1
        for start, end, weight in sorted(found):
            while clear and clear[-1][0] <= start:
                reach = max(reach, clear.pop()[1])
            if end <= reach:
                continue
            word = folded[start + 1 : folded.index(" ", start + 1)]
            out[word] = max(weight, out.get(word, 0.0))
        return out

    def features(self, folded: str) -> list[float]:
        hits, n = self.hits(folded), folded.count(" ") - 1
        total = sum(hits.values())
        return [1.0, math.log1p(total), total / math.sqrt(n + 25.0), max(hits.values(), default=0.0)]

    def score(self, folded: str) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.features(folded), self.scale)))))))


def learn(texts: list[str], toxic: list[int], gain: float = 25.0, ratio: float = 3.0, support: int = 4) -> Lexicon:
    """The lexicon of labelled texts: entries are taken greedily by their gain in likelihood."""
    folded = [fold(t) for t in texts]
    counts = [Counter(), Counter()]
    for f, y in zip(folded, toxic, strict=True):
        counts[bool(y)].update(set(f.split()))
    clean, bad = (sum(c.values()) + 1 for c in counts)
    of: dict[str, list[str]] = {}
    for w in counts[1]:
        for k in range(3, min(len(w), 14) + 1):
            of.setdefault(" " + w[:k], []).append(w)
        of.setdefault(f" {w} ", []).append(w)
    for w in counts[0]:
        for k in range(3, min(len(w), 14) + 1):
            if (e := " " + w[:k]) in of and w not in counts[1]:
                of[e].append(w)

    def worth(a: float, b: float) -> float:
        expected = (a + b) * bad / (bad + clean)
        if a < support or a / bad < ratio * (b + 0.5) / clean:
            return 0.0
        return a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0)

    tally = lambda e, taken: [sum(c[w] for w in of[e] if w not in taken) for c in (counts[1], counts[0])]
    entries, taken = {}, set()
    queue = sorted(((worth(*tally(e, taken)), e) for e in of), reverse=True)
    for first, e in queue:
        if first < gain:
            break
        a, b = tally(e, taken)
        if worth(a, b) >= gain:
            entries[e] = math.log((a / bad) / ((b + 0.5) / clean))
            taken.update(of[e])
    # Words under an entry, and pairs with a word under one, that are no oftener toxic than others.
    pairs = [Counter(), Counter()]
    for f, y in zip(folded, toxic, strict=True):
        row = f.split()
        pairs[bool(y)].update({f" {u} {v} " for u, v in zip(row, row[1:], strict=False) if u in taken or v in taken})
    single = [Counter({f" {w} ": c[w] for w in taken}) for c in counts]
    exceptions = {p for c in (single, pairs) for p in c[0] if c[0][p] >= 8 and c[1][p] / bad < 1.2 * c[0][p] / clean}
    made = Lexicon(entries, exceptions, [0.0] * 4)
    x, y = np.array([made.features(f) for f in folded] or np.zeros((0, 4))), np.array(toxic, float)
    made.scale = _logistic(x, y)
    return made


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Newton's method; the constant is not penalised."""
    w = np.zeros(4)
    if not len(y):
        return w.tolist()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, penalty, penalty, penalty])
        w -= np.linalg.solve(h, g)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Lexicon:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, ``sample`` rows and ``sample_bytes`` bytes at most.

    Of an id given to several texts the least text is learned from; of one with both labels, its text twice, once with each.
    """
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic"]
    ids = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0)
    ids = ids.orderBy(*order).limit(sample)
    met = documents(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sofar = F.sum(F.octet_length("text").cast("long")).over(W.orderBy(*order))  # over `sample` rows at most
    rows = rows.withColumn("sofar", sofar).where(F.col("sofar") <= sample_bytes).orderBy(F.desc("doc_id"), F.desc("text")).drop("sofar").collect()
    texts, toxic = [], []
    while rows:  # and let go of each
        r = rows.pop()
        texts.append(r["text"])
        toxic.append(r["toxic"])
    return learn(texts, toxic)


def scorer(lexicon: Lexicon):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([lexicon.score(fold(t or "")) for t in batch], dtype=float)

    return score


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of the score. Null and empty texts score the model's
    base. A null doc_id is not held out. Repeated rows score alike. Empty table: no rows.
    """
    scored = docs.select("doc_id", scorer(lexicon)(F.col("text")).alias("score"))
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
