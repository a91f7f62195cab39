"""Personal data: fixed rules, and a semi-Markov conditional random field that adds spans.

The field scores whole segments: each candidate (a run of a text's atoms that could
be an entity of a kind) has features of the whole span and its surroundings. A
dynamic program over the atoms, with entities of bounded length, finds the set
of non-overlapping segments and kinds of highest total score. The weights are
learned here, by the gradient of the log-likelihood (forward-backward over the same
segments), from sentences composed by rule with entities written in many ways and
with look-alikes that are none (order numbers, dates, versions, hashes).

What the rules find stays as it is; the field runs over every stretch between
and adds what the rules can't see: mail written with "at" and
"dot", phone numbers without a plus sign, addresses with bracketed dots, cards
with other separators.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, exact_ids, ids, table

KINDS = ("email", "ip", "card", "phone")

# The rules of the base.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same addresses as ``IP`` finds, each run of digits looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _emails(text: str) -> list[tuple[int, int]]:
    """As ``EMAIL`` finds them, looking only around each "@"."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the rules, by kind and start."""
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    if not any(c in text for c in "0123456789"):
        return out
    for m in _IP.finditer(text):
        if all(_byte(p) for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------

#: Atoms that an entity has at most.
LONGEST = 24
_ATOM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_|\s+")
_MAIL = re.compile(r"(?i)(?<![a-z0-9._%+-])[._%+-]*+([a-z0-9][a-z0-9._%+-]*+\s*+(?:@|[\[(]\s*at\s*[\])]|(?<=\s)at\s))\s*[a-z0-9-]+(\s*(\.|[\[(]\s*dot\s*[\])]|\sdot\s)\s*[a-z0-9-]+)+")
_PART = re.compile(r"[A-Za-z0-9-]+")
_NUMBER = re.compile(r"[+(]?\d[\d\s().\[\]/-]*\d")
_CUES = [
    re.compile(r"(?i)\b(e-?mail|mail|contact|write|reach)\b"),
    re.compile(r"(?i)\b(ip|host|server|address|ping|login)\b"),
    re.compile(r"(?i)\b(card|visa|credit|pay|account|iban)\b"),
    re.compile(r"(?i)\b(phone|tel|call|fax|mobile|cell|dial)\b"),
    re.compile(r"(?i)\b(order|invoice|isbn|version|date|page|no|nr|id|ref|build|token|hash)\b"),
]
FEATURES = 35


def candidates(window: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): every segment that could be an entity of the kind, before any is scored."""
    out = set()
    m = _MAIL.search(window)
    while m:
        first, split = m.start(1), m.end(1)
        # Every word after the at-sign may be the last, as far as an entity reaches.
        reach = max((x.end() for x in itertools.islice(_ATOM.finditer(window, first), 2 * LONGEST)), default=first)
        parts = [x.end() for x in _PART.finditer(window, split, m.end()) if x.end() <= reach]
        out.update((0, first, p) for p in parts if re.search(r"(?i)\.|dot", window[split:p]))
        # What follows an at-sign may be the name before the next one.
        m = _MAIL.search(window, m.end(1))
    for m in _NUMBER.finditer(window):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer(r"\d+", m[0])]
        if sum(b - a for a, b in groups) < 4 or (m.start() and window[m.start() - 1].isalnum()) or window[m.end() : m.end() + 1].isalnum():
            continue
        for i in range(len(groups)):
            start = groups[i][0]
            if window[max(0, start - 1) : start] in ("+", "("):
                start -= 1
                if start and window[start - 1 : start + 1] == "+(":
                    start -= 1
            total = 0
            for j in range(i, min(len(groups), i + LONGEST // 2)):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                end = groups[j][1]
                if j - i == 3:
                    out.add((1, start, end))
                if 13 <= total:
                    out.add((2, start, end))
                if 7 <= total <= 15 and j > i:
                    out.add((3, start, end))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def span_features(window: str, kind: int, start: int, end: int) -> np.ndarray:
    """What the whole span and its surroundings look like."""
    s, f = window[start:end], np.zeros(FEATURES)
    digits, groups = _digits(s), re.findall(r"\d+", s)
    f[0] = 1
    f[1] = min(len(s), 40) / 10
    f[2] = len(digits) / 10
    f[3] = len(groups) / 4
    seps = re.sub(r"\d", "", s)
    f[4] = "(" in seps and ")" in seps
    f[5] = s[:1] == "+"
    f[6] = len(set(seps.replace(" ", "").replace("(", "").replace(")", "").replace("+", ""))) <= 1
    f[7] = bool(re.search(r"\s{2}|\n", s))
    f[8] = "/" in seps
    f[9] = "." in seps
    f[10] = "-" in seps
    f[11] = "[" in seps and "]" in seps
    f[12] = 13 <= len(digits) <= 19 and luhn(digits)
    f[13] = len(digits) == 16
    f[14] = 9 <= len(digits) <= 12
    f[15] = len(digits) < 9
    f[16] = len(groups) == 4 and all(_byte(g) and (g == "0" or g[0] != "0") for g in groups)
    f[17] = len(groups) == 4 and all(len(g) == 4 for g in groups)
    f[18] = bool(re.search(r"\b(19|20)\d\d\b", s)) and len(digits) == 8
    f[19] = bool(re.fullmatch(r"\D?\d{3}\D+\d{3}\D+\d{4}", s))
    before, after = window[max(0, start - 30) : start], window[end : end + 12]
    for k, cue in enumerate(_CUES):
        f[20 + k] = bool(cue.search(before))
    f[25] = bool(re.match(r"[\s]*[\d(+\[-]", after)) or bool(re.search(r"[\d\]+-]\s?$", before))
    f[26] = bool(re.search(r"[$€#=\"]\s*$", before))
    if kind == 0:
        f[27] = "@" in s
        f[28] = bool(re.search(r"(?i)[\[(]\s*at\s*[\])]", s))
        f[29] = bool(re.search(r"(?i)[\[(]\s*dot\s*[\])]|\sdot\s", s))
        f[30] = bool(re.search(r"(?i)(\.|dot\s*[\])]?)\s*(com|org|net|edu|io|de|fr|es|uk|info|eu)$", s))
        f[31] = len(re.split(r"\W+", s)[-1]) > 6 or bool(re.search(r"\d$", s))
        f[32] = bool(re.search(r"(?i)(\.|[\[(]?\s*dot\s*[\])]?)\s*(com|org|net|edu|io|de|fr|es|uk|info|eu)\b.+", s))
        f[34] = bool(re.search(r"\w\.\s", s))  # a sentence ends
    f[33] = sum(len(g) for g in groups) == len(s)
    return f


def _lattice(window: str, segments: list[tuple[int, int, int]]) -> tuple[list[int], list[list[int]]]:
    """Bounds of atoms that segments cover, and for every bound the segments that end there and span at most ``LONGEST`` atoms."""
    edges, at = {0, *(s[1] for s in segments), *(s[2] for s in segments)}, 0
    for _, a, b in sorted(segments, key=lambda s: s[1]):
        for m in _ATOM.finditer(window, max(a, at), max(b, at)):
            edges.add(m.end())
        at = max(at, b)
    bounds = sorted(edges)
    place = {b: i for i, b in enumerate(bounds)}
    ends: list[list[int]] = [[] for _ in bounds]
    for k, (_, a, b) in enumerate(segments):
        if place[b] - place[a] <= 2 * LONGEST:
            ends[place[b]].append(k)
    return bounds, ends


def decode(window: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best set of non-overlapping segments; an atom outside all scores nothing."""
    segments = candidates(window)
    if not segments:
        return []
    seen: dict[tuple, float] = {}  # of spans that look alike, as in columns of numbers
    scores = []
    for kind, a, b in segments:
        key = kind, window[max(0, a - 31) : a], window[a:b], window[b : b + 13]
        if key not in seen:
            seen[key] = float(weights[kind] @ span_features(window, kind, a, b))
        scores.append(seen[key])
    bounds, ends = _lattice(window, segments)
    place = {b: i for i, b in enumerate(bounds)}
    best, back = [0.0] * len(bounds), [-1] * len(bounds)
    for i in range(1, len(bounds)):
        best[i] = best[i - 1]
        for k in ends[i]:
            if (v := best[place[segments[k][1]]] + scores[k]) > best[i]:
                best[i], back[i] = v, k
    out, i = [], len(bounds) - 1
    while i > 0:
        if back[i] >= 0:
            out.append(segments[back[i]])
            i = place[segments[back[i]][1]]
        else:
            i -= 1
    return out[::-1]


def _gradient(window: str, gold: set, weights: np.ndarray, grad: np.ndarray) -> None:
    """Adds observed less expected features of one window to ``grad``."""
    segments = candidates(window)
    if not segments:
        return
    x = np.array([span_features(window, *s) for s in segments])
    scores = np.array([weights[s[0]] @ f for s, f in zip(segments, x, strict=True)])
    bounds, ends = _lattice(window, segments)
    place = {b: i for i, b in enumerate(bounds)}
    n = len(bounds)
    forward, backward = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        forward[i] = np.logaddexp.reduce([forward[i - 1], *(forward[place[segments[k][1]]] + scores[k] for k in ends[i])])
    starts: list[list[int]] = [[] for _ in bounds]
    for i in range(n):
        for k in ends[i]:
            starts[place[segments[k][1]]].append(k)
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[place[segments[k][2]]] + scores[k] for k in starts[i])])
    for k, s in enumerate(segments):
        p = np.exp(forward[place[s[1]]] + scores[k] + backward[place[s[2]]] - forward[-1])
        grad[s[0]] += ((s in gold) - p) * x[k]


_FILLER = "the of and to in that was for on with as from they have this not are but had his which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over".split()
_ENDINGS = ("com", "org", "net", "edu", "io", "de", "fr", "es")


def examples(n: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Sentences composed by rule: one entity or look-alike between filler words, with the spans of entities."""
    rng, out = random.Random(seed), []
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        d = rng.choice("3456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    for _ in range(n):
        what, cue = rng.randrange(12), ""
        kind, s = None, ""
        if what <= 1:
            kind, cue = 0, rng.choice(["mail", "contact", "write to", "", ""])
            at, dot = rng.choice([("@", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), (" at ", "."), ("(at)", "(dot)"), (" @ ", ".")])
            s = f"{name()}{rng.choice(['', '.', '_'])}{name()}{at}{name()}{dot}{rng.choice(_ENDINGS)}"
        elif what <= 3:
            kind, cue = 1, rng.choice(["host", "ip", "server", "", "", ""])
            s = rng.choice([".", ".", "[.]", " . ", "(.)"]).join(str(rng.randint(1, 255)) for _ in range(4))
        elif what <= 5:
            kind, cue, c = 2, rng.choice(["card", "visa", "pay", "", "", ""]), card()
            s = rng.choice([c, c, *(sep.join(c[i : i + 4] for i in range(0, 16, 4)) for sep in (" ", "-", ".", " - ", "/"))])
        elif what <= 7:
            kind, cue = 3, rng.choice(["call", "phone", "tel", "", "", ""])
            s = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"0{num(3)} {num(3)} {num(4)}"])
        else:
            cue = rng.choice(["order", "invoice", "isbn", "version", "date", "page", "ref", "", "", "", ""])
            s = rng.choice(
                [num(rng.randint(4, 12)), f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}.{num(2)}.{num(1)}", f"{num(3)} {num(3)}", f"{num(4)} - {num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(16)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(3)}.{rng.randint(256, 999)}.{num(3)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{name()} at {name()}.", f"{name()} at the {name()}. {name()}", f"{name()} at {name()}. {rng.choice(_ENDINGS).title()}", f"{name()} at {name()}.{rng.choice(['html', 'txt', 'py', 'jpg'])}", f"{name()} at {num(2)}.{num(2)}", f"{num(2)}.{num(3)},{num(2)}", f"{num(1)} {num(2)} {num(3)} {num(1)}", f"{num(5)}.{num(6)}"]
            )
            d = _digits(s)
            if len(d) == 16 and luhn(d):
                kind = 2
        words = lambda: " ".join(rng.choice(_FILLER) for _ in range(rng.randint(1, 7)))
        text = words() + (f" {cue}{rng.choice([' ', ': ', ' is '])}" if cue else " ")
        start = len(text)
        text += s + rng.choice([" ", ". ", ", "]) + words()
        out.append((text, {(kind, start, start + len(s))} if kind is not None else set()))
    return out


def train(n: int = 900, rounds: int = 12, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Weights per kind and feature, by AdaGrad on the log-likelihood of composed sentences."""
    data = examples(n)
    weights, seen = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-8)
    for _ in range(rounds):
        for i in range(0, len(data), 30):
            grad = np.zeros_like(weights)
            for window, gold in data[i : i + 30]:
                _gradient(window, gold, weights, grad)
            grad = grad / 30 - penalty * weights
            seen += grad * grad
            weights += rate * grad / np.sqrt(seen)
    return weights


def find(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans of the rules, and those of the field that overlap none of them."""
    base = base_spans(text)
    added, at = [], 0
    # Every stretch between what the rules have found is read whole, as a text of its own.
    for start, end in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        if at < start:
            added += [(kind, at + a, at + b) for kind, a, b in decode(text[at:start], weights)]
        at = max(at, end)
    return base, added


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def _show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _scan(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(ids(batch).tolist(), batch["text"], strict=True):
                base, added = find(text, weights)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(_show(base).encode()).hexdigest(), _show(base + added), len(added), len(base) + len(added)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: counts and digest of the rules' spans, all spans, how many the field added, and how many there are.

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have
    none. Repeated rows and null ids pass. Empty table: no rows. Other columns are not read.
    """
    return exact_ids(documents(docs, "doc_id", "text")).mapInPandas(_scan(train() if weights is None else weights), COLUMNS)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
