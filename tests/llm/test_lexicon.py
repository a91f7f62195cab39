"""What the lexicon of toxic words learns, against the same rule by plain counting."""

import math
import random

from ledgerloom.llm import toxicity


def covers(entry, word):
    return f" {word} " == entry if entry.endswith(" ") else f" {word} ".startswith(entry)


def plain_entries(folded, toxic, gain, ratio, support):
    """Entries in the order of their first worth: every word and beginning of a word of toxic texts, each time counted over all texts."""
    rows = [(set(f.split()), y) for f, y in zip(folded, toxic, strict=True)]
    words = {w for r, _ in rows for w in r}
    times = {w: [sum(w in r and bool(y) == bad for r, y in rows) for bad in (True, False)] for w in words}
    bad, clean = (sum(t[k] for t in times.values()) + 1 for k in (0, 1))
    candidates = {e for w in words if times[w][0] for e in [f" {w} ", *(" " + w[:k] for k in range(3, min(len(w), 14) + 1))]}
    under = {e: [w for w in words if covers(e, w) and (times[w][0] or not e.endswith(" "))] for e in candidates}

    def tally(e, taken):
        return [sum(times[w][k] for w in under[e] if w not in taken) for k in (0, 1)]

    def worth(a, b):
        expected = (a + b) * bad / (bad + clean)
        if a < support or a / bad < ratio * (b + 0.5) / clean:
            return 0.0
        return a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0)

    entries, taken = {}, set()
    for first, e in sorted(((worth(*tally(e, set())), e) for e in candidates), reverse=True):
        a, b = tally(e, taken)
        if first >= gain and worth(a, b) >= gain:
            entries[e] = math.log((a / bad) / ((b + 0.5) / clean))
            taken |= set(under[e])
    pairs = {}
    for f, y in zip(folded, toxic, strict=True):
        row = f.split()
        for p in {f" {u} {v} " for u, v in zip(row, row[1:], strict=False) if u in taken or v in taken}:
            pairs.setdefault(p, [0, 0])[0 if y else 1] += 1
    every = {f" {w} ": times[w] for w in taken} | pairs
    exceptions = {p for p, (a, b) in every.items() if b >= 8 and a / bad < 1.2 * b / clean}
    return entries, exceptions


def corpus(seed):
    rng = random.Random(seed)
    common = ["road", "river", "stupefy", "class", "assess", "house", "market", "plan", "winter", "idiotic"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(common) for _ in range(rng.randint(2, 25))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["stupid", "stupidly", "Stüpid", "1d1ot", "idiots", "ass"]))
        elif rng.random() < 0.25:
            words += rng.choice([["stupid", "mistake"], ["ass", "ess"], ["idiots"]])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_learned_entries_and_exceptions_against_plain_counts():
    some = 0
    for seed in range(4):
        texts, labels = corpus(seed)
        made = toxicity.learn(texts, labels, gain=8.0)
        entries, exceptions = plain_entries([toxicity.fold(t) for t in texts], labels, 8.0, 3.0, 4)
        assert made.entries.keys() == entries.keys() and all(abs(made.entries[e] - w) < 1e-12 for e, w in entries.items())
        assert made.exceptions == exceptions
        some += len(entries) + len(exceptions)
    assert some > 8


def test_scores_are_logistic_in_hits_and_length():
    texts, labels = corpus(1)
    made = toxicity.learn(texts, labels, gain=8.0)
    for text in [*texts[:80], "", "stupid", "stupid mistake", "x " * 300 + "stupid"]:
        folded = toxicity.fold(text)
        words, spans = folded.split(), []
        at = 0
        for w in words:
            at = folded.index(f" {w} ", at)
            spans.append((at, w))
            at += 1
        hits = {}
        for start, w in spans:
            for e, weight in made.entries.items():
                end = start + len(e)
                inside = any(folded.startswith(x, s) and s <= start and s + len(x) >= end for x in made.exceptions for s in range(max(0, start - len(x)), start + 1))
                if covers(e, w) and not inside:
                    hits[w] = max(weight, hits.get(w, 0.0))
        n, total = len(words), sum(hits.values())
        z = made.scale[0] + made.scale[1] * math.log1p(total) + made.scale[2] * total / math.sqrt(n + 25.0) + made.scale[3] * max(hits.values(), default=0.0)
        assert abs(made.score(folded) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9, text
