"""Keywords of many topics in a text, by its words: what a task does with the dictionary it is handed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that make more of a regular expression than its own text, and those that reach beyond the character before them.
SIGN, FAR = r"\\^$.|?*+()\[\]{}", r"[\\|()\[\]{}]"
#: Characters by which a keyword that may match part of a word is looked up.
HEAD = 6
# How many bits and words are remembered, and how long such a word may be.
_BITS, _WORDS, _LONG = 200_000_000, 200_000, 64
_NOTHING = 0, 0, 0


class _Memo(dict):
    """A bounded memory of a function of one word."""

    def __init__(self, made: Callable[[str], tuple[int, int, int]], most: int):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= self.most:
            self.clear()
        value = self.made(word)
        if len(word) <= _LONG:
            self[word] = value
        return value


def _alike(keyword: str, word: str) -> bool:
    """Whether the two agree as far as both go; a dot is any character but a line end."""
    return all(a == b or (a == "." and b != "\n") for a, b in zip(keyword, word, strict=False))


class TopicSearch:
    """Finds the keywords of topics in texts, by the rule of ``operators.topics.patterns``: those of a topic stand between blanks, its last one behind a blank.

    Topics are bits of whole numbers, so a step along a text's words takes all of them. A keyword of one word, with or without dots, is settled by the
    words alone: it uses up the blank behind it, so the next word can't match; a plain last one doesn't. Of any other keyword its first
    word tells that it may match there, and only then the topic's pattern is tried.
    """

    def __init__(self, lists: list[list[str]]):
        self.lists, self.tried = lists, {}
        # Topics by plain keyword; of all other keywords, by their beginning, also the part that a word must meet and what that tells.
        self.whole: dict[str, list[int]] = {}
        self.begun: dict[str, list[tuple[int, str, str]]] = {}
        self.anywhere = self.empty = 0
        for t, keywords in enumerate(lists):
            self.empty |= (not keywords) << t
            for place, k in enumerate(keywords):
                last, beginning = place == len(keywords) - 1, re.match(rf"(?:[^ {SIGN}](?![*?{{]))*", k).group()[:HEAD]
                plain, dots, word = not re.search(f"[ {SIGN}]", k), not re.search(f"[{SIGN}]", k.replace(".", "")), k.split(" ")[0]
                if not beginning or re.search(FAR, k):
                    self.anywhere |= 1 << t
                elif plain and not last:
                    self.whole.setdefault(k, []).append(t)
                else:
                    # What the last keyword finds must be none of what the others find, to be counted by itself.
                    apart = plain and not any(len(o) == len(k) and _alike(o, k) for o in keywords[:place])
                    kind = "last" if last and apart else "first" if dots and word != k else "whole" if dots and not last else "open"
                    self.begun.setdefault(beginning, []).append((t, word if kind == "first" else k, kind))
        self.sizes = sorted({len(b) for b in self.begun})
        # By what stands behind the word: nothing, a blank, perhaps two blanks.
        self.reached = [_Memo(partial(self._reach, blanks), min(_WORDS, _BITS // (len(lists) + 1))) for blanks in range(3)]

    def _reach(self, blanks: int, word: str) -> tuple[int, int, int]:
        """The topics of which the word is a keyword, those whose last keyword it begins with, and those of which only the pattern can tell."""
        whole = last = unsure = 0
        if blanks:
            for t in self.whole.get(word, ()):
                whole |= 1 << t
        for n in self.sizes:
            if n > len(word):
                break
            for t, k, kind in self.begun.get(word[:n], ()):
                if kind == "last":
                    if word.startswith(k):
                        last |= 1 << t
                elif kind == "open":
                    unsure |= 1 << t
                elif blanks and len(k) >= len(word) and _alike(k, word):
                    more = len(k) - len(word)
                    if not more and kind == "whole":
                        whole |= 1 << t
                    # A dot may stand for the blank behind the word; if nothing more follows, another blank must.
                    elif not more or (k[len(word)] == "." and blanks > (more == 1)):
                        unsure |= 1 << t
        return (whole, last, unsure) if whole or last or unsure else _NOTHING

    def _by_pattern(self, t: int, text: str) -> list[str]:
        if t not in self.tried:
            *others, last = self.lists[t]
            self.tried[t] = re.compile("|".join([*(f" {k} " for k in others), f" {last}"]))
        return sorted({m.group().strip(" ") for m in self.tried[t].finditer(text)})

    def best(self, text: str | None) -> tuple[int, int | None, list[str]]:
        """How many topics have a keyword in the text; the first of those with the most distinct ones, and these, sorted."""
        if text is None:
            return 0, None, []
        words = text.split(" ")
        found, used, ended, unsure = {}, 0, 0, self.anywhere
        if len(words) > 1:
            ended, reached = self.empty, self.reached[2 if "  " in text else 1]
            met = [reached[w] for w in words[1:-1]]
            met.append(self.reached[0][words[-1]])
            for word, (whole, last, open_) in zip(words[1:], met, strict=True):
                if open_:
                    unsure |= open_
                if last:
                    ended |= last & ~used & ~whole
                # Most steps find nothing used up, or nothing at all: whole numbers of many bits are left alone then.
                used = whole & ~used if used and whole else whole
                if used:
                    found[word] = found[word] | used if word in found else used
        # How many keywords each topic has, as whole numbers of which the i-th holds the i-th bits of all topics' counts.
        sure, counts = ~unsure, [ended & ~unsure]
        for more in found.values():
            if unsure:
                more &= sure
            for i, bits in enumerate(counts):
                counts[i] = bits ^ more
                more &= bits
                if not more:
                    break
            else:
                counts.append(more)
        first = most = 0
        for bits in counts:
            first |= bits
        n = first.bit_count()
        for i in reversed(range(len(counts))):
            if first & counts[i]:
                first, most = first & counts[i], most | 1 << i
        top, texts = None, []
        if first:
            top = (first & -first).bit_length() - 1
            texts = [w for w, topics in found.items() if topics >> top & 1]
            if ended >> top & 1:
                texts.append(self.lists[top][-1] if self.lists[top] else "")
            texts.sort()
        while unsure:
            t = (unsure & -unsure).bit_length() - 1
            unsure &= unsure - 1
            tried = self._by_pattern(t, text)
            n += bool(tried)
            if tried and (top is None or (-len(tried), t) < (-most, top)):
                top, most, texts = t, len(tried), tried
        return n, top, texts


def topic_finder(topics: list[tuple[str, list[str]]]) -> Callable[[Column], Column]:
    """From a text to ``ntopics``, ``topic`` and ``words``, as ``TopicSearch`` finds them; topics in dictionary order. The tasks are handed the dictionary once."""
    names, lists = [t for t, _ in topics], [ks for _, ks in topics]

    @F.arrow_udf("ntopics int, topic string, words array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = TopicSearch(lists)
        for batch in batches:
            found = [search.best(text) for text in batch.to_pylist()]
            columns = pa.array([n for n, _, _ in found], pa.int32()), pa.array([None if t is None else names[t] for _, t, _ in found], pa.string()), pa.array([ws for _, _, ws in found], pa.list_(pa.string()))
            yield pa.StructArray.from_arrays(columns, ["ntopics", "topic", "words"])

    return find
