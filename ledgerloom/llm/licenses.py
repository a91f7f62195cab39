"""Licence texts and notices found by matching marked-up templates.

A template is the mandatory wording with ``[[optional regions]]`` (they nest) and
``{{replaceable:n}}`` regions of up to n words (``{{name|pattern}}`` limits each
word). It compiles to an automaton over words; a text matches where the automaton
accepts a run of its words: all mandatory wording in order and nothing between
but what the regions allow. Case, punctuation and white space don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, exact_ids, ids, table

#: Bytes of words: digits, letters and all above ASCII; others part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Phrases and labels of the base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licences and notices, with regions that may be left out or replaced.
_AS_IS_BSD = """
this software is provided by {{owner:12}} as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall {{owner:12}} be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[{{number:1|[1a]}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[{{number:1|[2b]}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
TEMPLATES = {
    # Whole licences: every mandatory word must stand.
    "mit": [
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and [[noninfringement|non infringement]] in no event shall {{owner:12}} be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
    ],
    "isc": [
        """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and {{owner:12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall {{owner:12}} be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
arising out of or in connection with the use or performance of this software"""
    ],
    "bsd-2-clause": [_BSD_2 + _AS_IS_BSD],
    "bsd-3-clause": [
        _BSD_2
        + """ [[{{number:1|[3c]}}]] neither the name of {{owner:12}} nor the names of [[its|any|the]] [[other]] contributors may be used
to endorse or promote products derived from this software without specific prior written permission"""
        + _AS_IS_BSD
    ],
    "apache-2.0": [
        """licensed under the apache license version 2.0 the license you may not use [[this file|{{work:4}}]] except in compliance with the license
you may obtain a copy of the license at [[http|https]] [[www]] apache org licenses license 2.0 [[txt]]
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""
    ],
    "gpl-3.0-or-later": [
        """{{program:6}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version 3 of the license or at your option any later version {{program:6}} is distributed in the hope that it will be useful
but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
    ],
    # Notices of one line, under labels of their own.
    "apache-2.0-notice": [
        "licensed under [[the terms of]] the apache license [[,]] version 2.0",
        "licensed under [[the terms of]] apache [[license]] [[version]] 2.0",
    ],
    "mit-notice": ["[[released|licensed|distributed|available]] under [[the terms of]] the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this {{subject:4}} and associated documentation files"],
    "gpl-3.0-notice": [
        "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        "licensed under [[the terms of]] the [[gnu]] gpl [[version|v]] 3",
    ],
    "gpl-2.0-notice": ["licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2"],
    "lgpl-notice": [f"licensed under [[the terms of]] the gnu {kind} general public license [[version {{{{number:2|[0-9]+}}}}]]" for kind in ("lesser", "library")],
    "cc-by-nc-4.0": ["[[licensed|available|released]] under [[a|the]] [[creative commons]] cc by nc 4.0 [[international]] [[license]]"],
    "cc-by-sa-4.0": ["[[licensed|available|released]] under [[a|the]] [[creative commons]] cc by sa 4.0 [[international]] [[license]]"],
    "cc-by-4.0": [
        "[[licensed|available|released]] under [[a|the]] [[creative commons]] cc by 4.0 [[international]] [[license]]",
        "licensed under [[a|the]] creative commons attribution 4.0 [[international]] [[license]]",
    ],
    "cc0": ["[[licensed|released]] under [[the]] [[creative commons]] cc0 [[1.0]] [[universal]]", "dedicated to the public domain [[under cc0]]"],
    "bsd-notice": ["under [[the terms of]] [[a|the]] [[{{clauses:1|[0-9]}} clause|new|modified|simplified]] bsd license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc-notice": ["under [[the terms of]] the isc license"],
    "isc-grant": ["permission to use copy modify and [[or]] distribute this {{subject:2}} for any purpose with or without fee is hereby granted"],
    "mpl-2.0-notice": ["subject to the terms of the mozilla public license v 2.0", "under [[the terms of]] the mozilla public license [[version]] 2.0"],
    "copyright": ["copyright [[c]] {{year:2|[0-9][0-9][0-9][0-9]}} {{holder:6}} all rights reserved"],
}


def words_of(text: str | bytes) -> list[bytes]:
    """Lower-cased words."""
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


@dataclass
class Automaton:
    """States with word moves: on a given word, or on any word that a pattern allows; and moves without a word."""

    word: list[dict[bytes, int]] = field(default_factory=list)
    any: list[list[tuple[re.Pattern | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    final: int = 0
    mandatory: int = 0

    def state(self) -> int:
        self.word.append({})
        self.any.append([])
        self.free.append([])
        return len(self.word) - 1

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest run of words from ``start`` that is accepted, or -1."""
        states, at, end = self.close({0}), start, -1
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            w, after = words[at], set()
            for s in states:
                if (t := self.word[s].get(w)) is not None:
                    after.add(t)
                for allowed, t in self.any[s]:
                    if allowed is None or allowed.fullmatch(w):
                        after.add(t)
            states, at = self.close(after), at + 1
        return end


def _parts(markup: str) -> list:
    """Nested lists: words, ("var", n, pattern), ("opt", [alternatives])."""
    tokens = re.findall(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\[\]{}|]+", markup)
    at = 0

    def sequence() -> list:
        nonlocal at
        alternatives: list[list] = [[]]
        while at < len(tokens) and tokens[at] != "]]":
            t = tokens[at]
            at += 1
            if t == "[[":
                alternatives[-1].append(("opt", sequence()))
                at += 1
            elif t == "|":
                alternatives.append([])
            elif t.startswith("{{"):
                _, n, pattern = re.fullmatch(r"\{\{(\w+):(\d+)(?:\|(.*))?\}\}", t).groups()
                alternatives[-1].append(("var", int(n), re.compile(pattern.encode()) if pattern else None))
            else:
                alternatives[-1] += words_of(t)
        return alternatives

    return sequence()


def compile_template(markup: str) -> Automaton:
    """The automaton of one template."""
    m = Automaton()

    def chain(parts: list, at: int, counted: bool) -> int:
        for p in parts:
            to = m.state()
            if isinstance(p, bytes):
                if m.word[at]:
                    m.free[at].append(at := m.state())
                m.word[at][p] = to
                m.mandatory += counted
            elif p[0] == "opt":
                m.free[at].append(to)
                for alternative in p[1]:
                    first = m.state()
                    m.free[at].append(first)
                    m.free[chain(alternative, first, False)].append(to)
            else:
                last = at
                for _ in range(p[1]):
                    after = m.state()
                    m.any[last].append((p[2], after))
                    m.free[after].append(to)
                    last = after
            at = to
        return at

    m.final = chain(_parts(markup)[0], m.state(), True)
    return m


def _widest(parts: list) -> int:
    """The most words that ``parts`` can take."""
    return sum(1 if isinstance(p, bytes) else p[1] if p[0] == "var" else max(map(_widest, p[1])) for p in parts)


class Templates:
    """Compiled templates; each is tried only where its longest mandatory run of words stands, from as far before it as the template can reach."""

    def __init__(self, templates: dict[str, list[str]]):
        self.all = []
        for label, markups in templates.items():
            for markup in markups:
                runs, run, reach = [], [], 0
                for p in [*_parts(markup)[0], None]:
                    if isinstance(p, bytes):
                        run.append(p)
                        continue
                    if run:
                        runs.append((run, reach))
                        reach += len(run)
                        run = []
                    reach += _widest([p]) if p else 0
                run, reach = max(runs, key=lambda x: len(x[0]))
                self.all.append((label, compile_template(markup), b" " + b" ".join(run) + b" ", reach))

    def find(self, words: list[bytes], line: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, end) of every match. ``line``: the words between single blanks."""
        out = []
        for label, automaton, anchor, reach in self.all:
            if anchor not in line:
                continue
            done = -1
            for place in _places(line, anchor):
                for start in range(max(done, place - reach, 0), place + 1):
                    if (end := automaton.match(words, start)) > place:
                        out.append((label, start, end))
                        done = end
                        break
        return out


def _places(line: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which ``phrase`` (between blanks) stands in ``line``."""
    out, at, counted, number = [], line.find(phrase), 0, 0
    while at >= 0:
        number += line.count(b" ", counted, at)
        counted = at
        out.append(number)
        at = line.find(phrase, at + 1)
    return out


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scan(templates: dict[str, list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Templates(templates)
        base = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(ids(batch).tolist(), batch["text"], strict=True):
                words = words_of(text)
                line = b" " + b" ".join(words) + b" "
                places = [(n, label) for phrase, label in base if phrase in line for n in _places(line, phrase)]
                found = compiled.find(words, line)
                starts, names = [n for n, _ in places], {label for _, label in places}
                score = 1.0 if found else 0.5 if places else 0.0
                spans = ",".join(f"{label}:{a}:{b}" for label, a, b in sorted(found, key=lambda x: x[1:]))
                rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x[0] for x in found})), score, spans))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return run


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: base phrases (count, places, labels), labels of all matches, score and spans in words.

    ``score``: 1 where a whole template matches, 0.5 where only a base phrase stands, else 0.
    Null and empty texts have no words and no labels. Repeated rows and null ids
    pass. Empty table: no rows. Other columns are not read.
    """
    return exact_ids(documents(docs, "doc_id", "text")).mapInPandas(_scan(templates or TEMPLATES), COLUMNS)


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wording in all ``documents``."""
    return licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The same in SQL: every template as one regular expression over the words between blanks."""

    def regex(parts: list) -> str:
        out = ""
        for p in parts:
            if isinstance(p, bytes):
                out += re.escape(p.decode()) + " "
            elif p[0] == "opt":
                out += "(?:" + "|".join(regex(a) for a in p[1]) + ")?"
            else:
                out += f"(?:{p[2].pattern.decode() if p[2] else '[^ ]+'} ){{1,{p[1]}}}"
        return out

    cases = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(line, ' {regex(_parts(x)[0])}')" for x in markups)} THEN '{label}' END" for label, markups in TEMPLATES.items())
    starts = ", ".join(f"list_transform(list_filter(range(1, n_words + 1), lambda i: words[i:i + {len(p.split()) - 1}] = [{', '.join(repr(w) for w in p.split())}]), lambda i: {{'n': i - 1, 'label': '{label}'}})" for p, label in BASE.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
l AS (SELECT doc_id, words, len(words)::BIGINT AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
m AS (SELECT doc_id, n_words, flatten([{starts}]) AS base, list_filter([{cases}], lambda x: x IS NOT NULL) AS found FROM l)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(list_transform(base, lambda x: x.n))::BIGINT AS first_word, list_max(list_transform(base, lambda x: x.n))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label) || found)), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM m
"""


SQL = _sql()
