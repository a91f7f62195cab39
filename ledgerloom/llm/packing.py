"""Best-fit packing of tokenised documents, bulk-synchronous.

Lengths and gaps are whole numbers up to the capacity, so the range-sorted lists of
documents and of gaps are kept as runs: documents of one length with successive
ranks, sequences of one gap with successive numbers. Runs don't grow in number with
the corpus; documents learn their rank by distributed prefix sums over (length, block).

A superstep deals both lists, sorted by size, to ranges of equally many runs. Every range sweeps its runs from large
to small: a run of documents takes the successor among the gaps met so far, the
smallest that holds it, as many of its documents as fit into each sequence. Who
gets which gap is resolved by rank (the k-th document of the run gets the k-th place).
What finds no gap in its range goes on to a merge of what all ranges have left over,
swept the same way; gaps are updated; documents larger than every gap open new
sequences, as few as could hold them, by the largest. Then the next superstep. In
each, only documents longer than half the longest one left take part, so that small
ones take no place that a larger one could still fill.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, exact_ids, ids, table, written

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of a text as unsigned 32-bit integers, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    So strings of special tokens become these tokens. Where the vocabulary also lies beside
    ``path`` as ranks (the same ids), the faster coder of ranks gives those of texts without such
    strings, unless it gives up (it does on very long runs of white space). The tests hold both against each other.
    """

    def __init__(self, path: str):
        self.path, self.coder, self.ranked = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranked = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranked):
            import public_tokenizers
            import tiktoken

            with open(ranked, "rb") as f:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
            coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ranked = lambda text: coder.encode_to_numpy(text, disallowed_special=())

    def plain(self, text: str) -> np.ndarray:
        if self.coder is None:  # most workers never need it
            from tokenizers import Tokenizer

            self.coder = Tokenizer.from_file(self.path)
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked and not any(s in text for s in self.special):
            try:
                return self.ranked(text).astype("<u4", copy=False)
            except ValueError:
                pass
        return self.plain(text).astype("<u4", copy=False)


def _pieces(capacity: int, end_id: int, path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        code, block, seen = Ids(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(ids(batch).tolist(), batch["text"], strict=True):
                own = np.append(code(text), np.array([end_id], "<u4")).astype("<u4").data
                n = len(own)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    seen[b - a] = nth = seen.get(b - a, -1) + 1
                    rows.append((doc_id, k, a, b - a, zlib.crc32(own[a:b]), block, nth))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), piece=out["piece"].astype("int32"), block=out["block"].astype("int32"))

    return run


#: Kinds of runs: sequences with a gap, documents with a length, documents placed, and the number of sequences opened.
GAP, PIECE, PLACED, OPENED = range(4)
RUNS = "kind int, size long, first long, n long, sequence long, each long, offset long, live boolean, range int"
RANGES, STEPS_AT_ONCE, SMALL = 8, 4, 64


def sweep(gaps: list[tuple], pieces: list[tuple], capacity: int) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """Runs (size, first, n) of gaps and of documents: what is placed (length, rank, n, sequence, each, offset), gaps updated, gaps not taken, and documents not placed.

    From large to small, a gap before a document of its size: the gap met last is the smallest that holds the document.
    """
    placed, updated, left, held = [], [], [], []
    for minus, _, first, n in sorted([(-s, GAP, f, n) for s, f, n in gaps] + [(-s, PIECE, f, n) for s, f, n in pieces]):
        if _ == GAP:
            held.append((-minus, first, n))
            continue
        size = -minus
        while n and held:
            gap, start, m = held.pop()
            fit = gap // size
            full = min(m, n // fit)
            some = [(start, full, fit)] if full else []
            if full < m and n > full * fit:
                some.append((start + full, 1, n - full * fit))
            for sequence, run, each in some:
                placed.append((size, first, run * each, sequence, each, capacity - gap))
                first, n = first + run * each, n - run * each
                if gap - each * size:
                    updated.append((gap - each * size, sequence, run))
            used = sum(run for _, run, _ in some)
            if used < m:
                held.append((gap, start + used, m - used))
        if n:
            left.append((size, first, n))
    return placed, updated, held, left


def _rows(kind: int, runs: list[tuple], live: bool) -> list[tuple]:
    return [(kind, size, first, n, 0, 0, 0, live) for size, first, n in runs]


def _placed(placed: list[tuple]) -> list[tuple]:
    return [(PLACED, size, first, n, sequence, each, offset, False) for size, first, n, sequence, each, offset in placed]


def _split(batches: Iterator[pd.DataFrame]) -> tuple[dict[int, list[tuple]], list[tuple]]:
    """Runs that take part in the sweep, by kind, and all other rows as they are."""
    live, rest = {GAP: [], PIECE: []}, []
    for batch in batches:
        for row in batch[[c.split()[0] for c in RUNS.split(", ")]].itertuples(index=False, name=None):
            (live[row[0]].append(row[1:4]) if row[7] else rest.append(row[:8]))
    return live, rest


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows with their range in the next superstep: sorted by size, in as many ranges of equally many rows, those that take part apart from all others."""
    rows = sorted(rows, key=lambda r: (r[7], r[1]))
    first = sum(not r[7] for r in rows)
    ranges = [i * RANGES // max(first, 1) if i < first else (i - first) * RANGES // (len(rows) - first) for i in range(len(rows))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")][:8]).astype({"live": bool}).assign(range=np.array(ranges, np.int32))


def _sweep_range(capacity: int):
    """The sweep of one range; what it leaves over stays live."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live, rest = _split(batches)
        placed, updated, free, left = sweep(live[GAP], live[PIECE], capacity)
        yield _frame(rest + _placed(placed) + _rows(GAP, updated, False) + _rows(GAP, free, True) + _rows(PIECE, left, True))

    return run


def opened(waiting: list[tuple], capacity: int, number: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Of documents (runs from long to short) that fit no gap: those that open sequences, from ``number`` on, placed; their gaps; and those that wait on."""
    some = max(sum(n for size, _, n in waiting if 2 * size > capacity), -(-sum(size * n for size, _, n in waiting) // capacity))
    placed, gaps, left = [], [], []
    for size, first, n in waiting:
        m = min(n, some)
        some -= m
        if m:
            placed.append((size, first, m, number, 1, 0))
            if size < capacity:
                gaps.append((capacity - size, number, m))
            number += m
        if m < n:
            left.append((size, first + m, n - m))
    return placed, gaps, left


def _merge_ranges(capacity: int):
    """The sweep of what the ranges have left over, new sequences, and who takes part in the next superstep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live, rest = _split(batches)
        if not live[GAP] and not live[PIECE] and not rest:
            return
        placed, updated, free, left = sweep(live[GAP], live[PIECE], capacity)
        gaps = [r[1:4] for r in rest if r[0] == GAP] + updated + free
        waiting = [r[1:4] for r in rest if r[0] == PIECE]
        number, top = sum(r[3] for r in rest if r[0] == OPENED), max((g for g, _, _ in gaps), default=0)
        more, new, on = opened(sorted((x for x in left if x[0] > top), reverse=True), capacity, number)
        waiting += on + [x for x in left if x[0] <= top]
        longest = max((size for size, _, _ in waiting), default=0)
        floor = longest // 2 if longest > SMALL else 0
        out = [r for r in rest if r[0] == PLACED] + _placed(placed + more) + [(OPENED, 0, 0, number + sum(n for _, _, n in new) + sum(x[2] for x in more if x[0] == capacity), 0, 0, 0, False)]
        for kind, runs in ((GAP, gaps + new), (PIECE, waiting)):
            for x in runs:
                out += _rows(kind, [x], x[0] > floor)
        yield _frame(out)

    return run


def superstep(runs: DataFrame, capacity: int) -> DataFrame:
    """Runs after one more superstep: ranges swept in parallel, then what they leave over."""
    swept = runs.repartition(RANGES, "range").coalesce(RANGES).mapInPandas(_sweep_range(capacity), RUNS)
    return swept.repartition(1).mapInPandas(_merge_ranges(capacity), RUNS)


def supersteps(counts: DataFrame, capacity: int) -> DataFrame:
    """From (length, n): runs of documents placed, after as many supersteps as it takes.

    Written after ``STEPS_AT_ONCE`` supersteps. A single task merges the ranges: some
    thousand runs at most, of which no number grows with the corpus.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("sequence", "each", "offset")]
    runs = counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n", *zero, F.lit(False).alias("live"), F.lit(0).alias("range"))
    done = []
    while True:
        for _ in range(STEPS_AT_ONCE):
            runs = superstep(runs, capacity)
        runs = written(runs, "pack-runs")
        done.append(runs.where(F.col("kind") == PLACED))
        runs = runs.where(F.col("kind") != PLACED)
        if runs.where(F.col("kind") == PIECE).isEmpty():
            return reduce(DataFrame.union, done)


def _places(steps: list[tuple]):
    by = {}
    for length, *rest in sorted(steps):
        by.setdefault(length, []).append(rest)
    by = {k: np.array(v, dtype=np.int64) for k, v in by.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(own):
                    continue
                plan, length = by[int(lengths[own[0]])], lengths[own[0]]
                step = plan[np.searchsorted(plan[:, 0], ranks[own], "right") - 1]
                inside = ranks[own] - step[:, 0]
                sequence[own] = step[:, 2] + inside // step[:, 3]
                offset[own] = step[:, 4] + inside % step[:, 3] * length
            yield batch.assign(doc_id=ids(batch), sequence_id=sequence, offset=offset)[[c.split()[0] for c in PLACES.split(", ")]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut so that
    only its first piece can be shorter. Null and empty texts are ``end_id`` alone.
    Repeated rows and rows with the same or a null doc_id are separate documents.
    Empty table: no rows. Other columns are not read. ``path``: the vocabulary file.
    """
    pieces = written(exact_ids(documents(docs, "doc_id", "text")).mapInPandas(_pieces(capacity, end_id, path or vocabulary_path()), PIECES), "pack-pieces")
    sums = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    placed = supersteps(sums.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    steps = [tuple(r) for r in placed.select("size", "first", "n", "sequence", "each", "offset").collect()]  # runs, not documents
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).drop("n")
    ranked = pieces.join(sums, ["length", "block"]).withColumn("rank", F.col("before") + F.col("nth"))
    return exact_ids(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")).mapInPandas(_places(steps), PLACES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
