"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words with single blanks between and an end symbol. Each
byte is eight binary decisions; a decision's contexts are the bits of the byte so far
and the last 0 to ``DEPTH`` bytes. Every context keeps a Krichevsky-Trofimov estimate
of its decisions in the training texts; every node weighs its own estimate against
the product of its children's by the probabilities they give to the training texts, so
that a prediction mixes the estimates of all depths. A context that training never saw
has no estimate: mixing then begins at the deepest one that it saw.

Counts are gathered over all documents: each unit of rows sends every distinct (context,
byte) once, a shuffle adds them up, and trees are weighed in parallel below the last two
bytes; a tree that holds over a ``SHARE``-th of all keys is dealt by one byte more, and so
on. The nodes above what is dealt are added up and handed to all: those of one byte and
none, 65,535, and of every further byte 255 of ``SHARE`` contexts, at most, however large
the corpus. Each unit gets back the code length of its own (context, byte) pairs. Word
counts of the base model travel with them. No table that grows with the corpus is
broadcast or collected. A unit is a run of rows of a file, by their numbers there, so
it doesn't matter how a read splits the files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, on_files, parts, table, written
from .hashing import Lookup, word_hashes

DEPTH = 5
#: Rows of a file that form a unit, bytes that are looked at together, and rows that leave a worker together.
UNIT_ROWS, CHUNK_BYTES, FRAME_ROWS = 8192, 1 << 18, 1 << 16
#: Never a byte of UTF-8: stands before and after every text.
END = b"\xff"
#: Bytes of context by which trees are dealt at least, and the share of all keys (one in so many) above which a tree is split by one more.
SPLIT, SHARE = 2, 1024

LN2 = math.log(2)


def normal(text: str) -> bytes:
    """The words between single blanks, A-Z lower-cased."""
    return b" ".join(text.encode().lower().split())


def context_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of each text: its ``depth`` bytes of context, the last byte highest, and itself, in one number."""
    pad = END * depth
    joined = b"".join(pad + t + END for t in texts) + END * 8
    n = len(joined) - 8
    window = np.ndarray((n - depth,), "<u8", joined, 0, (1,)) & np.uint64((1 << (8 * depth)) - 1)
    keys = (window << np.uint64(8)) | np.frombuffer(joined, np.uint8)[depth:n].astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + depth)))[:-1]
    text = np.ones(n, bool)
    text[(starts[:, None] + np.arange(depth)).ravel()] = False
    return keys[text[depth:]].astype(np.int64), lengths


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A negative number for each word (two words share one of the 2**63 with a probability of nothing), and the words of each text."""
    words, counts = word_hashes(texts)
    return (words | np.uint64(1 << 63)).view(np.int64), counts


def _sum(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _gather(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, texts, flags, held, sums = None, [], [], 0, []

        def chunk() -> None:
            nonlocal texts, flags, held
            for trained in (True, False):
                own = [t for t, f in zip(texts, flags, strict=True) if f is trained]
                if own:
                    for keys in (context_keys(own, depth)[0], word_keys(own)[0]):
                        k, n = _sum(keys)
                        sums.append((k, n if trained else np.zeros_like(n)))
            texts, flags, held = [], [], 0
            if sums and sum(len(k) for k, _ in sums[1:]) > max(1 << 18, len(sums[0][0]) // 2):
                sums[:] = [_sum(np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums]))]

        def flush() -> Iterator[pd.DataFrame]:
            chunk()
            k, n = _sum(np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums])) if sums else (np.zeros(0, np.int64),) * 2
            sums.clear()
            for at in range(0, len(k), FRAME_ROWS):
                own = slice(at, at + FRAME_ROWS)
                yield pd.DataFrame({"key": k[own], "unit": np.full(len(k[own]), unit, np.int64), "n": n[own]})

        for batch in batches:
            for at, trained, text in zip(batch["unit"].tolist(), batch["trained"].tolist(), batch["text"], strict=True):
                if at != unit:
                    if unit is not None:
                        yield from flush()
                    unit = at
                texts.append(normal(text))
                flags.append(bool(trained))
                held += len(texts[-1]) + 1
                if held >= CHUNK_BYTES:
                    chunk()
        yield from flush()

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers, by Stirling's series eight steps up."""
    y = x + 8
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)


class Level:
    """Nodes of one depth and bit, by number: the context bytes and the bits of the byte so far."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.nodes, self.zeros, self.ones = nodes, zeros.astype(np.float64), ones.astype(np.float64)
        self.own = log_kt(self.zeros, self.ones)
        self.below: np.ndarray | None = None  # sum of the children's weighted ln probabilities
        self.weighted = self.own

    def weigh(self, below: np.ndarray) -> None:
        self.below = below
        self.weighted = np.logaddexp(self.own, below) - LN2

    def find(self, nodes: np.ndarray) -> np.ndarray:
        """Where each node is, or -1."""
        if not len(self.nodes):
            return np.full(len(nodes), -1)
        at = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        return np.where(self.nodes[at] == nodes, at, -1)


def _at(keys: np.ndarray, depth: int, d: int, bit: int) -> np.ndarray:
    """The node number of each key at context length ``d`` before decision ``bit``."""
    return ((keys >> (8 * (depth - d + 1))) << bit) | ((keys & 255) >> (8 - bit))


def _parent(nodes: np.ndarray, bit: int) -> np.ndarray:
    return ((nodes >> (bit + 8)) << bit) | (nodes & ((1 << bit) - 1))


def level(keys: np.ndarray, counts: np.ndarray, depth: int, d: int, bit: int) -> Level:
    """Counts of one depth and bit from keys with counts."""
    one = ((keys >> (7 - bit)) & 1).astype(np.int64) * counts
    both, total = _at(keys, depth, d, bit), counts
    order = np.argsort(both, kind="stable")
    both, one, total = both[order], one[order], total[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    ones, every = (np.add.reduceat(x, first) if len(first) else x for x in (one, total))
    return Level(both[first], every - ones, ones)


def add_below(child: Level, parent: Level, bit: int) -> None:
    """Weighs ``parent`` by its children; those that it doesn't hold are left to whoever holds theirs."""
    at = parent.find(_parent(child.nodes, bit))
    parent.weigh(np.bincount(at[at >= 0], child.weighted[at >= 0], len(parent.nodes)))


def levels(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, depth: int, bit: int) -> dict[int, Level]:
    """Weighed nodes of one bit at all depths, of each key from its cut down."""
    seen = counts > 0
    keys, counts, cuts = keys[seen], counts[seen], cuts[seen]
    out = {d: level(keys[cuts <= d], counts[cuts <= d], depth, d, bit) for d in range(depth, SPLIT - 1, -1)}
    for d in range(depth - 1, SPLIT - 1, -1):
        add_below(out[d + 1], out[d], bit)
    return out


def log_probability(keys: np.ndarray, found: dict[int, list[Level]], depth: int, bit: int) -> np.ndarray:
    """log10 of each key's decision ``bit``, mixed over the depths in ``found``."""
    one = ((keys >> (7 - bit)) & 1).astype(bool)
    p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
    for d in sorted(found, reverse=True):
        for nodes in found[d]:
            at = nodes.find(_at(keys, depth, d, bit))
            hit = at >= 0
            if not hit.any():
                continue
            i = at[hit]
            own = (np.where(one[hit], nodes.ones[i], nodes.zeros[i]) + 0.5) / (nodes.zeros[i] + nodes.ones[i] + 1)
            if nodes.below is not None:
                stop = 1 / (1 + np.exp(np.clip(nodes.below[i] - nodes.own[i], -700, 700)))
                own = np.where(known[hit], stop * own + (1 - stop) * p[hit], own)
            p[hit] = own
            known |= hit
    return np.log10(p)


def _partition(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = [tuple(b[c].to_numpy(np.int64) for c in ("key", "n", "cut")) for b in batches]
    return tuple(map(np.concatenate, zip(*own, strict=True))) if own else (np.zeros(0, np.int64),) * 3


def _tops(depth: int):
    """Of every node just above the dealt trees: its counts and what its children in this partition weigh."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, cuts = _partition(batches)
        for bit in range(8):
            own = levels(keys, counts, cuts, depth, bit)
            for d in range(SPLIT, depth + 1):
                up = _parent(own[d].nodes, bit)
                alone = own[d - 1].find(up) < 0 if d > SPLIT else np.ones(len(up), bool)
                nodes, at = np.unique(up[alone], return_inverse=True)
                zeros, ones, below = (np.bincount(at, x[alone], len(nodes)) for x in (own[d].zeros, own[d].ones, own[d].weighted))
                yield pd.DataFrame({"bit": np.full(len(nodes), bit), "depth": np.full(len(nodes), d - 1), "node": nodes, "zeros": zeros, "ones": ones, "below": below})

    return run


def _lengths(depth: int, tops: dict[int, dict[int, Level]]):
    """The log10 probability of every key's byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, cuts = _partition(batches)
        value = np.zeros(len(keys))
        for bit in range(8):
            found = {d: [own] for d, own in levels(keys, counts, cuts, depth, bit).items()}
            for d, own in tops[bit].items():
                found.setdefault(d, []).append(own)
            value += log_probability(keys, found, depth, bit)
        yield pd.DataFrame({"key": keys, "value": value})

    return run


def top_levels(rows: pd.DataFrame) -> dict[int, dict[int, Level]]:
    """Nodes above the dealt trees, by bit and depth, from the sums of all partitions."""
    out: dict[int, dict[int, Level]] = {bit: {} for bit in range(8)}
    for bit in range(8):
        below = None
        for d in range(int(rows["depth"].max()) if len(rows) else 0, -1, -1):
            own = rows[(rows["bit"] == bit) & (rows["depth"] == d)]
            given = [own[c].to_numpy() for c in ("node", "zeros", "ones", "below")]
            if below is not None:  # nodes whose children are above as well
                given = [np.concatenate(x) for x in zip(given, (_parent(below.nodes, bit), below.zeros, below.ones, below.weighted), strict=True)]
            nodes, at = np.unique(given[0].astype(np.int64), return_inverse=True)
            below = Level(nodes, *(np.bincount(at, x, len(nodes)) for x in given[1:3]))
            below.weigh(np.bincount(at, given[3], len(nodes)))
            out[bit][d] = below
    return out


def _context(depth: int, d: int) -> Column:
    return F.shiftright("key", 8 * (depth - d + 1))


def dealt(counts: DataFrame, depth: int, total: int, share: int = SHARE) -> DataFrame:
    """``counts`` (key, n) with ``cut``, the bytes of context by which the key is dealt, and ``tree``, that context.

    ``SPLIT`` bytes, and one more for each context that holds over a ``share``-th of all ``total`` keys.
    """
    cut, same = F.lit(SPLIT), counts
    for d in range(SPLIT, depth):
        found = same.groupBy(_context(depth, d).alias("c")).count().where(F.col("count") > total / share).collect()  # `share` rows at most
        if not found:
            break
        hot = _context(depth, d).isin([r["c"] for r in found])
        cut, same = F.when(hot, F.lit(d + 1)).otherwise(cut) if d == SPLIT else F.when(hot & (cut == d), F.lit(d + 1)).otherwise(cut), same.where(hot)
    return counts.withColumn("cut", cut).withColumn("tree", F.expr(f"shiftright(key, 8 * ({depth + 1} - cut))"))


COLUMNS = "doc_id long, trained boolean, n_words long, n_known long, known double, score double, n_bytes long"


def _score(depth: int):
    """Rows sorted by unit, those with keys and values (no text) before those with texts.

    Of a text the value is 1 if it is learned from, and 2 more if its id is null (a null
    among the ids would turn all of them, and the keys, into floating numbers).
    """

    def look(places: Lookup, value: np.ndarray, own: np.ndarray) -> np.ndarray:
        i = places.find(own)
        if (i < 0).any():
            raise ValueError("a unit of documents has changed between two reads of the table")
        return value[i]

    def rows(texts: list[bytes], ids: pd.Series, trained: pd.Series, places: Lookup, value: np.ndarray) -> pd.DataFrame:
        grams, lengths = context_keys(texts, depth)
        words, counts = word_keys(texts)
        of = np.repeat(np.arange(len(texts)), counts)
        known = look(places, value, words) if len(words) else np.zeros(0)
        return pd.DataFrame(
            {
                "doc_id": ids,
                "trained": trained % 2 > 0,
                "n_words": counts,
                "n_known": np.bincount(of[known > 0], minlength=len(texts)),
                "known": np.bincount(of, known, len(texts)),
                "score": np.add.reduceat(look(places, value, grams), np.concatenate(([0], np.cumsum(lengths)))[:-1]),
                "n_bytes": lengths,
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, keys, values, places, value = None, [], [], None, None
        for batch in batches:
            for number, own in batch.groupby("unit", sort=False):
                if number != unit:
                    unit, keys, values, places, value = number, [], [], None, None
                new = own[own["text"].isna()]
                if len(new):
                    keys.append(new["id"].to_numpy(np.int64))
                    values.append(new["value"].to_numpy())
                docs = own[own["text"].notna()]
                if not len(docs):
                    continue
                if places is None:
                    places, value = Lookup(np.concatenate(keys)), np.concatenate(values)
                    keys, values = [], []
                ids, flags, first = docs["id"].astype("Int64").mask(docs["value"] >= 2), docs["value"], 0
                texts, held = [], 0
                for at, text in enumerate(docs["text"], 1):
                    texts.append(normal(text))
                    held += len(texts[-1])
                    if held >= CHUNK_BYTES or at == len(docs):
                        yield rows(texts, ids.iloc[first:at], flags.iloc[first:at], places, value)
                        texts, held, first = [], 0, at

    return run


def scores(docs: DataFrame, depth: int = DEPTH, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from documents whose crc32(doc_id) mod 7 is not 2 (a null doc_id is learned from).
    Null and empty texts are the end symbol alone. Repeated rows count as often as they stand.
    Without documents to learn from every decision is even. Empty table: no rows. Other columns
    are not read. ``depth``: 2 to 6. ``share`` bears on how trees are dealt, not on the scores.
    """
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2, F.lit(False))
    docs = on_files(docs)
    unit = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / UNIT_ROWS))
    rows = documents(docs, unit.alias("unit"), "doc_id", (~held).alias("trained"), "text")
    n = parts(docs)
    found = written(rows.select("unit", "trained", "text").mapInPandas(_gather(depth), "key long, unit long, n long"), "ctw-found")
    counts = written(found.groupBy("key").agg(F.sum("n").alias("n")), "ctw-counts")
    learned = docs.select("doc_id").where(~held).count()
    word = F.col("key") < 0
    words, types, grams = counts.agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)), F.count_if(word & (F.col("n") > 0)), F.count_if(~word)).first()
    # The end is a token as well, once in every text.
    tokens, types = words + learned, types + (learned > 0)
    trees = dealt(counts.where("key >= 0"), depth, grams, share).repartition(n, "cut", "tree").drop("tree")
    tops = trees.mapInPandas(_tops(depth), "bit int, depth int, node long, zeros double, ones double, below double")
    tops = top_levels(tops.groupBy("bit", "depth", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas())  # 255 * (256 + share * (depth - SPLIT)) rows at most
    values = trees.mapInPandas(_lengths(depth, tops), "key long, value double").union(counts.where("key < 0").select("key", F.log10(F.col("n") + 1.0)))
    back = found.select("key", "unit").join(values, "key").select("unit", F.col("key").alias("id"), "value", F.lit(None).cast("string").alias("text"))
    met = back.union(rows.select("unit", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("trained").cast("double") + F.col("doc_id").isNull().cast("double") * 2, "text")).repartition(4 * n, "unit")  # so many that hardly two units fall together
    scored = met.sortWithinPartitions("unit", F.col("text").isNotNull()).mapInPandas(_score(depth), COLUMNS)
    base = F.col("known") + math.log10(learned + 1) - F.col("n_tokens") * math.log10(tokens + types + 1)
    return scored.withColumn("n_tokens", F.col("n_words") + 1).select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + int(learned > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return scores(table(spark, sf_dir, "documents"))
