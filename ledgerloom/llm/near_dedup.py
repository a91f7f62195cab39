"""Near duplicates: DartMinHash signatures, banded joining, exact verification, classes.

A text is the multiset of its five-word shingles; likeness is the weighted Jaccard
similarity, shared weight over joint weight. A shingle of weight w owns the region
from 0 to w of its weight axis, cut at whole numbers. On each unit of region hashed
darts arrive as a Poisson process in rank: the same shingle and unit have the same
darts in every text. A text keeps the darts below a rank that lets through about
K (ln K + 3) of them, whatever its length, and of these the earliest of each of K
coordinates; a text that leaves a coordinate empty is thrown again with twice the rank.

Bands of coordinates deal texts to buckets; of buckets with the same members one
goes on. A bucket is cut into blocks of some ``BLOCK`` texts or ``BLOCK_BYTES`` bytes; each block
meets with the bucket's representatives, a few of its texts, in one group. A group
finds the exact similarity of all its pairs at once, as a product of its texts-by-shingles
matrix with itself, and returns links that span its connected texts, fewer than it has
members and few for each. Classes are formed. Where a bucket's texts are then of one
class, as those of near copies mostly are, nothing is left to compare; where not, all pairs
of blocks that can hold texts of two classes meet, and classes are formed again.
So no link is lost, and the work grows with a bucket's size rather than its square as
long as its texts belong together. Copies (texts with the same words) are one node
throughout, gathered before any shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, exact_ids, ids, parts, scope, table, written
from .hashing import MULT, STEP, mix, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 20 = 0.00003.
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Texts and bytes of a block, on the mean, and representatives of a bucket at most.
BLOCK, BLOCK_BYTES, HEADS = 256, 4 << 20, 4
#: Links that a text has on the mean below it where a group's texts are strung together.
FAN = 32
CHUNK_BYTES = 1 << 20


def normal(text: str) -> bytes:
    """The words (between white space, A-Z lower-cased) between single blanks."""
    return b" ".join(text.encode().lower().split())


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed units of region of all texts, sorted within each, and the bounds of each text's.

    A shingle that stands w times gives w units. A text of fewer than five words is one
    shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    of = np.repeat(np.arange(len(texts)), made)
    at = first[of] + (np.arange(len(of)) - bounds[of])
    left = first[of] + counts[of] - at  # words from here to the end of the text
    h = np.zeros(len(of), np.uint64)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    for k in range(WORDS):
        h += np.where(left > k, padded[at + k] * MULT[k], np.uint64(0))
    h = mix(h)
    order = np.lexsort((h, of))
    h = h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, bool)
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return mix(h + run.astype(np.uint64) * MULT[4]), bounds


def signatures(units: np.ndarray, bounds: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart of every coordinate, for each text with any unit; rows of texts without are zeros."""
    sizes, out = np.diff(bounds), np.full((len(bounds) - 1, k), np.iinfo(np.uint64).max, np.uint64)
    reach = k * (math.log(k) + 3) / np.maximum(sizes, 1)
    todo = np.flatnonzero(sizes)
    while len(todo):
        out[todo] = np.iinfo(np.uint64).max
        of = np.repeat(todo, sizes[todo])
        unit = units[np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in todo])]
        rank, flat, j = np.zeros(len(unit)), out.reshape(-1), 0
        while len(unit):
            j += 1
            dart = mix(unit + np.uint64((j * STEP) & (2**64 - 1)))
            rank = rank - np.log1p((dart >> np.uint64(11)).astype(np.float64) * -(2.0**-53))
            here = rank < reach[of]
            unit, of, rank, dart = unit[here], of[here], rank[here], dart[here]
            again = mix(dart ^ MULT[2])
            # Rank above, the dart's own hash below: the smallest is the earliest, and equal only for the same dart.
            value = (np.minimum(rank * 2.0**16, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (again & np.uint64(0xFFFFFF))
            np.minimum.at(flat, of * k + ((again >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 2
    out[sizes == 0] = 0
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One key per band, with the band's number mixed in."""
    h = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        h = mix(h + signature[:, r::ROWS] * MULT[3] + np.uint64(r))
    return mix(h + np.arange(BANDS, dtype=np.uint64) * MULT[2]).view(np.int64)


def _digests(texts: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(t).digest()[:16] for t in texts]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= CHUNK_BYTES):
            held += len(texts[to])
            to += 1
        yield at, to
        at = to


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()  # texts of this task that have their keys already; a copy needs none
    for batch in batches:
        texts = [normal(t) for t in batch["text"]]
        nodes = _digests(texts)
        keys: list = [None] * len(texts)
        new = []
        for i, node in enumerate(nodes):
            if node not in seen and texts[i]:
                seen.add(node)
                new.append(i)
        if len(seen) > 1 << 20:
            seen.clear()
        for a, b in _chunks([texts[i] for i in new]):
            for i, row in zip(new[a:b], bands(signatures(*elements([texts[i] for i in new[a:b]]))), strict=True):
                keys[i] = row
        yield pd.DataFrame({"row": batch["row"], "doc_id": ids(batch), "node": nodes, "size": [len(t) for t in texts], "keys": keys})


def _normals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for batch in batches:
        texts = [normal(t) for t in batch["text"]]
        nodes = _digests(texts)
        rows = [(n, t) for n, t in zip(nodes, texts, strict=True) if t and not (n in seen or seen.add(n))]
        if len(seen) > 1 << 20:
            seen.clear()
        yield pd.DataFrame(rows, columns=["node", "words"])


def strung(own: list[int], marks: list[int]) -> list[tuple[int, int]]:
    """Links that span ``own``, few for each: to the first one with the same end of its mark, and from there to the first of all.

    Marks are the texts' own, and as many of their ends are told apart as a power of two: so nearly the same
    texts are strung in nearly the same way, wherever they meet, and most links are the same ones.
    """
    ends = 1
    while ends * FAN < len(own):
        ends *= 2
    heads: dict[int, int] = {}
    out = []
    for i in sorted(own):
        if (head := heads.setdefault(marks[i] % ends, i)) != i:
            out.append((head, i))
    first, *others = heads.values()
    return out + [(first, i) for i in others]


def linked(units: list[np.ndarray], similarity: float, marks: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the texts (sorted units each) connected by pairs of ``similarity`` or more."""
    marks = marks or list(range(len(units)))
    n, sizes = len(units), np.array([len(u) for u in units], np.int64)
    if n == 2:
        both = len(np.intersect1d(*units, assume_unique=True))
        return [(0, 1)] if both >= similarity * (sizes.sum() - both) - 1e-9 else []
    every, of = np.concatenate(units), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    times = np.diff(np.append(first, len(every)))
    column = np.repeat(np.arange(len(first)), times)
    shared = np.repeat(times > 1, times)  # what stands in one text only adds to no pair
    of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    width = max(256, (8 << 20) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        block[of[a:b], column[a:b] - at] = 1
        both += block @ block.T
    near = both.astype(np.float64) >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    out, free = [], np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        own, seen = [root], 0
        while seen < len(own):
            more = np.flatnonzero(near[own[seen]] & free)
            free[more] = False
            own += more.tolist()
            seen += 1
        out += strung(own, marks)
    return out


def _link(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, texts, held = None, [], [], 0
        ready: list[tuple[list[bytes], list[bytes]]] = []

        def done() -> None:
            if len(nodes) > 1:
                order = sorted(range(len(nodes)), key=nodes.__getitem__)
                ready.append(([nodes[i] for i in order], [texts[i] for i in order]))

        def flush() -> pd.DataFrame:
            distinct = dict.fromkeys(t for _, own in ready for t in own)
            order, units = list(distinct), {}
            for a, b in _chunks(order):
                own, bounds = elements(order[a:b])
                units.update((t, np.sort(own[bounds[k] : bounds[k + 1]])) for k, t in enumerate(order[a:b]))
            rows = [(ids[i], ids[j]) for ids, own in ready for i, j in linked([units[t] for t in own], similarity, [int.from_bytes(x[:4]) for x in ids])]
            ready.clear()
            return pd.DataFrame(rows, columns=["a", "b"])

        for batch in batches:
            for at, node, words in zip(zip(batch["key"], batch["i"], batch["j"], strict=True), batch["node"], batch["words"], strict=True):
                if at != group:
                    done()
                    if held > 8 * CHUNK_BYTES:
                        yield flush()
                        held = 0
                    group, nodes, texts = at, [], []
                nodes.append(node)
                texts.append(words)
                held += len(words)
        done()
        yield flush()

    return run


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: of every node of ``nodes`` (node, label) that has links (a, b), the least label of those that they connect.

    In a round each label takes the least one next to it and, by doubling, what that one leads to; links then
    join what their ends lead to, once each, and those within one label go. So every round leaves half the labels at
    most, and mostly far fewer. Written after every step, and deleted once read.
    """
    ends = links.select("a", "b").distinct()
    for end, name in (("a", "x"), ("b", "y")):
        ends = ends.join(nodes.select(F.col("node").alias(end), F.col("label").alias(name)), end)
    both = lambda df: df.select("x", "y").where("x <> y").unionByName(df.select(F.col("y").alias("x"), F.col("x").alias("y")).where("x <> y")).distinct()
    leads: list[DataFrame] = []
    with scope() as paths:
        ways = written(both(ends), "near-ways")
        while not ways.isEmpty():
            lead = written(ways.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("lead")), "near-leads")
            while True:
                far = lead.select(F.col("x").alias("lead"), F.col("lead").alias("far"))
                lead = written(lead.join(far, "lead").select("x", F.col("far").alias("lead"), (F.col("far") < F.col("lead")).alias("on")), "near-leads")
                if lead.where("on").isEmpty():
                    break
            lead = lead.drop("on")
            leads.append(lead)
            met = ways.join(lead.withColumnRenamed("lead", "p"), "x").join(lead.select(F.col("x").alias("y"), F.col("lead").alias("q")), "y")
            ways = written(both(met.select(F.col("p").alias("x"), F.col("q").alias("y"))), "near-ways")
        if not leads:
            return nodes.select("node", "label").limit(0)
        # What a label leads to in the end: round by round, from the last one, of the fewest labels, back.
        last = leads.pop()
        while leads:
            beyond = last.select(F.col("x").alias("lead"), F.col("lead").alias("beyond"))
            last = leads.pop().join(beyond, "lead", "left").select("x", F.coalesce("beyond", "lead").alias("lead"))
        found = written(nodes.join(last, nodes["label"] == last["x"]).select("node", F.col("lead").alias("label")), "near-labels")
    discard(nodes.sparkSession, *paths[:-1])
    return found


def _blocks(texts: str, size: str) -> Column:
    """Blocks of so many texts and bytes: a power of two, so that buckets of nearly the same texts are cut alike."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(texts) / BLOCK, F.col(size) / BLOCK_BYTES, F.lit(1.0))))).cast("int")


def with_heads(entries: DataFrame) -> DataFrame:
    """key, i, j, node: every block of a bucket, and with each the representatives of the bucket that are not in it."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = entries.select("key", own.alias("i"), "node", "blocks")
    hashed = F.struct(F.xxhash64("node").alias("h"), "node", "i")
    heads = dealt.where("blocks > 1").groupBy("key", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HEADS)).alias("part")).agg(F.min(hashed).alias("head"), F.first("blocks").alias("blocks"))
    guests = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "head").where("i <> head.i").select("key", "i", "head.node")
    return dealt.select("key", "i", "node").unionByName(guests).select("key", F.col("i").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node")


def unsettled(entries: DataFrame, labels: DataFrame) -> DataFrame | None:
    """key, i, j, node: groups that hold every pair of texts of a bucket of several blocks that are not of one class. None: there is no such pair.

    A class with half a block's texts or bytes in a bucket has blocks of its own there, all others
    share blocks; two blocks meet unless both are of the same class.
    """
    # A text without any link has no label; it is a class of its own.
    at = entries.where("blocks > 1").drop("blocks").join(labels.select("node", F.col("label.row").alias("class")), "node", "left")
    at = written(at.withColumn("alone", F.col("class").isNull()), "near-unsettled")
    of = ["key", "alone", "class"]
    sizes = at.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.when(F.col("alone"), F.col("n"))).alias("lone")).where((F.col("classes") > 1) | (F.col("lone") > 1)).select("key")
    if several.isEmpty():
        return None
    large = ~F.col("alone") & ((F.col("n") >= BLOCK / 2) | (F.col("bytes") >= BLOCK_BYTES / 2))
    sizes = sizes.join(several, "key", "left_semi").withColumn("own", F.when(large, F.col("class")))
    blocks = sizes.groupBy("key", "own").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("key", "own", _blocks("n", "bytes").alias("blocks"))
    others = blocks.groupBy("key").agg(F.collect_list(F.struct("own", "blocks")).alias("others"))  # at most one for half a block's texts or bytes, and one
    of_class = sizes.select("key", "class", "own").join(blocks.withColumnRenamed("key", "k").withColumnRenamed("own", "o"), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("o"))).select(F.col("key").alias("k"), F.col("class").alias("c"), "own", "blocks")
    placed = at.join(of_class, (F.col("key") == F.col("k")) & F.col("class").eqNullSafe(F.col("c"))).select("key", "node", "own", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("x"))
    met = placed.join(others, "key").select("key", "node", "own", "x", F.explode("others").alias("o")).where(F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("o.own")))
    met = met.select("key", "node", F.xxhash64("own", "x").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.col("o.blocks") - 1), lambda y: F.xxhash64("o.own", y.cast("long")))).alias("b"))
    return met.select("key", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "node").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, class_id, kept.

    ``row``: the column that tells the rows apart; without it they are numbered as read.
    Classes are the connected texts: links are pairs of similarity ``similarity`` or more, and
    texts with the same words. ``class_id`` is the least doc_id of the class (null last); of the
    rows with that doc_id in the class the first is the one kept.
    Null and empty texts, and all without words, are one class. Empty table: no rows. Other columns are not read.
    """
    rows = documents(docs, "doc_id", "text", F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, node binary, size long, keys array<long>"
    signed = written(exact_ids(rows).mapInPandas(_sign, schema), "near-signed")
    with scope() as paths:
        final = written(_classes_of(docs, signed, similarity), "near-classes")
    discard(docs.sparkSession, *paths[:-1])
    return signed.select("row", "doc_id", "node").join(final, "node").select("row", "doc_id", F.col("label.doc_id").alias("class_id"), (F.col("row") == F.col("label.row")).alias("kept"))


def _classes_of(docs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """node, label: of every text the least label of its class."""
    label = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = written(signed.groupBy("node").agg(F.min(label).alias("label")), "near-nodes")
    entries = signed.where("keys is not null").select("node", "size", F.explode("keys").alias("key")).distinct()
    # Of every bucket its size and its set of members, in two sums of hashes; of equal sets the first key.
    hashes = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    sums = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *hashes).where("n > 1")
    buckets = sums.groupBy("n", "bytes", "h1", "h2").agg(F.min("key").alias("key")).select("key", _blocks("n", "bytes").alias("blocks"))
    entries = written(entries.join(buckets, "key"), "near-entries")
    members = entries.select("node").distinct()
    texts = documents(docs, "text").mapInPandas(_normals, "node binary, words binary")
    texts = written(texts.join(members, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    n = parts(docs)

    def links(groups: DataFrame) -> DataFrame:
        met = groups.join(texts, "node").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        return written(met.select("key", "i", "j", "node", "words").mapInPandas(_link(similarity), "a binary, b binary"), "near-links")

    own = nodes.join(members, "node")
    found = links(with_heads(entries))
    labels = classes(own, found)
    if not entries.where("blocks > 1").isEmpty() and (more := unsettled(entries, labels)) is not None:
        labels = classes(own, found.union(links(more)))
    return nodes.alias("n").join(labels.alias("c"), F.col("n.node") == F.col("c.node"), "left").select("n.node", F.coalesce("c.label", "n.label").alias("label"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near duplicates of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


# Pairs by the exact similarity, and classes as what they connect.
SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
every AS (SELECT rid, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
s AS (SELECT rid, x, count(*) AS c FROM every GROUP BY 1, 2),
t AS (SELECT rid, sum(c) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.rid AS i, b.rid AS j, sum(least(a.c, b.c)) AS n FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
near AS (SELECT i, j FROM both_ b JOIN t p ON p.rid = b.i JOIN t q ON q.rid = b.j WHERE b.n >= 0.8 * (p.n + q.n - b.n) - 1e-9
         UNION ALL SELECT (SELECT min(rid) FROM w WHERE len(ws) = 0), rid FROM w WHERE len(ws) = 0),
ways AS (SELECT i, j FROM near UNION SELECT j, i FROM near),
reach(i, j) AS (SELECT rid, rid FROM w UNION SELECT r.i, v.j FROM reach r JOIN ways v ON v.i = r.j),
heads AS (SELECT r.i AS rid, min_by(w.rid, (w.doc_id IS NULL, w.doc_id, w.rid)) AS head FROM reach r JOIN w ON w.rid = r.j GROUP BY 1)
SELECT w.doc_id, h.doc_id AS class_id, w.rid = heads.head AS kept FROM heads JOIN w ON w.rid = heads.rid JOIN w h ON h.rid = heads.head
"""
