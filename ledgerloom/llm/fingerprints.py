"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector; a document's vector is the sum of
those of its paragraphs, lane by lane, modulo a power of two. So the order of
paragraphs doesn't matter, and a paragraph is added or taken away by adding or
subtracting its vector. A paragraph's vector has two parts:

* ``EXACT`` lanes of 16 bits, spread by SHAKE-128 over the whole paragraph: equal
  sums mean equal multisets of paragraphs.
* ``ALIKE`` lanes of 24 bits: every run of ``WINDOW`` bytes inside the paragraph
  (a shorter paragraph: the whole) adds one or takes one at a hashed lane. The lanes
  of a difference of two documents then measure what they don't share.

The fingerprint is the vector itself in base64: ``combined`` adds and subtracts
fingerprints, and ``alike`` tells from two of them how like their documents are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exact_ids, ids, on_files, parts, table

EXACT, ALIKE, WINDOW = 128, 256, 10
#: Characters whose vectors are made at a time.
CHUNK_CHARS = 1 << 20
LOWEST = -(1 << 63)
#: Ranges that ids are cut into, at most; their bounds and heads are what the driver holds.
RANGES = 1 << 16

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _lanes(h: np.ndarray) -> np.ndarray:
    """Lane and sign, as one number below 2 * ALIKE, of hashes."""
    h = (h ^ (h >> np.uint64(32))) * _C
    return (h >> np.uint64(64 - (2 * ALIKE - 1).bit_length())).astype(np.int64)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The exact lanes (uint16) and the alike lanes (int32) of every text. No text, no paragraph: zeros."""
    exact = np.zeros((len(texts), EXACT), np.uint16)
    coded = [t.encode() for t in texts]
    short: list[tuple[int, bytes]] = []
    for i, text in enumerate(coded):
        if not text:
            continue
        digests = []
        for p in text.split(b"\n"):
            digests.append(hashlib.shake_128(p).digest(2 * EXACT))
            if len(p) < WINDOW:
                short.append((i, digests[-1][:8]))
        exact[i] = np.frombuffer(b"".join(digests), "<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.uint16)
    joined = b"\n".join(coded) + b"\n" * WINDOW
    counts = np.zeros(len(texts) * 2 * ALIKE, np.int64)
    if len(joined) > WINDOW and texts:
        raw = np.frombuffer(joined, np.uint8)
        n = len(raw) - WINDOW
        eight = np.ndarray((n + WINDOW - 8,), "<u8", joined, 0, (1,))
        h = eight[:n] * _A + (eight[WINDOW - 8 :] ^ _B) * _C
        line = np.cumsum(raw == 10, dtype=np.int32)
        whole = line[WINDOW - 1 : n + WINDOW - 1] == np.concatenate(([0], line))[:n]
        of = np.repeat(np.arange(len(coded)), [len(c) + 1 for c in coded])[:n]
        counts += np.bincount(of[whole] * (2 * ALIKE) + _lanes(h[whole]), minlength=len(counts))
    if short:
        own = np.array([i for i, _ in short], np.int64)
        counts += np.bincount(own * (2 * ALIKE) + _lanes(np.frombuffer(b"".join(d for _, d in short), "<u8")), minlength=len(counts))
    counts = counts.reshape(len(texts), ALIKE, 2)
    return exact, _wrapped(counts[:, :, 0] - counts[:, :, 1])


def _wrapped(lanes: np.ndarray) -> np.ndarray:
    """Numbers modulo 2**24, from -2**23 on."""
    return (((lanes + (1 << 23)) & ((1 << 24) - 1)) - (1 << 23)).astype(np.int32)


def shown(exact: np.ndarray, lanes: np.ndarray) -> list[str]:
    """The fingerprint of every vector: both parts, little-endian, in base64."""
    three = np.ascontiguousarray(lanes.astype("<i4")).view(np.uint8).reshape(len(lanes), ALIKE, 4)[:, :, :3]
    return [base64.b64encode(e.astype("<u2").tobytes() + a.tobytes()).decode() for e, a in zip(exact, three, strict=True)]


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of fingerprints, as ``vectors`` gives them."""
    raw = np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), np.uint8).reshape(len(fingerprints), 2 * EXACT + 3 * ALIKE)
    three = raw[:, 2 * EXACT :].reshape(len(fingerprints), ALIKE, 3).astype(np.int64)
    return np.ascontiguousarray(raw[:, : 2 * EXACT]).view("<u2"), _wrapped(three @ np.array([1, 1 << 8, 1 << 16]))


def of_paragraph(paragraph: str) -> str:
    """The fingerprint of one paragraph, an empty one too. (A text without any is all zeros.)"""
    if paragraph:
        return shown(*vectors([paragraph]))[0]
    return combined(shown(*vectors(["x\n"]))[0], shown(*vectors(["x"]))[0], -1)


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of both; with ``sign`` -1, of those of ``a`` without those of ``b``."""
    (e, x), (f, y) = parsed([a]), parsed([b])
    return shown((e + sign * f.astype(np.int64)).astype(np.uint16), _wrapped(x.astype(np.int64) + sign * y.astype(np.int64)))[0]


def alike(a: str, b: str) -> float:
    """``likeness`` of two fingerprints."""
    return float(likeness(parsed([a])[1], parsed([b])[1])[0])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the alike lanes of two lists of texts: twice what they share over what both hold, within 0 and 1. Nothing in both: 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    both, apart = (a * a).sum(axis=1) + (b * b).sum(axis=1), ((a - b) ** 2).sum(axis=1)
    return np.where(both > 0, np.clip(1 - apart / np.maximum(both, 1), 0, 1), 1.0)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(held: list[tuple]) -> pd.DataFrame:
    """held: (doc_id, text, next text), each next text but the last being the text of the next entry or any other text."""
    out, at = [], 0
    while at < len(held):
        to, chars = at, 0
        while to < len(held) and (to == at or chars < CHUNK_CHARS):
            chars += len(held[to][1])
            to += 1
        own = held[at:to]
        texts, nexts = [x[1] for x in own], [x[2] for x in own]
        changed = [edited(t, s) for t, s in zip(texts, nexts, strict=True)]
        exact, alike = vectors(texts)
        exact_changed, alike_changed = vectors(changed)
        # The next text is mostly the one after in this list; only others need a vector of their own.
        other = [i for i in range(len(own)) if i + 1 == len(own) or nexts[i] is not texts[i + 1]]
        alike_next = np.concatenate((alike[1:], alike[:1]))
        alike_next[other] = vectors([nexts[i] for i in other])[1]
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array([x[0] for x in own], dtype="Int64"),
                    "n_chars": [len(t) for t in texts],
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                    "fingerprint": shown(exact, alike),
                    "edited_fingerprint": shown(exact_changed, alike_changed),
                    "near_edited": likeness(alike, alike_changed),
                    "near_next": likeness(alike, alike_next),
                }
            )
        )
        at = to
    return pd.concat(out)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, guests (the head of the next bucket) last, ids from high to low."""
    last = None  # bucket, doc_id, text of the row that still waits for its next
    for batch in batches:
        held = []
        own = [None if i is pd.NA else i for i in ids(batch).tolist()]
        for bucket, guest, doc_id, text in zip(batch["bucket"].tolist(), batch["guest"].tolist(), own, batch["text"], strict=True):
            if last is not None and last[0] == bucket:
                held.append((last[1], last[2], text))
            last = None if guest else (bucket, doc_id, text)
        if held:
            yield _rows(held)


def _numbers(values: list[int | None]) -> Column:
    """A constant array of longs."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _place(key: Column, bounds: list[int], up_to: bool = False) -> Column:
    """How many of the sorted ``bounds`` are below ``key`` (or at most it): first among every ``step``-th of them, then among the ``step`` that follow."""
    step = math.isqrt(len(bounds)) + 1
    below = lambda of: F.aggregate(of, F.lit(0), lambda acc, x: acc + ((key >= x) if up_to else (key > x)).cast("int"))
    block = below(_numbers(bounds[step - 1 :: step])) * step
    return block + below(F.slice(_numbers(bounds), block + 1, F.lit(step)))


def tie() -> Column:
    """The order among rows with the same doc_id: a hash of the row's place in its file."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def chained(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, guest, key, tie: documents in ranges of ids, each range with the first document of the next one as a guest.

    An id that fills ranges of its own is cut into as many by ``tie``. Only bounds and
    heads of ranges reach the driver: four per partition, ``RANGES`` at most.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = documents(on_files(docs), "doc_id", "text", key.alias("key"), tie().alias("tie"))
    n = min(4 * parts(docs), RANGES)
    bounds = sorted(map(int, rows.select("key").stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)))
    bucket = _place(F.col("key"), bounds) if bounds else F.lit(0)
    if len(set(bounds)) < len(bounds):
        own = F.greatest(_place(F.col("key"), bounds, True) - bucket, F.lit(1))
        share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
        bucket = bucket + F.least(F.floor(share * own).cast("int"), own - 1)
    rows = rows.withColumn("bucket", bucket)
    heads = {r["bucket"]: tuple(r["head"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).collect()}
    if not heads:
        return rows.withColumn("guest", F.lit(False))
    # The head of each range is a guest of the range above it, that of the highest one of the lowest.
    order = sorted(heads, reverse=True)
    hosts = {b: order[i - 1] for i, b in enumerate(order)}
    at = lambda of: F.get(_numbers([of.get(b) for b in range(order[0] + 1)]), F.col("bucket"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(at(hosts).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    head = (F.col("key") == at({b: h[0] for b, h in heads.items()})) & (F.col("tie") == at({b: h[1] for b, h in heads.items()}))
    return rows.withColumn("at", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "key", "tie", "at.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how like both and the next document are.

    The next document is that of the next lower doc_id, null after all; the first one follows the last.
    Rows with the same doc_id follow one another by ``tie``. Null texts are empty; an empty text has a fingerprint
    like any other. A single document is its own next. Empty table: no rows. Other columns are not read.
    """
    rows = chained(docs).repartition(parts(docs), "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("tie"))
    return exact_ids(rows.select("bucket", "guest", "doc_id", "text")).mapInPandas(_sweep, COLUMNS)


def op1_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
