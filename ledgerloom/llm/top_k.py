"""Exact top-k search by inner product, without random access: sorted lists are read from their best ends, under bounds.

Vectors meet queries in blocks. A block of vectors has a sorted list for each dimension, which is read from its ends,
a band at a time, once for all queries. What has been read of a vector, and what the lists can still give it at best
and at worst, bounds its score from both sides. A query stops when only few vectors, unread ones among them, can still
reach its k-th lower bound; the scores of these few are then resolved exactly. A task hands the k-th score on
from block to block, so later blocks stop sooner. Spark merges what tasks have found, query by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scope, table, written
from .vectors import matrix, whole_vectors

#: Vectors of a block, queries that meet it at once, and the bytes of queries that are handed to all tasks at once.
BLOCK, AT_ONCE, QUERY_BYTES = 4096, 1024, 8 << 20
#: Where reading pauses to look at the bounds, as parts of the lists.
BANDS = (1 / 4, 5 / 8, 3 / 4, 1)
#: Sums below these are exact as floats of 32 and 64 bits.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64))
LONG = (1 << 63) - 1
FOUND = "query long, query_id long, row long, vec_id long, score long"


class Lists:
    """A block of vectors, and for each dimension the list of them sorted by that component, ascending: it is read from both ends."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)
        self.largest = int(np.abs(x).max(initial=0))

    def exact(self, q: np.ndarray) -> type | None:
        """The smallest kind of float that holds all sums of products with ``q`` exactly, if any does."""
        most = self.largest * int(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        return next((kind for bound, kind in EXACT if most < bound), None)

    def survivors(self, q: np.ndarray, k: int, floor: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """For each query (a row of ``q``) the vectors that may be among its ``k`` best and reach its ``floor``; ``own`` has the vector that takes no part in it (-1: none).

        Positive weights read lists from their upper ends, negative ones from their lower ends. A vector's score is at most what it
        would have if all its unread components were the last one read of their list, and at least what it would have if they
        were the list's other end. A query is done when few vectors can still reach its k-th lower bound; unread ones are among those counted.
        """
        (m, dims), kind = self.x.shape, self.exact(q)
        if kind is None or not dims or m <= 4 * k:
            return [np.delete(np.arange(m), [i] if i >= 0 else []) for i in own.tolist()]
        weights = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind).T
        column, read, out = np.arange(dims), 0, [np.empty(0, int)] * len(q)
        # Upper ends and lower ends side by side: components as read, and which they are.
        known, seen, todo = np.zeros((m, 2 * dims), kind), np.zeros((m, 2 * dims), bool), np.arange(len(q))
        worst = np.concatenate([self.values[0], self.values[-1]]).astype(kind)
        for band in BANDS:
            end = max(read + 1, int(m * band))
            for at, part in ((column, slice(m - end, m - read)), (column + dims, slice(read, end))):
                known[self.order[part], at], seen[self.order[part], at] = self.values[part], True
            read, last = end, np.concatenate([self.values[m - end], self.values[end - 1]]).astype(kind)
            upper, lower = (np.where(seen, known, rest) @ weights[:, todo] for rest in (last, worst))
            mine = np.flatnonzero(own[todo] >= 0)
            upper[own[todo[mine]], mine] = lower[own[todo[mine]], mine] = -np.inf
            least = np.maximum(floor[todo], np.partition(lower, m - k, 0)[m - k])
            alive = (upper >= least) & (upper > -np.inf)
            done = (alive.sum(0) <= max(4 * k, m // 16)) | (end == m)
            for i in np.flatnonzero(done):
                out[todo[i]] = np.flatnonzero(alive[:, i])
            todo = todo[~done]
            if not len(todo):
                break
        return out

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products with ``rows``, as longs, or as whole numbers of any size where longs could overflow."""
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) < LONG:
            return self.x[rows] @ q
        return np.array([sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in self.x[rows].tolist()], object)


def _search(uids: np.ndarray, ids: list[int], queries, dims: int, k: int):
    """queries: a broadcast matrix, one query a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best: list[list[tuple]] = [[] for _ in uids]  # (-score, no id, id, row)

        def meet(rows: np.ndarray, names: np.ndarray, unnamed: np.ndarray, x: np.ndarray) -> None:
            lists, at = Lists(x), {row: i for i, row in enumerate(rows.tolist())}
            own = np.array([at.get(u, -1) for u in uids.tolist()], int)
            for start in range(0, len(uids), AT_ONCE):
                some = slice(start, start + AT_ONCE)
                floor = np.array([float(-b[-1][0]) if len(b) == k else -np.inf for b in best[some]])
                for i, alive in enumerate(lists.survivors(q[some], k, floor, own[some]), start):
                    if not len(alive):
                        continue
                    scores = lists.scores(q[i], alive)
                    if len(alive) > k and scores.dtype != object:
                        # The k best, and of equal ones those that stand first.
                        alive, scores = alive[keep := scores >= np.partition(scores, len(scores) - k)[len(scores) - k]], scores[keep]
                        if len(alive) > k:
                            alive, scores = alive[nth := np.lexsort((rows[alive], names[alive], unnamed[alive], -scores))[:k]], scores[nth]
                    best[i] = sorted([*best[i], *zip((-scores).tolist(), unnamed[alive].tolist(), names[alive].tolist(), rows[alive].tolist(), strict=True)])[:k]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    meet(*_block(held, dims))
                    held = []
        if held:
            meet(*_block(held, dims))
        rows = [(int(uids[i]), ids[i], row, None if unnamed else name, max(-LONG - 1, min(LONG, -less))) for i, own in enumerate(best) for less, unnamed, name, row in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _block(batches: list[pa.RecordBatch], dims: int) -> tuple[np.ndarray, ...]:
    """Row numbers, vec_ids (null ones as zeros), which are null, and the matrix."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    unnamed = np.array(whole["vec_id"].is_null())
    return whole["row"].to_numpy(), whole["vec_id"].fill_null(0).to_numpy(), unnamed, matrix(whole["x"], dims)


def top_k(df: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``df`` that ``queries`` (SQL) picks the ``k`` other rows with the highest inner products.

    Components are floor(1024 * c). Vectors that are null or hold null or non-finite components take no part, neither as queries nor
    as candidates. One shorter than the longest counts as ending in zeros. Equal scores: the smaller vec_id first, null last. Repeated rows are rows of
    their own, as queries too: each finds the others. Fewer than ``k`` others: all. No queries or an empty table: no rows.
    A score beyond a long is given as the nearest long.

    Queries are handed to all tasks in blocks of ``query_bytes``, one scan for each block.
    """
    spark = df.sparkSession
    vectors = written(whole_vectors(df).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asked = vectors.where(queries)
    n, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    dims = vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    blocks = max(1, -(-n * 8 * dims // query_bytes))
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    paths: list[str] = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "x").toArrow().combine_chunks()
        given = spark.sparkContext.broadcast(matrix(own["x"], dims) if len(own) else np.zeros((0, dims), np.int64))
        found = vectors.select("row", "vec_id", "x").mapInArrow(_search(own["row"].to_numpy(), own["vec_id"].to_pylist(), given, dims, k), FOUND)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return ranked
        with scope() as made:
            written(ranked, "topk-found")
        paths += made
    return spark.read.schema(ranked.schema).parquet(*paths)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector of ``embeddings``, among all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row)
SELECT query_id, (row_number() OVER best)::INT AS rank, vec_id, score FROM pairs
WINDOW best AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""
