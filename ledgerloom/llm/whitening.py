"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. A Spark pass gives Xᵀ(XQ) for a block Q of orthonormal columns,
from rows that are centred before they are multiplied; the driver makes the Rayleigh-Ritz vectors of
the block from it and the residuals of the wanted ones. Until all residuals certify, the next block
spans the Ritz vectors and their residuals (orthonormal by QR), and so grows up to ``most`` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import matrix, whole_vectors

#: Added to every whole number, by the contract.
SHIFT = 100_000
#: A wanted component's residual, as a part of the largest eigenvalue, that certifies it at once, and the one it must have where it no longer falls (rounding).
CERTAIN, ROUNDED = 1e-14, 1e-11
#: Components whose eigenvalue is a smaller part of the largest one than this are rounding, not variance.
VARIANCE = 1e-11
#: Rows that are centred and multiplied at once.
ROWS = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centre:
    """The number of rows, and per dimension their exact sum."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([float(Fraction(s, n)) for s in sums])
        self.small = np.array(sums) if max(map(abs, sums), default=0) < 1 << 62 else None

    def deviations(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - sums, if that surely fits; else nothing."""
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        return x * self.n - self.small if self.small is not None and largest * self.n < 1 << 62 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        exact = self.deviations(x)
        return exact / self.n if exact is not None else x - self.mean

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - sums, exact; nothing where it is beyond a long."""
        exact = self.deviations(x)
        if exact is not None and float(np.abs(exact).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return np.einsum("ij,ij->i", exact, exact).tolist()
        whole = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in whole]


def _summed(vectors: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], pad: int) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for blocks of rows: each task sums its own, Spark adds up those of tasks element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), dims, pad)
            for at in range(0, len(x), ROWS):
                own = part(x[at : at + ROWS])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "y"])

    cells = vectors.select("x").mapInArrow(run, "i int, y array<double>").select("i", F.posexplode("y").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def _centre(vectors: DataFrame, dims: int, pad: int) -> Centre:
    """Exact sums: halves of numbers are summed apart, so that no task's sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims, pad)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["j", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    rows = vectors.select("x").mapInArrow(run, "j int, n long, high long, low long").groupBy("j").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("j").collect()
    return Centre(rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows])


def _orthonormal(columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """QR twice; columns that are all zeros become random ones first."""
    length = np.linalg.norm(columns, axis=0)
    columns = np.where(length > 0, columns / np.where(length > 0, length, 1), rng.standard_normal(columns.shape))
    return np.linalg.qr(np.linalg.qr(columns)[0])[0]


def components(vectors: DataFrame, centre: Centre, k: int = 8, block: int = 16, most: int = 256, passes: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading unit eigenvectors (columns) of the covariance of ``vectors``, their eigenvalues, and its trace. Fewer, if there is less variance than that.

    Every pass holds a matrix of as many rows as there are dimensions and at most ``most`` columns.
    """
    dims, n = len(centre.sums), centre.n
    rng = np.random.default_rng(0)
    q, before = _orthonormal(rng.standard_normal((dims, min(dims, max(block, 2 * k)))), rng), np.inf
    for _ in range(passes):

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = centre.centred(x)
            # The last row begins with the rows' squares: the trace.
            return np.vstack([c.T @ (c @ q), np.pad([np.square(c).sum()], (0, q.shape[1] - 1))])

        made = _summed(vectors, dims, product, SHIFT) / n
        y, trace = made[:-1], float(made[-1, 0])
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = q @ turn
        rest = y @ turn - ritz * values
        top = max(values[0], 0.0)
        wanted = min(k, dims)
        worst = np.linalg.norm(rest[:, :wanted], axis=0).max()
        if worst <= CERTAIN * top or worst <= ROUNDED * top and worst > before / 2 or not top:
            kept = [i for i in range(wanted) if top and values[i] > VARIANCE * top]
            found = ritz[:, kept]
            return found * np.sign(found[np.abs(found).argmax(0), np.arange(len(kept))]) if kept else found, values[kept], trace
        before = worst
        width = min(dims, most, 2 * q.shape[1])
        own = min(q.shape[1], max(width // 2, width - q.shape[1]))
        q = _orthonormal(np.hstack([ritz[:, :own], rest[:, : width - own]]), rng)
    raise RuntimeError(f"after {passes} passes the largest residual is {worst:.3g}")


def whiten(df: DataFrame, k: int = 8, **options: int) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector of ``df`` and component.

    Vectors (``embedding``) that are null or hold null or non-finite components take no part. One shorter than the longest
    counts as ending in zeros. Null vec_ids and repeated rows are rows like any other. There are as many components as
    ``k`` and the dimensions, but none without variance (less than ``VARIANCE`` of the largest): equal vectors, or a single one, give no
    rows, as an empty table does. ``deviation`` is null where it is beyond a long. Signs are such that the entry largest in size is positive.
    ``options``: those of ``components``.
    """
    spark = df.sparkSession
    vectors = written(whole_vectors(df, SHIFT), "whitening-vectors")
    dims = vectors.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], RESULT)
    centre = _centre(vectors, dims, SHIFT)
    found, values, trace = components(vectors, centre, k, **options)
    count = len(values)
    if not count:
        return spark.createDataFrame([], RESULT)
    scaled, explained, n = found / np.sqrt(values), values / trace, centre.n

    def second(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ scaled
        return np.vstack([w.T @ w, w.sum(0)])

    moments = _summed(vectors, dims, second, SHIFT) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1), dims, SHIFT)
                w, each = centre.centred(x) @ scaled, np.repeat(np.arange(len(x)), count)
                tiled = lambda v: pa.array(np.tile(v, len(x)))  # noqa: E731, B023
                columns = [part.column(0).take(pa.array(each)), tiled(np.arange(1, count + 1, dtype=np.int32)), pa.array(np.full(len(each), n)), pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), tiled(explained), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return vectors.select("vec_id", "x").mapInArrow(run, RESULT)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of all ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
