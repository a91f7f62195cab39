"""Counts, cross tables, histograms and samples."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "outofscope"


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """A1: how often each value stands, most frequent first; nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def percent(counts: DataFrame, name: str = "n") -> DataFrame:
    """A2: ``pct`` of the total, truncated."""
    return counts.withColumn("pct", (F.col(name) * 100 / F.sum(name).over(W.partitionBy())).cast("int"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A3, A5: a count per row and each of ``values``; those that never stand are zeros."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def crosstab_wide(df: DataFrame, row: str, column: str, headers: DataFrame, most: int = 10_000) -> DataFrame:
    """J-6, J-7, A5: a count per row and each of the subtopics that ``headers`` (topic, subtopic) list, under two-level names ``topic__subtopic``, sorted.

    The columns come from the table: one that never stands is zeros. ``__other`` counts values that the table doesn't
    list, and nulls. Of a subtopic listed twice the last topic by name counts. The names are read first; more than ``most`` are no table to look at, and an error.
    """
    return _wide(df, row, column, headers, most)


def _wide(df: DataFrame, row: str, column: str, headers: DataFrame, most: int = 10_000, *more: Column) -> DataFrame:
    """``crosstab_wide``, with ``more`` aggregates of the counts (``row``, subtopic, n): one pass over ``df`` for all of them."""
    named = headers.groupBy("subtopic").agg(F.max("topic").alias("topic")).limit(most + 1).collect()
    if len(named) > most:
        raise ValueError(f"more than {most} columns")
    pairs = sorted((r["topic"], r["subtopic"]) for r in named)
    # Counted by position, so that no value can be taken for a name.
    known = headers.sparkSession.createDataFrame([(s, i) for i, (_, s) in enumerate(pairs)], "subtopic string, nth int")
    counts = df.groupBy(row, F.col(column).alias("subtopic")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "subtopic", "left")
    cells = [F.coalesce(F.sum(F.when(F.col("nth") == i, F.col("n"))), F.lit(0)).alias(f"{t}__{s}") for i, (t, s) in enumerate(pairs)]
    return counts.groupBy(row).agg(*cells, F.coalesce(F.sum(F.when(F.col("nth").isNull(), F.col("n"))), F.lit(0)).alias("__other"), *more)


def crosstab_report(df: DataFrame, row: str, column: str, headers: DataFrame) -> DataFrame:
    """J-6 in full: topic, subtopic, ``row`` and the wide counts: every listed subtopic with the rows in which it is dominant (A4); with none, one row of zeros."""
    wide = _wide(df, row, column, headers, 10_000, _best("subtopic", "n").alias("__top")).where(F.col(row).isNotNull())
    cells = [c for c in wide.columns if c not in (row, "__top")]
    top = wide.select(_top(row, "__top").alias("subtopic"), row, *cells)
    return headers.select("topic", "subtopic").join(top, "subtopic", "left").na.fill(0, cells).select("topic", "subtopic", row, *cells)


def _best(column: str, name: str) -> Column:
    """The ``column`` with the highest count, the first by name of equals; ``outofscope`` and null apart."""
    return F.min_by(column, F.when(F.col(column) != OUT, F.struct((-F.col(name)).alias("less"), F.col(column).alias("by"))))


def _top(row: str, best: str) -> Column:
    return F.when(F.col(row) == OUT, F.lit(OUT)).when(F.col(row).isNull(), F.lit(OUT)).otherwise(F.coalesce(best, F.lit(OUT)))


def dominant(counts: DataFrame, row: str, column: str, name: str = "n") -> DataFrame:
    """A4: the column with the highest count of each row, the first by name of equals; ``outofscope`` only for its own row (and a null one). ``counts`` is read once."""
    return counts.groupBy(row).agg(_best(column, name).alias("top")).select(row, _top(row, "top").alias("top"))


def highlight(counts: DataFrame, row: str, column: str, name: str = "n") -> DataFrame:
    """Whether a count is its row's highest and not zero, ``outofscope`` apart; all of equals."""
    top = F.max(F.when(F.col(column) != OUT, F.col(name))).over(W.partitionBy(row))
    return counts.withColumn("top", F.coalesce((F.col(column) != OUT) & (F.col(name) == top) & (F.col(name) != 0), F.lit(False)))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """A10: bin (from 0), n; equal widths between the least and greatest value, the last bin closed. One value: bin 0."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    part = F.coalesce(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))
    at = F.least(F.floor(part), F.lit(bins - 1))
    # The ends are one row.
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shuffled(seed: int, *keys: str):
    """O3: a hashed order that any engine gives alike: md5 of the seed and the key, then the key."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary")), *map(F.col, keys)]


def numbered(df: DataFrame, seed: int, key: str, rows: int = 65_536) -> DataFrame:
    """``df`` with ``rank``, from 0 in the order of ``shuffled``: prefix sums over ranges of the hash, so that no task holds more than a range. (The ranges are as many as powers of 16, of at most ``rows`` rows on the mean.)"""
    digits, n = 0, df.count()
    while n > rows * 16**digits:
        digits += 1
    hashed = df.withColumn("hashed", shuffled(seed, key)[0]).withColumns({"part": F.substring("hashed", 1, digits), "one": F.lit(1)})
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select("part", before.alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy("hashed", key)) - 1
    return hashed.withColumn("own", own).join(offsets, "part").select(*df.columns, (F.col("before") + F.col("own")).alias("rank"))


#: Hexadecimal digits of a hash that tell its ranges apart.
DIGITS = 4


def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement: ``draw`` (from 0) and a row of ``df`` each. Reruns agree, and so do other engines. No rows: no draws.

    A draw's hash picks a rank; ranks are the places in hashed order of ``key``, which must tell rows apart.
    """
    # First the counts of ranges of the hash: they give the size, and the range of each draw. Then only rows of ranges
    # that were drawn are dealt out and numbered. Ranges are told by ``DIGITS`` digits of the hash: 65,536 short rows, whatever the table.
    hashed = df.select(shuffled(seed, key)[0].alias("hashed"), F.col(key).alias("key"), F.struct(*df.columns).alias("row")).withColumn("part", F.substring("hashed", 1, DIGITS))
    counts = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).orderBy("part").collect()
    ends = [*accumulate(r["m"] for r in counts)]
    size = ends[-1] if ends else 0
    ranges = df.sparkSession.createDataFrame([(r["part"], end - r["m"], end) for r, end in zip(counts, ends, strict=True)], "part string, first long, end long")
    # A draw finds its range by a slice of all ranks: a range lies in few, and few lie in one, on the mean.
    width = size // 16**DIGITS + 1
    sliced = ranges.withColumn("slice", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width))))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n if size else 0).select(F.col("id").alias("draw"), (number % max(size, 1)).alias("rank")).withColumn("slice", F.floor(F.col("rank") / width))
    placed = draws.join(F.broadcast(sliced), "slice").where("rank >= first and rank < end").select("draw", "part", (F.col("rank") - F.col("first")).alias("own"))
    drawn = hashed.join(F.broadcast(placed.select("part").distinct()), "part", "left_semi")
    ranked = drawn.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy("hashed", "key")) - 1)
    return placed.join(ranked, ["part", "own"]).select("draw", "row.*")


def sample(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer); a filter after it stays after it."""
    return df.orderBy(*shuffled(seed, *keys)).limit(n)


def stratified_sample(df: DataFrame, group: str, k: int, *keys: str, seed: int = 0) -> DataFrame:
    """``k`` rows of each group."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(*shuffled(seed, *keys)))).where(F.col("nth") <= k).drop("nth")
