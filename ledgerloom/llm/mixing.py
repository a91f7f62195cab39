"""Mixing sources to target weights by distributed prefix sums. DataFrame functions only.

Every document gets a hash-random key. Within its source the keys are dealt to
equal ranges (hash keys are uniform, so equal ranges hold equal shares); the
sums of the ranges give every range its offset, and a running sum inside a
range gives every document the words that stand before it. A source is then cut
at exactly its budget; a budget above the source's size is whole epochs and a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: White space of the contract, and what is left between it.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of keys that a source is dealt to, at least.
LEAST_RANGES = 1024


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, rows_per_range: int = 65536, seed: str = "mix-1:", row: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, taken.

    ``row``: the column that tells the rows apart; without it they are numbered as read.
    ``weights`` repeat over the sources in code point order, a null source last.
    The targets share the size of all sources; one stops at ``cap`` times its
    source's size and the rest is shared again. ``taken`` counts the words that
    the mix takes of the document, repeats counted: whole epochs, and in the
    last one only what stands before the cut, so that a source's taken words are
    its target, rounded. ``ranges`` bounds the rows that give the offsets, per source.

    Null text: size 0, taken 0. Null doc_id or source: a value like any other.
    Repeated rows are separate documents; rows with the same doc_id have the
    same key and are ordered by size, then by ``row`` (in parts, where more than ``rows_per_range`` share a range; either order gives the same
    documents the same words, but for which of equal rows the cut falls in). Empty table: no rows. Other columns are not read.
    """
    sized = written(
        docs.select(
            F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )
    ranges = max(LEAST_RANGES, -(-sized.count() // rows_per_range))
    sized = sized.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    crowded = sums.where(F.col("rows") > rows_per_range).select("source", "range", F.ceil(F.col("rows") / rows_per_range).alias("parts"))
    per = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    # One row per source from here to `target`.
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * cap
    everything = W.partitionBy()
    first = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = first.rowsBetween(W.unboundedPreceding, -1), first.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    per = (
        per.withColumn("weight", weight)
        .withColumn("full", left * F.col("weight") > limit * F.sum("weight").over(after))
        .withColumn("shared", F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), limit).otherwise(0)).over(everything))
        .withColumn("among", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(F.col("shared").cast("double") * F.col("weight") / F.col("among")).alias("target"))
        .withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    offset = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums, per = sums.drop("rows").withColumn("offset", offset).alias("s"), per.alias("p")
    dealt = sums.join(per, F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "s.range", "offset", "source_size", "target", "epochs", "rest").alias("r")
    at = _inside(sized) if crowded.isEmpty() else _inside(_joined(sized, crowded, "left_anti", "source", "range")).unionByName(_inside_crowded(sized, crowded))
    at = at.alias("d")
    cut = F.greatest(F.lit(0), F.least(F.col("d.size"), F.col("rest") - F.col("offset") - F.col("inside")))
    return at.join(dealt, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range"))).select("row", "doc_id", "d.source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))


def _joined(rows: DataFrame, other: DataFrame, how: str, *keys: str) -> DataFrame:
    """``rows`` with what else ``other`` has for the same keys; nulls are keys like any other."""
    a, b = rows.alias("a"), other.alias("b")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    more = [] if how == "left_anti" else [F.col(f"b.{c}") for c in other.columns if c not in keys]
    return a.join(b, on, how).select("a.*", *more)


def _before(by: list[str], order: list[str], words: str = "size") -> Column:
    return F.coalesce(F.sum(words).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _inside(sized: DataFrame) -> DataFrame:
    """``sized`` with the words ``inside`` its range before each row."""
    return sized.withColumn("inside", _before(["source", "range"], ["key", "doc_id", "size", "row"]))


def _inside_crowded(sized: DataFrame, crowded: DataFrame) -> DataFrame:
    """The same for ranges with too many rows for a task, as when a doc_id stands in a third of all rows.

    Rows of one doc_id are ordered by size, and those of one size are dealt to parts by a hash of ``row``: the order of
    equal rows is all that this changes. Sums of the parts of a range give each its offset, as those of ranges do.
    """
    by = ["source", "range", "key", "doc_id", "size", "part"]
    rows = _joined(sized, crowded, "inner", "source", "range").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    parts = rows.groupBy(*by).agg(F.sum("size").alias("words")).withColumn("earlier", _before(["source", "range"], ["key", "doc_id", "size", "part"], "words")).drop("words")
    found = _joined(rows.withColumn("within", _before(by, ["row"])), parts, "inner", *by)
    return found.withColumn("inside", F.col("earlier") + F.col("within")).select(*sized.columns, "inside")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, sum(source_size) OVER ()::BIGINT AS total FROM per),
capped AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
         > 3 * source_size * sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_up FROM weighed),
aimed AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE
    ELSE (total - sum(CASE WHEN full_up THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE * w / (sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM capped),
planned AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM aimed),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN budget // p.source_size ELSE 0 END AS e, budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, budget - e * source_size - prev)))::BIGINT AS taken FROM run
"""
