"""Blocks of a page in reading order, and blocks to paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE, text_filter
from .text import rule_segments, sentence_id

PAGE = ("doc_id", "page")


# The classes of the layout model, the score that a block needs, and the pixels added around it for reading.
CLASSES = {0: "Text", 1: "Title", 2: "List", 3: "Table", 4: "Figure"}
THRESHOLD, PAD = 0.8, 5.0


def layout_rows(detected: DataFrame, threshold: float = THRESHOLD, pad: float = PAD) -> DataFrame:
    """From a model's detections (class, score, x0 to y1) the blocks above ``threshold``: with their ``type``, and crop_x0 to crop_y1, the part of the page to read."""
    names = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    kept = detected.where(F.col("score") > threshold).withColumn("type", F.try_element_at(names, F.col("class").cast("int"))).where("type is not null")
    crops = {f"crop_{c}": F.greatest(F.col(c) - pad, F.lit(0.0)) if c in ("x0", "y0") else F.col(c) + pad for c in ("x0", "y0", "x1", "y1")}
    return kept.withColumns(crops).drop("class", "score")


def text_not_in_figure(blocks: DataFrame) -> DataFrame:
    """L1: Text blocks that lie inside no Figure of their page."""
    t, f = blocks.where("type = 'Text'").alias("t"), blocks.where("type = 'Figure'").alias("f")
    same = [F.col(f"t.{c}") == F.col(f"f.{c}") for c in PAGE]
    inside = [F.col("t.x0") >= F.col("f.x0"), F.col("t.y0") >= F.col("f.y0"), F.col("t.x1") <= F.col("f.x1"), F.col("t.y1") <= F.col("f.y1")]
    return t.join(f, same + inside, "left_anti")


def column_clusters(blocks: DataFrame, eps: float = 15.0) -> DataFrame:
    """L3, L4: ``cluster`` chains left edges at most ``eps`` apart; ``x0group`` is the cluster's median edge, truncated."""
    across = W.partitionBy(*PAGE).orderBy("x0", "block")
    gap = F.coalesce((F.col("x0") - F.lag("x0").over(across) > eps).cast("int"), F.lit(0))
    chained = blocks.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(across).cast("int")).drop("gap")
    return chained.withColumn("x0group", F.median("x0").over(W.partitionBy(*PAGE, "cluster")).cast("int"))


def reading_order(clustered: DataFrame) -> DataFrame:
    """``pos`` from 1, column by column from the top."""
    return clustered.withColumn("pos", F.row_number().over(W.partitionBy(*PAGE).orderBy("x0group", "y0", "block")))


#: Pages of a range, and runs of one: what a task numbers by itself.
PAGES, RUNS = 64, 4096


def segmented(rows: DataFrame, part: Column, order: list[str], value: Column, name: str, how=F.sum, inclusive: bool = False, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``name``: ``how`` (F.sum, F.max) of ``value`` over the rows of their ``key`` before them in ``order`` (and their own, if ``inclusive``).

    By prefix sums over segments: ``part`` must rise with ``order``. A segment is summed by itself, the totals of a
    key's segments give each one what stands before it, and rows add both. So no task holds more of a key than one segment, or one row for each.
    """
    columns = rows.columns
    # As structs, keys are equal where both are null, too, and the join finds the rows where the windows have dealt them.
    rows, within = rows.withColumns({"kid": F.struct(key), "part": F.struct(part.alias("part"))}).withColumn("value", value), W.partitionBy("kid", "part")
    rows = rows.withColumns({"inside": how("value").over(within.orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)), "whole": how("value").over(within)})
    # The totals come from the exchange that the windows need. Spark uses it again only if both read the same columns of it, so one row's
    # columns are asked for here, too, in a condition that always holds.
    totals = rows.groupBy("kid", "part").agg(F.first("whole").alias("whole"), *(F.first(c).alias(f"first_{c}") for c in columns))
    before = how("whole").over(W.partitionBy("kid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    kept = totals.where(F.xxhash64(*(f"first_{c}" for c in columns)) % 2 >= -1).select("kid", "part", "whole")
    offsets = kept.select("kid", "part", before.alias("before"))
    added = F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0)) if how is F.sum else F.greatest("before", "inside")
    return rows.join(offsets, ["kid", "part"]).select(*columns, added.alias(name))


def merge_runs(blocks: DataFrame, pages: int = PAGES) -> DataFrame:
    """L6 before the last step: doc_id, run, text: blocks run on (over pages too) until one ends a sentence.

    A finished run is joined by line ends, the unfinished one at the end by nothing; in each run two line ends in a row become one.
    A document of any length is numbered in ranges of ``pages``; only a run itself is held whole.
    """
    ends = F.coalesce(F.col("text").rlike(r"[.!?]\z"), F.lit(False)).cast("int")
    runs = segmented(blocks.select("doc_id", "page", "pos", "text"), F.floor(F.col("page") / pages), ["page", "pos"], ends, "run")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))), lambda x: x["text"])
    joined = F.when(F.max(ends) == 1, F.array_join(parts, "\n")).otherwise(F.array_join(parts, ""))
    return runs.groupBy("doc_id", "run").agg(F.replace(joined, F.lit("\n\n"), F.lit("\n")).alias("text"))


_ENDS = r"[.!?]\z"


def _gathered(blocks: DataFrame, *by: Column | str) -> DataFrame:
    """``by`` and the text of each group's blocks: the runs of ``merge_runs``, in order, joined by two line ends."""
    ended = F.coalesce(F.col("text").rlike(_ENDS), F.lit(False)).alias("e")
    rows = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "pos", "text", ended))).alias("parts"))
    at = F.filter(F.transform("parts", lambda x, i: F.when(x["e"], i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("parts", F.explode(F.array("parts"))).withColumn("at", F.explode(F.array(at)))
    joined = lambda parts, by: F.replace(F.array_join(F.transform(parts, lambda x: x["text"]), by), F.lit("\n\n"), F.lit("\n"))
    first = lambda k: F.coalesce(F.get("at", k - 1), F.lit(0))
    runs = F.transform("at", lambda end, k: joined(F.slice("parts", first(k) + 1, end - first(k)), "\n"))
    last = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0))
    rest = joined(F.slice("parts", last + 1, F.size("parts")), "")
    whole = F.when(F.size("parts") > last, F.concat(runs, F.array(rest))).otherwise(runs)
    return rows.select(*(F.col(c) for c in rows.columns[: len(by)]), F.array_join(whole, "\n\n").alias("text"))


def merge_pages(blocks: DataFrame) -> DataFrame:
    """One text per document: its runs (``merge_runs``) in order, joined by two line ends.

    Since a document is one row in the end, it is gathered at once. Blocks dealt by ``doc_id`` before their pages were put in order stay where they are.
    """
    return _gathered(blocks.select("doc_id", "page", "pos", "text"), "doc_id")


def sentences_of_blocks(blocks: DataFrame, split: Callable[[DataFrame], DataFrame] = rule_segments, pages: int = PAGES, size: int = RUNS) -> DataFrame:
    """The sentences that ``text.sentences`` gives for the merged text of each document, without a row that holds a document.

    As ``sentences_of_runs`` over ``merge_runs``, but blocks are dealt by unit at once. Any runs in a row may be one unit. One begins with a block
    after a run's end, unless its text may begin a run with a hyphen alone on the first line, or it is the first one of its range of ``pages``.
    """
    after = F.lag(F.coalesce(F.col("text").rlike(_ENDS), F.lit(False)), 1, False).over(W.partitionBy("kid", "part").orderBy("page", "pos"))
    hyphen = F.coalesce(F.col("text").rlike(rf"\A{SPACE}*+(?:-{SPACE}*(?:\n|\z)|\z)"), F.lit(True))
    rows = blocks.select("doc_id", "page", "pos", "text")
    units = segmented(rows, F.floor(F.col("page") / pages), ["page", "pos"], (after & ~hyphen).cast("int"), "unit", inclusive=True)
    # A segmenter knows documents: a unit is one to it.
    joined = _gathered(units, F.struct("doc_id", "unit").alias("doc_id")).withColumn("text", text_filter(F.col("text")))
    found = split(joined).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_pos", "text"))).alias("found"))
    found = found.withColumn("found", F.transform("found", lambda s: s["text"]))
    # An empty unit, as a document's last run may be, is a sentence only where the document holds nothing else.
    found = found.where((F.col("doc_id.unit") == 0) | (F.array_join("found", "") != "")).withColumnRenamed("doc_id", "of")
    counts = found.select("of.doc_id", "of.unit", F.size("found").cast("long").alias("n"))
    # The places are counted without the texts, which stay where they are.
    placed = segmented(counts, F.floor(F.col("unit") / size), ["unit"], F.col("n"), "first").select(F.struct("doc_id", "unit").alias("of"), "first")
    out = found.join(placed, "of").select("of.doc_id", "first", F.posexplode("found").alias("nth", "text"))
    return out.select("doc_id", (F.col("first") + F.col("nth")).cast("int").alias("sent_pos"), "text").withColumn("sent_id", sentence_id())


def sentences_of_runs(runs: DataFrame, split: Callable[[DataFrame], DataFrame] = rule_segments, size: int = RUNS) -> DataFrame:
    """P1, P3 over ``merge_runs``: the sentences that ``text.sentences`` gives for the merged text of each document, without a row that holds a document.

    A run ends a sentence, so sentences don't cross runs; but a hyphen alone on the first line of a run takes
    away the line ends before it, so such a run goes with the one before. Places are counted over ranges of ``size`` runs.
    """
    hyphen = F.col("text").rlike(rf"\A{SPACE}*-{SPACE}*(?:\n|\z)")
    units = segmented(runs, F.floor(F.col("run") / size), ["run"], F.when(~hyphen | (F.col("run") == 0), F.col("run")), "unit", F.max, inclusive=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "\n\n")
    joined = units.groupBy("doc_id", "unit").agg(text.alias("text")).withColumn("text", text_filter(F.col("text")))
    # A segmenter knows documents: a unit is one to it.
    found = split(joined.select(F.struct("doc_id", "unit").alias("doc_id"), "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_pos", "text"))).alias("found"))
    found = found.select("doc_id.doc_id", "doc_id.unit", F.transform("found", lambda s: s["text"]).alias("found"))
    # An empty unit, as a document's last run may be, is a sentence only where the document holds nothing else.
    found = found.where((F.col("unit") == 0) | (F.array_join("found", "") != ""))
    placed = segmented(found, F.floor(F.col("unit") / size), ["unit"], F.size("found").cast("long"), "first")
    rows = placed.select("doc_id", "first", F.posexplode("found").alias("nth", "text"))
    return rows.select("doc_id", (F.col("first") + F.col("nth")).cast("int").alias("sent_pos"), "text").withColumn("sent_id", sentence_id())
