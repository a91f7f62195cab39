"""Sentences and their n-grams against a list of indicators (KPIs), by embedding similarity.

The indicators are a small stated list. They travel as one row that holds them all in an array,
and every sentence finds its best one within its own row: no pair of the two becomes a row, and nothing is sorted
or shuffled. A list of more than ``LISTED`` indicators, or ``NUMBERS`` vector elements in all, goes in several
such arrays, one after the other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, mean, norm, total

#: What one array of indicators holds at most (32 MB of numbers).
LISTED, NUMBERS = 10_000, 4_000_000


def indicator_blocks(kpis: DataFrame, listed: int = LISTED, numbers: int = NUMBERS) -> list[DataFrame]:
    """Tables of one row with an array ``listed`` of (kpi_id, kpi, v, norm), sorted by kpi_id; none, if there are no indicators. Their sizes are counted first."""
    n, total = kpis.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(math.ceil(n / listed), math.ceil(total / numbers))
    if not n:
        return []
    rows = kpis.select(F.struct("kpi_id", "kpi", F.col("v"), norm(F.col("v")).alias("norm")).alias("k"), F.pmod(F.xxhash64("kpi_id"), F.lit(blocks)).alias("block"))
    array = F.array_sort(F.collect_list("k")).alias("listed")
    return [(rows.where(F.col("block") == i) if blocks > 1 else rows).agg(array) for i in range(blocks)]


def _nothing(kpis: DataFrame) -> DataFrame:
    return kpis.limit(0).select(F.array(F.struct("kpi_id", "kpi", "v", F.lit(0.0).alias("norm"))).alias("listed"))


def _with(rows: DataFrame, block: DataFrame) -> DataFrame:
    """J-8: every row with the array of indicators. The block is one row of a checked size."""
    return rows.crossJoin(F.broadcast(block))


def _once(c: Column) -> Column:
    """``c`` by a generator of one row: filters on it stay above it, and don't compute it over again below."""
    return F.explode(F.array(c))


def _scores(v: Column, length: Column) -> Column:
    return F.transform("listed", lambda k: cosine(v, k["v"], length, k["norm"]))


def sentence_tokens(token_feats: DataFrame) -> DataFrame:
    """sent_id, tokens, vectors: the tokens of a sentence in order."""
    both = F.array_sort(F.collect_list(F.struct("pos", "token", "v")))
    return token_feats.groupBy("sent_id").agg(both.alias("s")).select("sent_id", F.col("s.token").alias("tokens"), F.col("s.v").alias("vectors"))


def sent_feats(token_feats: DataFrame) -> DataFrame:
    """sent_id, v: the mean over tokens."""
    return sentence_tokens(token_feats).select("sent_id", mean(F.col("vectors")).alias("v"))


def cosine_pairs(sents: DataFrame, kpis: DataFrame) -> DataFrame:
    """E3, long: sent_id, kpi_id, kpi, score; every pair, by definition."""
    rows = sents.withColumn("length", norm(F.col("v")))
    pairs = [_with(rows, block).select("sent_id", "v", "length", F.explode("listed").alias("k")) for block in indicator_blocks(kpis) or [_nothing(kpis)]]
    return reduce(DataFrame.unionByName, (p.select("sent_id", "k.kpi_id", "k.kpi", cosine(F.col("v"), F.col("k.v"), F.col("length"), F.col("k.norm")).alias("score")) for p in pairs))


def _best_sentence(rows: DataFrame, blocks: list[DataFrame], v: str = "v") -> DataFrame:
    """``rows`` with ``sent``: (less, kpi_id, kpi) of the most similar indicator, the first of equals; ``less`` is the score with its sign turned."""
    columns, rows = rows.columns, rows.withColumns({"length": norm(F.col(v)), "sent": F.lit(None).cast("struct<less: double, kpi_id: bigint, kpi: string>")})
    for block in blocks:
        scored = _with(rows, block).withColumn("scores", _scores(F.col(v), F.col("length"))).withColumn("top", F.array_max("scores"))
        k = F.try_element_at("listed", F.array_position("scores", F.col("top")).cast("int"))
        found = F.when(F.size("listed") > 0, F.struct((-F.col("top")).alias("less"), k["kpi_id"].cast("long").alias("kpi_id"), k["kpi"].alias("kpi")))
        rows = scored.select(*columns, "length", _once(F.least("sent", found)).alias("sent"))
    return rows.drop("length")


def compare_sents(sents: DataFrame, kpis: DataFrame) -> DataFrame:
    """sent_id, kpi_sent, score_sent: the most similar indicator, the first of equals. Without indicators no rows."""
    blocks = indicator_blocks(kpis)
    found = _best_sentence(sents.select("sent_id", "v") if blocks else sents.select("sent_id", "v").limit(0), blocks)
    return found.select("sent_id", F.col("sent.kpi").alias("kpi_sent"), (-F.col("sent.less")).alias("score_sent"))


def ngram_spans(length: Column, limit: int = 999) -> Column:
    """E5: an array of all (x, y) with 0 < y - x <= limit within ``length``, by x then y."""
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda x: F.transform(F.sequence(x + 1, F.least(length, x + limit)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _products(block: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with vectors) and the block's indicators, with ``products``: per token, its dot product with every indicator."""
    return _with(rows, block).withColumn("products", _once(F.transform("vectors", lambda v: F.transform("listed", lambda k: dot(v, k["v"])))))


def _part(c: Column | str, s: Column) -> Column:
    return F.slice(c, s["x"] + 1, s["y"] - s["x"])


def _span_scores(s: Column) -> Column:
    """The similarity of span ``s`` (x, y, length) to each indicator.

    The span's mean needs no products of its own: its dot product with an indicator is the sum of its tokens', so a
    token meets every indicator once, however many spans hold it. ``length`` is the norm of the span's sum.
    Sums run from the span's first token (differences of running totals would leave rounding where vectors cancel out).
    """
    products = _part("products", s)
    total = F.aggregate(F.slice(products, F.lit(2), F.size(products) - 1), F.element_at(products, 1), lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))
    return F.zip_with(total, F.transform("listed", lambda k: k["norm"]), lambda p, n: F.round(F.coalesce(F.try_divide(p, s["length"] * n), F.lit(0.0)), 12))


def _spans(limit: int) -> Column:
    """Spans of ``vectors``: x, y, and the norm of their vectors' sum."""
    return F.transform(ngram_spans(F.size("vectors"), limit), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), norm(total(_part("vectors", s))).alias("length")))


def ngram_scores(token_feats: DataFrame, kpis: DataFrame, limit: int = 5) -> DataFrame:
    """E6 and E8 before the choice: sent_id, x, y, ngram, kpi_id, kpi, score for every span of at most ``limit`` tokens."""
    rows = sentence_tokens(token_feats).withColumn("spans", _once(_spans(limit)))
    out = []
    for block in indicator_blocks(kpis) or [_nothing(kpis)]:
        spans = _products(block, rows).select("sent_id", "tokens", "products", "listed", F.explode("spans").alias("s")).withColumn("scores", _span_scores(F.col("s")))
        pairs = spans.select("sent_id", F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.array_join(_part("tokens", F.col("s")), " ").alias("ngram"), F.explode(F.arrays_zip("listed", "scores")).alias("k"))
        out.append(pairs.select("sent_id", "x", "y", "ngram", "k.listed.kpi_id", "k.listed.kpi", F.col("k.scores").alias("score")))
    return reduce(DataFrame.unionByName, out)


def _best_ngram(rows: DataFrame, blocks: list[DataFrame], limit: int) -> DataFrame:
    """``rows`` (with tokens and vectors) with ``gram``: (less, x, y, kpi_id, kpi) of the best span and indicator, the first of equals by span, then indicator."""
    columns = rows.columns
    rows = rows.withColumns({"spans": _spans(limit), "gram": F.lit(None).cast("struct<less: double, x: int, y: int, kpi_id: bigint, kpi: string>")})
    for block in blocks:

        def top(s: Column) -> Column:
            # The scores of a span are an array of one array, so that the lambda names them once.
            best = F.transform(F.array(_span_scores(s)), lambda scores: F.struct((-F.array_max(scores)).alias("less"), s["x"].alias("x"), s["y"].alias("y"), F.array_position(scores, F.array_max(scores)).cast("int").alias("at")))
            return F.element_at(best, 1)

        scored = _products(block, rows).withColumn("best", F.when(F.size("listed") > 0, F.array_min(F.transform("spans", top))))
        k = F.try_element_at("listed", F.col("best.at"))
        found = F.when(F.col("best").isNotNull(), F.struct("best.less", "best.x", "best.y", k["kpi_id"].cast("long").alias("kpi_id"), k["kpi"].alias("kpi")))
        rows = scored.select(*columns, "spans", _once(F.least("gram", found)).alias("gram"))
    return rows.drop("spans")


def _tokens(token_feats: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """The tokens of sentences; without indicators none."""
    return sentence_tokens(token_feats if blocks else token_feats.limit(0))


def compare_ngrams(token_feats: DataFrame, kpis: DataFrame, limit: int = 5) -> DataFrame:
    """sent_id, ngram, kpi_ngram, score_ngram: the best span and indicator, the first of equals by span, then indicator."""
    blocks = indicator_blocks(kpis)
    found = _best_ngram(_tokens(token_feats, blocks), blocks, limit)
    return found.select("sent_id", _ngram().alias("ngram"), F.col("gram.kpi").alias("kpi_ngram"), (-F.col("gram.less")).alias("score_ngram"))


def _ngram() -> Column:
    return F.array_join(F.slice("tokens", F.col("gram.x") + 1, F.col("gram.y") - F.col("gram.x")), " ")


def compare_both(token_feats: DataFrame, kpis: DataFrame, limit: int = 5) -> DataFrame:
    """E4 and E7 from one grouping of the tokens: sent_id, kpi_sent, score_sent, ngram, kpi_ngram, score_ngram."""
    blocks = indicator_blocks(kpis)
    rows = _tokens(token_feats, blocks).withColumn("v", mean(F.col("vectors")))
    found = _best_ngram(_best_sentence(rows, blocks), blocks, limit)
    sent = F.col("sent.kpi").alias("kpi_sent"), (-F.col("sent.less")).alias("score_sent")
    return found.select("sent_id", *sent, _ngram().alias("ngram"), F.col("gram.kpi").alias("kpi_ngram"), (-F.col("gram.less")).alias("score_ngram"))


def compare_lists(token_feats: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """E4 against several lists from one grouping of the tokens: sent_id, and per list its name (the best indicator) and ``score_`` with it. A list without indicators: no rows, as with E4."""
    blocks = {name: indicator_blocks(kpis) for name, kpis in lists.items()}
    rows = sent_feats(token_feats if all(blocks.values()) else token_feats.limit(0))
    for name, own in blocks.items():
        found = _best_sentence(rows, own)
        rows = found.withColumns({name: F.col("sent.kpi"), f"score_{name}": -F.col("sent.less")}).drop("sent")
    return rows.drop("v")


def unpivot(matrix: DataFrame, key: str, names: str = "kpi", values: str = "score") -> DataFrame:
    """U-5: from a wide matrix, one column per indicator, to one row per cell."""
    return matrix.unpivot([key], [c for c in matrix.columns if c != key], names, values)


def ngram_debug(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans and indicators above ``least``, best first."""
    return scores.where(F.col("score") > least).orderBy(F.desc("score"), "sent_id", "x", "y", "kpi_id")
