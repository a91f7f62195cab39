"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes: 64 at first, then four times as many each
time. A group splits by its next digit until it is a singleton or its texts have
ended; texts of a group that has ended are equal byte for byte, without a digest.

1. Every input block splits its own rows so. One row per distinct text, the
   block's leader, keeps the bytes; the rows of a block refer to their leader. A
   text that a third of all rows hold thus leaves each block once.
2. Leaders are dealt by their first digit. A digit that more leaders share than
   a task should hold is split by the next digits, and so on (rounds over counts).
   (Spark deals by a hash of the digits, as it does any key; it decides on no equality.)
3. Leaders of one text that stand in more blocks than a task should hold can't be
   split further: they are merged in two steps, within salts first.
4. Each task splits its leaders on, by the same rule, and gives every leader its
   group. The rows take the group of their leader by an equi-join.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exact_ids, ids, parts, table, written

WIDTH, GROWTH = 64, 4
#: White space that equality ignores.
SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 8 << 20

LEADERS = "uid long, leader long, row {row}, doc_id long, n long, size long, best_n long, best_id long, best_uid long, sha string, norm binary"
MERGED = "key long, uid long, rep long, size long, best_n long, best_id long, best_uid long, sha string, norm binary"


def radix_groups(texts: list[bytes]) -> Iterator[list[int]]:
    """The positions of equal texts, group by group, by splitting on successive digits."""
    todo = [(list(range(len(texts))), 0, WIDTH)] if texts else []
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1:
            yield group
            continue
        digits = defaultdict(list)
        for i in group:
            digits[texts[i][at : at + width]].append(i)
        for digit, own in digits.items():
            if len(digit) < width:  # all of them end here
                yield own
            else:
                todo.append((own, at + width, width * GROWTH))


def _best(rows: list[tuple]) -> tuple:
    """Of (n, doc_id, uid): the most code points, then the smallest doc_id (null last), then the first row."""
    return min(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0, r[2]))


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    base, own_ids, numbers, texts, lengths, held = TaskContext.get().partitionId() << 33, [], [], [], [], 0

    def flush() -> pd.DataFrame:
        """A frame by columns; of the texts only those of leaders are in it."""
        nonlocal base
        n = len(own_ids)
        leaders, sizes, bests, shas, norms = np.empty(n, np.int64), [None] * n, [(None, None, None)] * n, [None] * n, [None] * n
        for own in radix_groups(texts):
            leader = own[0]
            leaders[own] = base + leader
            sizes[leader], bests[leader] = len(own), _best([(lengths[i], own_ids[i], base + i) for i in own])
            shas[leader], norms[leader] = hashlib.sha256(texts[leader]).hexdigest(), texts[leader]
        whole = lambda values: pd.array(values, dtype="Int64")
        best_n, best_id, best_uid = zip(*bests, strict=True)
        out = pd.DataFrame({"uid": np.arange(base, base + n), "leader": leaders, "row": pd.Series(numbers, dtype=object), "doc_id": whole(own_ids), "n": lengths, "size": whole(sizes), "best_n": whole(best_n), "best_id": whole(best_id), "best_uid": whole(best_uid), "sha": pd.Series(shas, dtype=object), "norm": pd.Series(norms, dtype=object)})
        base += n
        return out

    for batch in batches:
        for doc_id, number, text in zip(ids(batch).tolist(), batch["row"].tolist(), batch["text"], strict=True):
            norm = text.encode().translate(None, SPACE)
            own_ids.append(None if doc_id is pd.NA else doc_id)
            numbers.append(number)
            texts.append(norm)
            lengths.append(len(text))
            held += len(norm) + 64  # a row takes memory even without a text
            if held >= BLOCK_BYTES:
                yield flush()
                own_ids, numbers, texts, lengths, held = [], [], [], [], 0
    if own_ids:
        yield flush()


def _merge(keep_text: bool):
    """Rows come sorted by key and salt, so a group is complete when they change; of a text only one copy is held.

    Every leader learns its group's first leader, ``rep``, and what the group sums up to; the text stays with ``rep`` if it is kept at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, distinct, new, rows = None, [], [], []  # distinct, new: (norm, size, best, leaders, sha)

        def merge() -> None:
            nonlocal distinct, new
            every, distinct, new = distinct + new, [], []
            for own in radix_groups([x[0] for x in every]):
                norm, _, _, _, sha = every[own[0]]
                distinct.append((norm, sum(every[i][1] for i in own), _best([every[i][2] for i in own]), [u for i in own for u in every[i][3]], sha))

        def end() -> None:
            merge()
            for norm, size, best, leaders, sha in distinct:
                rows.extend((at[0], u, leaders[0], size, *best, sha, norm if keep_text and u == leaders[0] else None) for u in leaders)
            distinct.clear()

        def out() -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED.split(", ")], dtype=object)
            rows.clear()
            return made.assign(best_id=made["best_id"].astype("Int64"))

        for batch in batches:
            best_ids = [None if i is pd.NA else i for i in ids(batch, "best_id").tolist()]
            for key, salt, norm, uid, size, n, i, u, sha in zip(batch["key"].tolist(), batch["salt"].tolist(), batch["norm"], batch["uid"].tolist(), batch["size"].tolist(), batch["best_n"].tolist(), best_ids, batch["best_uid"].tolist(), batch["sha"], strict=True):
                if (key, salt) != at:
                    if at:
                        end()
                    at = key, salt
                new.append((norm, int(size), (int(n), i, int(u)), [uid], sha))
            merge()
            yield out()
        if at:
            end()
        yield out()

    return run


def radix_key(leaders: DataFrame, limit: int) -> tuple[Column, dict[int, int]]:
    """The digits (hashed) by which leaders are dealt: as few as leave no more than ``limit`` together; and of texts that have ended, those with more, with their numbers.

    A round counts the leaders of each digit string and goes on with those above
    ``limit``; there are as many of these as ``limit`` goes into the leaders, at most.
    """
    at, width, levels, ended = WIDTH, WIDTH, [], {}
    while not levels or levels[-1][1]:
        prefix, on = F.xxhash64(F.substring("norm", 1, at)), F.count_if(F.length("norm") > at)
        same = leaders.where(levels[-1][0].isin(levels[-1][1])) if levels else leaders
        found = same.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), on.alias("on")).where(F.col("n") > limit).collect()
        levels.append((prefix, [r["p"] for r in found if r["on"] > limit]))
        ended |= {r["p"]: r["n"] for r in found if r["on"] <= limit}
        width *= GROWTH
        at += width
    key = levels.pop()[0]
    for prefix, hot in reversed(levels):
        key = F.when(prefix.isin(hot), key).otherwise(prefix)
    return key, ended


def exact_groups(docs: DataFrame, row: str | None = None, limit: int | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    ``row``: the column that tells the rows apart; without it they are numbered as read.
    ``limit``: leaders with the same digits that a task should hold; without it half the mean of a task.

    Equal: the same text without white space (``SPACE``); null and empty texts
    are equal. The row with the most code points in the original text stays,
    then the smallest doc_id (null after all others); of wholly repeated rows exactly one stays.
    Empty table: no rows. Other columns are not read.
    """
    rows = documents(docs, "doc_id", "text", F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"))
    found = written(exact_ids(rows).mapInPandas(_leaders, LEADERS.format(row=rows.schema["row"].dataType.simpleString())), "radix-leaders")
    n, leaders = parts(found), found.where("norm is not null")
    key, ended = radix_key(leaders, limit or max(256, leaders.count() // (2 * n)))
    columns = ("key", "salt", "norm", "uid", "size", "best_n", "best_id", "best_uid", "sha")
    keyed = leaders.withColumns({"key": key, "salt": F.lit(0)}).select(*columns)
    merge = lambda df, keep_text: exact_ids(df.repartition(n, "key", "salt").sortWithinPartitions("key", "salt"), "best_id").mapInPandas(_merge(keep_text), MERGED)
    if ended:
        hot = F.broadcast(docs.sparkSession.createDataFrame([(k, math.ceil(math.sqrt(m))) for k, m in ended.items()], "key long, salts int"))
        salted = keyed.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))
        first = written(merge(salted.select(*columns), True), "radix-merged")
        keyed = keyed.join(hot, "key", "left_anti").unionByName(first.where("norm is not null").withColumn("salt", F.lit(0)).select(*columns))
    groups = merge(keyed, False).select("uid", F.col("best_id").alias("keep_id"), F.col("best_uid").alias("keep_uid"), F.col("size").alias("group_size"), "sha")
    if ended:
        led = first.select(F.col("uid").alias("leader"), F.col("rep").alias("uid"))
        groups = groups.join(led, "uid", "left").withColumn("leader", F.coalesce("leader", "uid")).drop("uid")
    else:
        groups = groups.withColumnRenamed("uid", "leader")
    return found.select("uid", "leader", "row", "doc_id").join(groups, "leader").select("row", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of equal texts of all ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS nth
      FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
