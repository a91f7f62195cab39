"""A Merkle manifest of a dataset, level by level with windows. DataFrame functions only.

Rows are sorted into ranges by group and order; counts of ranges give every row its number in its
group. Nodes of a level are windows of three by group and parent number: the list of a whole
window gives the parent's digest and each child's siblings, and one child hands the parent up.
From the top, every node takes the siblings above it from its parent by an equi-join on the parent's
number, of which no key has more than three rows, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, parts, scope, table, written

#: Children of a node.
ARITY = 3
#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WITHIN = (1 << 33) - 1


def digest(*fields: str, **changed: Column) -> Column:
    """The leaf of a row: sha256 of its fields, each "-" if null, else its bytes counted, a colon, and its value. ``changed`` stands in place of fields."""
    values = [changed.get(f, F.col(f)).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (a number per group that rises with the group), ``n`` (rows of the group) and ``idx`` (from 0 by ``order``, nulls first).

    ``rows`` must be a written table and ``order`` unique, so that no range grows with one value.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    sorted_ = written(rows.repartitionByRange(parts(rows), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    sorted_ = sorted_.withColumns({"part": F.shiftrightunsigned("at", 33), "nth": F.col("at").bitwiseAND(_WITHIN)})
    counts = sorted_.groupBy("part", *group).agg(F.min("nth").alias("first"), F.min("at").alias("at"), F.count(F.lit(1)).alias("m"))
    # One row per range and group from here to `offsets`.
    own = W.partitionBy(*group)
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", *group, (before - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"), F.min("at").over(own).alias("tree")).alias("o")
    s, on = sorted_.drop("at").alias("s"), F.col("s.part") == F.col("o.part")
    for c in group:
        on &= F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}"))
    return s.join(offsets, on).select(*(F.col(f"s.{c}") for c in rows.columns), "tree", "n", (F.col("nth") + F.col("shift")).alias("idx"))


def _level(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``above``, the parent's number, and the digests of siblings before and after each, joined."""
    at, k = F.expr(f"idx div {ARITY}"), (F.col("idx") % ARITY).cast("int")
    run = F.collect_list("digest").over(W.partitionBy("tree", "above").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    listed = nodes.withColumn("above", at).withColumn("run", run)
    return listed.withColumns({"left": F.array_join(F.slice("run", F.lit(1), k), ""), "right": F.array_join(F.slice("run", k + 2, F.lit(ARITY)), "")}).drop("run")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all trees, each a written table, from leaves (tree, idx, n, digest, and more) up to where each tree has one node.

    A tree that has come to its top (n = 1) takes no part in the levels above.
    """
    levels = [written(_level(nodes), "merkle-level")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = levels[-1].where((F.col("n") > 1) & (F.col("idx") % ARITY == 0))
        above = first.select("tree", F.col("above").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(written(_level(above), "merkle-level"))
        most = -(-most // ARITY)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree, level, digest of every tree's top."""
    out = levels[0].where("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    for i, nodes in enumerate(levels[1:], 1):
        out = out.unionByName(nodes.where("n = 1").select("tree", F.lit(i).alias("level"), "digest"))
    return out


def descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The leaves of ``levels`` with ``path`` and what else ``roots`` (tree, level, path and more, one row per tree) hold.

    ``path`` lists, from the leaf up, the siblings' digests of every level: those before and those after, each joined.
    A tree's own siblings go in front of the path that its root has.
    """
    more, upper = [c for c in roots.columns if c not in ("tree", "level", "path")], None
    for i in range(len(levels) - 1, -1, -1):
        nodes = levels[i]
        found = nodes.where("n = 1").join(roots.where(F.col("level") == i).drop("level"), "tree")
        if upper is not None:
            parents = upper.select("tree", F.col("idx").alias("above"), "path", *more)
            steps = nodes.where("n > 1").join(parents, ["tree", "above"]).withColumn("path", F.concat(F.array(F.struct("left", "right")), "path"))
            found = found.select(*nodes.columns, "path", *more).unionByName(steps.select(*nodes.columns, "path", *more))
        upper = found
    return upper


def folded(leaf: Column, path: Column | str = "path") -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, other_leaf, subroot, root, path.

    A leaf is the ``digest`` of ``FIELDS``. Leaves of a source ascend by doc_id (null first; rows of one doc_id
    by their leaves); runs of three become their parent, a last run of fewer, even of one, too, until one node, the
    subroot, remains. Subroots in the order of sources (null first, then by UTF-8 bytes) give the root likewise.
    ``path`` proves the leaf: ``folded`` gives the root from both. ``other_leaf`` is the leaf with ``tampered`` in
    place of the text (null where ``tampered`` is null, and everywhere without it).

    Null in any column: "-", unlike an empty text, which is "0:". Wholly repeated rows are leaves of their own and have the
    same digest, but places and paths of their own. Long texts are hashed whole. Empty table: no rows. Other columns are not read.
    """
    other = F.when(tampered.isNotNull(), digest(*FIELDS, text=tampered)) if tampered is not None else F.lit(None).cast("string")
    spark, columns = docs.sparkSession, (F.col("doc_id"), F.col("source").cast("string").alias("source"), digest(*FIELDS).alias("digest"), other.alias("other_leaf"))
    with scope() as spent:
        leaves = written(docs.select(*columns, F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
        nodes = numbered(leaves, ["source"], ["doc_id", "digest", "tie"]).drop("source", "tie")
        spent = [*spent]
    levels = climb(nodes)
    with scope() as more:
        sources = written(tops(levels).withColumnRenamed("tree", "of"), "merkle-subroots")
        upper = numbered(sources, [], ["of"])
        spent += more
    trees = climb(upper)
    root = tops(trees).select("tree", "level", F.lit(None).cast("array<struct<left: string, right: string>>").alias("path"), F.col("digest").alias("root")).withColumn("path", F.coalesce("path", F.array().cast("array<struct<left: string, right: string>>")))
    subroots = written(_subroots(trees, root), "merkle-roots")
    discard(spark, *spent)
    return descend(levels, subroots).select("doc_id", F.col("digest").alias("leaf"), "other_leaf", "subroot", "root", "path")


def _subroots(trees: list[DataFrame], root: DataFrame) -> DataFrame:
    # The trees' leaves are the subroots: `of` is their tree below, and their level there is theirs.
    rows = descend([trees[0].withColumnRenamed("level", "lower"), *trees[1:]], root)
    return rows.select(F.col("of").alias("tree"), F.col("lower").alias("level"), "path", F.col("digest").alias("subroot"), "root")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, and which rows' texts still verify when every second row (by crc32 of doc_id) loses its line ends. (A null doc_id has no crc32 and loses none.)"""
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    # A null text stays null: its leaf is untouched.
    rows = manifest(table(spark, sf_dir, "documents"), lost)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded(F.coalesce("other_leaf", "leaf"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
_ENCODED = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_ENCODED}) AS leaf, sha256({_ENCODED.replace("text", "replace(text, chr(10), '')")}) AS lost, coalesce({_CRC} % 2 = 1, false) AS hit FROM documents),
placed AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (SELECT 0 AS level, tree, idx, n, leaf AS h FROM placed UNION ALL
  SELECT level + 1, tree, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 3),
subs AS (SELECT tree, level AS depth, h AS subroot FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subs) AS n, subroot AS h FROM subs UNION ALL
  SELECT level + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY level, idx // 3),
steps AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT -1, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM above a JOIN above b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY 2, 3),
walk AS (
  SELECT p.tree AS leaf_tree, p.idx AS leaf_idx, 0 AS step, p.tree, 0 AS level, p.idx, CASE WHEN p.hit THEN p.lost ELSE p.leaf END AS h, '' AS seen, s.depth FROM placed p JOIN subs s USING (tree)
  UNION ALL
  SELECT leaf_tree, leaf_idx, step + 1, CASE WHEN up THEN -1 ELSE tree END, CASE WHEN up THEN level - depth + 1 ELSE level + 1 END, w.at // 3, sha256(l || h || r), seen || l || r, CASE WHEN up THEN 0 ELSE depth END
  FROM (SELECT w.*, s.l, s.r FROM (SELECT *, tree >= 0 AND level = depth AS up, CASE WHEN tree >= 0 AND level = depth THEN tree ELSE idx END AS at FROM walk) w
        JOIN steps s ON s.tree = CASE WHEN w.up THEN -1 ELSE w.tree END AND s.level = CASE WHEN w.up THEN 0 ELSE w.level END AND s.idx = w.at) w),
ends AS (SELECT leaf_tree, leaf_idx, arg_max(h, step) AS folded_root, arg_max(seen, step) AS seen FROM walk GROUP BY 1, 2),
top AS (SELECT h AS root FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN ends ON leaf_tree = tree AND leaf_idx = idx JOIN subs USING (tree), top
"""
