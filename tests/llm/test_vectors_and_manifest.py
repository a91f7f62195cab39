"""The Merkle manifest, whitening and top-k search against plain versions, and on odd tables."""

import collections
import hashlib
import math
import random
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, exact_dedup, merkle, mixing, top_k, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """The root, and for each leaf its siblings' digests before and after it, level by level."""
    paths, at, nodes = [[] for _ in leaves], [*range(len(leaves))], leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *plain_tree([*map(leaf, own)])
    root, upper = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        own, sub, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            whole = path + above
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf((*r[:4], r[4].replace("\n", ""))) if hit else leaf(r)
            for a, b in whole:
                fold = sha(a + fold + b)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in whole)), fold, fold == root))
    return out


def manifest_rows(df):
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    made = merkle.manifest(df, lost)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof"), merkle.folded(F.coalesce("other_leaf", "leaf")).alias("folded"))


def test_manifest_against_a_plain_tree(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 400), rng.choice(["a", "b", None, "", "é", "zz", "𝄞"]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["x\ny", "", None, "ü" * 50 + "\n", "plain"])) for _ in range(300)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, "n"), (7, "alone", "en", 1, "one\n"), (8, "b", "en", 1, "same"), (8, "b", "en", 1, "same"), (9, "long", "en", 1, "y\n" * 100_000)]
    rows += [(i, "full", None, i, f"{i}\n") for i in range(81)] + [(i, "over", None, i, f"{i}\n") for i in range(82)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("leaf", "digest", "tree", "idx", "n", "part", "path", "level", "of")})
    got = [(*r, r["folded"] == r["root"]) for r in manifest_rows(df).collect()]
    assert collections.Counter(got) == collections.Counter(plain_manifest(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 4])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, None, "en", 1, "t\n") for i in range(n)]
    got = [(*r, r["folded"] == r["root"]) for r in manifest_rows(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))


def test_manifest_numbers_rows_of_groups_over_many_ranges(spark):
    rows = common.written(spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), (F.col("id") * 7919 % 5000).alias("doc_id")).repartition(13), "test-numbers")
    made = merkle.numbered(rows, ["source"], ["doc_id"]).collect()
    by = collections.defaultdict(list)
    for r in made:
        by[r["source"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["doc_id"])
        assert [r["idx"] for r in own] == [*range(len(own))] and {r["n"] for r in own} == {len(own)} and len({r["tree"] for r in own}) == 1
    assert [by[s][0]["tree"] for s in sorted(by)] == sorted(by[s][0]["tree"] for s in by)


def plain_whitening(rows, k=8):
    """By the covariance itself and numpy's eigenvectors."""
    x = np.array(rows, object)
    n, s = len(x), x.sum(0)
    c = np.array((x * n - s), float) / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    values, columns = values[::-1], columns[:, ::-1]
    return [int(((r * n - s) ** 2).sum()) for r in x], c @ columns[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), values[:k] / values.sum()


def shifted(v):
    return [math.floor(1024 * c) + 100_000 for c in v]


def held_against(df, made, tolerance=1e-8):
    vecs = {r["vec_id"]: [*map(float, r["embedding"])] for r in df.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    ids = sorted(vecs)
    deviation, white, explained = plain_whitening([shifted(vecs[i]) for i in ids])
    rows = made.collect()
    k = min(8, white.shape[1])
    assert len(rows) == len(ids) * k
    got = np.zeros((len(ids), k))
    at = {v: i for i, v in enumerate(ids)}
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]] and r["n"] == len(ids) and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((got * white[:, :k]).sum(0))
    assert np.abs(got * signs - white[:, :k]).max() < tolerance


def test_whitening_of_the_whole_table(spark):
    df = common.table(spark, SF, "embeddings")
    held_against(df, whitening.op12_embedding_whitening(spark, SF))


@pytest.mark.parametrize("block", [16, 24])
def test_whitening_by_many_passes_of_narrow_blocks(spark, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 120)) * np.geomspace(3, 0.3, 120)
    df = common.written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3), "test-white")
    held_against(df, whitening.whiten(df, block=block, most=block), 1e-7)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("clash"), "component": F.lit("clash"), "n": F.lit("clash")})
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = make(good + odd)
    held_against(df, whitening.whiten(df))
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make(odd)).collect() == []
    assert whitening.whiten(make(good[:1])).collect() == [] and whitening.whiten(make([(i, [0.5, 0.25]) for i in range(9)])).collect() == []
    # Repeated rows, null ids, and a shorter vector, which ends in zeros.
    twice = whitening.whiten(make(good + good + [(None, [1.0, 2.0])])).collect()
    assert len(twice) == 121 * 5 and {r["n"] for r in twice} == {121}
    # One dimension that doesn't vary, and one that follows another: fewer components.
    flat = whitening.whiten(make([(i, [v[0], v[0], 3.0]) for i, v in good])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["identity_error"] < 1e-9
    # Very large components: no crash; what no long holds is null.
    large = whitening.whiten(make(good + [(200, [1e300, 0.0, 0.0, 0.0, 0.0])])).collect()
    assert {r["n"] for r in large} == {61} and {r["deviation"] for r in large if r["vec_id"] == 200} == {None}


def plain_top(rows, k=10):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(x):
        if i is not None and i % 100 == 0:
            found = sorted((-sum(s * t for s, t in zip(q, v, strict=False)), j is None, j or 0) for b, (j, v) in enumerate(x) if a != b)[:k]
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(found, 1)]
    return collections.Counter(out)


def found(df, **options):
    return collections.Counter(map(tuple, top_k.top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_on_odd_tables(spark, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"x": F.lit("clash"), "row": F.lit("clash"), "query": F.lit("clash")})
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(450)]
    rows += [(1000 + i, [1.0, 0.0, 0.5, 0.0, 0.0, -1.0]) for i in range(200)]  # a third of equal vectors
    rows += [(100, rows[100][1]), (100, rows[100][1]), (None, rows[100][1]), (1300, [0.0] * 6), (1400, [0.5]), (1500, None), (1600, [None] * 6), (1700, [float("nan")] * 6), (1800, [1.0, float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    assert found(make(rows)) == plain_top(rows)
    # Queries in several blocks, of small blocks of vectors.
    monkeypatch.setattr(top_k, "BLOCK", 64)
    assert found(make(rows), query_bytes=200) == plain_top(rows)
    assert found(make(rows[:4])) == plain_top(rows[:4]) and found(make([])) == collections.Counter() == found(make(rows[1:50]))
    # Components so large that doubles would round their bounds, and products beyond a long.
    large = [(i, [c * 2.0**20 for c in v]) for i, v in rows[:300]]
    assert found(make(large)) == plain_top(large)
    assert all(s in (2**63 - 1, -(2**63)) for _, _, _, s in found(make([(0, [1e300]), (1, [1e300]), (2, [-1e300])])))


def test_bounds_keep_every_vector_that_can_qualify():
    rng = np.random.default_rng(7)
    read = []
    for trial in range(60):
        x = rng.integers(-50, 50, (700, 12)) if trial % 2 else rng.integers(-2, 3, (700, 12)) + 40 * (rng.random((700, 1)) < 0.02)
        q, own, k = rng.integers(-30, 30, (5, 12)) * (rng.random((5, 12)) < 0.8), rng.integers(-1, 700, 5), 10
        floor = np.where(rng.random(5) < 0.5, -np.inf, np.sort(x @ q.T, 0)[-30])
        for i, alive in enumerate(top_k.Lists(x).survivors(q, k, floor, own)):
            scores = np.where(np.arange(700) == own[i], -(10**9), x @ q[i])
            assert {*np.flatnonzero((scores >= max(floor[i], np.sort(scores)[-k])) & (np.arange(700) != own[i])).tolist()} <= {*alive.tolist()} and own[i] not in alive
            read.append(len(alive))
    assert np.median(read) < 100


def test_whole_numbers_of_vectors(spark):
    df = spark.createDataFrame([(1, [0.0009, -0.0009, 1.0]), (2, []), (3, [None]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["x"]) for r in vectors.whole_vectors(df, 5).orderBy("vec_id").collect()] == [(1, [5, 4, 1029]), (2, [])]


def test_scopes_of_two_threads_are_apart(spark):
    ready, go, seen = threading.Event(), threading.Event(), {}

    def other():
        with common.scope() as paths:
            ready.set()
            go.wait(30)
            common.written(spark.range(1), "test-other")
            seen["other"] = [*paths]

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(30)
    with common.scope() as outer, common.scope() as inner:
        common.written(spark.range(1), "test-own")
        go.set()
        thread.join()
    assert inner == outer and len(inner) == len(seen["other"]) == 1 and inner != seen["other"]


def test_a_file_listed_twice_gives_rows_of_their_own(spark):
    path = f"{SF}/documents.parquet"
    twice, once = spark.read.parquet(path, path), spark.read.parquet(path)
    assert common.on_files(once) is once
    rows = common.on_files(twice).select(common.place().alias("p"))
    assert rows.count() == rows.distinct().count() == 2 * once.count()
    kept = exact_dedup.exact_groups(common.on_files(twice)).where("kept").count()
    assert kept == exact_dedup.exact_groups(once).where("kept").count()


def test_mix_where_one_id_is_a_third_of_all_rows(spark):
    """Ranges with more rows than a task should hold are cut into parts, and the mix is the same."""
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 and i < 600 else i, "a" if i % 4 else rng.choice(["b", None]), " ".join("w" * rng.choice([0, 1, 3, 3, 9]))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    mixed = lambda **k: collections.Counter(map(repr, mixing.mix(df, **k).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    whole = mixed()
    assert whole == mixed(rows_per_range=20) == mixed(rows_per_range=3)
    assert whole.total() == 1500
