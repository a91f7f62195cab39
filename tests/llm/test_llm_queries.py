"""Registered queries against their SQL, and the pipeline against a plain version of its stages."""

import collections
import hashlib
import importlib
import itertools
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm import exact_dedup, packing, registry, toxicity
from ledgerloom.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
#: Enough labels for the lexicon to learn entries.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(columns)} from ({registry.SQL[name]})").fetchall()
    assert collections.Counter(map(repr, map(tuple, df.select(*columns).collect()))) == collections.Counter(map(repr, want))


def test_entry_lists_all():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert set(registry.QUERIES) < set(names) and "pipeline" in names and [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def _plain_toxicity(rows, labels):
    marked = [(t, y) for i, t in sorted((r["doc_id"], r["text"] or "") for r in rows) for y in labels.get(i, []) if y in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    lexicon = toxicity.learn([t for t, _ in marked], [y for _, y in marked])
    return [r for r in rows if lexicon.score(toxicity.fold(r["text"] or "")) < 0.5]


def _plain_exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        best.setdefault((r["text"] or "").encode().translate(None, exact_dedup.SPACE), r)
    return list(best.values())


def _plain_near(rows):
    shingles = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        shingles.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    standing = collections.defaultdict(list)
    for i, own in enumerate(shingles):
        for x in own or ["no words"]:
            standing[x].append(i)
    for i, j in {p for own in standing.values() for p in itertools.combinations(own, 2)}:
        either = (shingles[i] | shingles[j]).total()
        if not either or (shingles[i] & shingles[j]).total() >= 0.8 * either:
            head[root(i)] = root(j)
    kept = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"]):
        kept.setdefault(root(i), rows[i])
    return list(kept.values())


def _plain_mix(rows):
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[r["doc_id"]] for r in of[s]) for s in sources}
    weight, full = {s: k % 3 + 1 for k, s in enumerate(sources)}, set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        among = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * whole[s] if s in full else rest * weight[s] / among for s in sources}
        if not (over := {s for s in sources if s not in full and target[s] > 3 * whole[s]}):
            break
        full |= over
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        epochs, left = divmod(budget, whole[s]) if whole[s] else (0, 0)
        for r in sorted(of[s], key=lambda r: hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()):
            n = size[r["doc_id"]]
            taken, left = epochs * n + min(n, left), max(0, left - n)
            out += [r] * (int(taken / n + 0.5) if n else 0)
    return out


def _plain_packing(rows, capacity=1024):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary_path())
    pieces, gaps, opened = [], [], 0
    for r in rows:
        n = len(coder.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        bounds = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
        pieces += [(r["doc_id"], k, a, b - a) for k, (a, b) in enumerate(itertools.pairwise(bounds))]
    for n in sorted((p[3] for p in pieces), reverse=True):
        if fit := [g for g in gaps if g >= n]:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
            opened += 1
    return pieces, opened


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on its own input, as ``run`` gives it, and ``run`` itself by its last rows."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, labels = docs.columns, collections.defaultdict(list)
    for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect():
        labels[r["doc_id"]].append(r["toxic"])
    plain = {"toxicity": lambda rows: _plain_toxicity(rows, labels), "exact_dedup": _plain_exact, "near_dedup": _plain_near, "mix_sources": _plain_mix}
    same = lambda rows: collections.Counter(tuple(r[c] for c in columns) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = exact_dedup.written(stage(spark, docs, LARGER), f"test-{name}")
        rows = docs.collect()
        if name == "best_fit_packing":
            pieces, opened = _plain_packing(before)
            assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == collections.Counter(pieces)
            used = collections.defaultdict(list)
            for r in rows:
                used[r["sequence_id"]].append((r["offset"], r["length"]))
            assert len(used) <= opened + opened // 1000 + 1
            for own in used.values():
                assert [a for a, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 1024
        else:
            assert docs.columns == columns and same(rows) == same(plain[name](before)), name
            assert 0 < len(rows) and (name == "mix_sources" or len(rows) < len(before)), name
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    count = lambda df: collections.Counter(tuple(r[c] for c in key) for r in df.collect())
    before = set(os.listdir(shared_dir(spark)))
    assert count(corpus_pipeline.run(spark, LARGER)) == count(docs)
    # Of the tables on the way only the last one stays.
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark))) - before] == ["pipeline-best_fit_packing"]
