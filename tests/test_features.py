"""Topic tables, token products, huge documents, page sources, stage versions, wide tables, services, counts, plugs and draws: against plain versions."""

import collections
import http.server
import math
import random
import re
import socketserver
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerloom.functions.annotators import lemma_annotator, segmenter, service_annotator
from ledgerloom.operators import analysis as A
from ledgerloom.operators import embed as E
from ledgerloom.operators import layout as L
from ledgerloom.operators import scope, text
from ledgerloom.operators import topics as K
from ledgerloom.plans import flows, registry, standins
from ledgerloom.sources import io, workbook
from ledgerloom.sources.pages import read_pages

SF = "/root/testdata/sf0.001"


def plain_topics(topics, s):
    found = []
    for i, (t, ws) in enumerate(topics):
        words = sorted({m.strip(" ") for m in re.findall(" |".join(" " + w for w in ws) or " ", s)})
        if words:
            found.append((-len(words), i, t, words))
    best = min(found, default=(0, 0, "outofscope", []))
    return len(found), best[2], best[3]


def test_topics_by_table_against_the_rule(spark):
    """Last keywords as prefixes, adjacent ones, patterns of every kind, long ones, topics without keywords, equal sentence ids."""
    rng = random.Random(1)
    vocabulary = ["water", "ab", "energy", "use", "fuel", "fuels", "x", "no", "a.b", "wat", "the", "thé", "c", "cc"]
    fixed = [
        ("t1", ["ab", "water"]), ("t2", ["energy use", "fuel"]), ("t3", []), ("t4", ["fuel", "wat"]), ("t5", ["the.", "x"]), ("t6", ["a.b", "fu.l", "use"]), ("t7", ["c+", "no"]),
        ("t8", ["(?:no|x) use", "ab"]), ("t9", [".", "zz"]), ("t10", ["fuels? no", "use"]), ("t11", ["ab|x", "c"]), ("t12", ["energy use fuel water x no ab", "thé"]), ("t13", ["th"]), ("t14", ["water fuel use energy no x", "q"]), ("t15", ["e*nergy", "cc"]),
    ]
    topics = fixed + [(f"r{i}", sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 5))})) for i in range(40)]
    sents = ["", "water", "water first", "the water ab end", "a water fuel water ab x", "energy use fuel water x no abc", "the fuels no use"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    table = spark.createDataFrame([(i, t, ws) for i, (t, ws) in enumerate(topics)], "ord int, topic string, keywords array<string>")
    # Several rows share an id.
    df = spark.createDataFrame([(i // 2, s, "kept") for i, s in enumerate(sents)], "sent_id long, text string, lemma_ string")
    got = collections.Counter((r["sent_id"], r["text"], r["ntopics"], r["kw_topic1"], tuple(r["keywords1"]), r["lemma_"]) for r in K.kwtopics(df, table).collect())
    want = collections.Counter((i // 2, s, n, t, tuple(ws), "kept") for i, s in enumerate(sents) for n, t, ws in [plain_topics(topics, s)])
    assert got == want
    one = K.kwtopics(df, table.where("topic in ('t1', 't2', 't4')")).collect()
    assert {(r["text"], r["ntopics"], r["kw_topic1"]) for r in one} == {(s, *plain_topics([topics[i] for i in (0, 1, 3)], s)[:2]) for s in sents}
    assert {r["kw_topic1"] for r in K.kwtopics(df, table.limit(0)).collect()} == {"outofscope"} and K.kwtopics(df.limit(0), table).count() == 0
    with pytest.raises(ValueError):
        K.kwtopics(df, table, strict_words=True)


def test_topics_by_table_as_by_dict(spark):
    sents = standins.sents(spark, SF)
    table = spark.createDataFrame([(i, t, ws) for i, (t, ws) in enumerate(standins.TOPICS.items())], "ord int, topic string, keywords array<string>")
    rows = lambda df: collections.Counter(map(repr, df.select("sent_id", "ntopics", "kw_topic1", "keywords1").collect()))
    made = K.kwtopics(sents, table)
    assert rows(made) == rows(K.kwtopics(sents, standins.TOPICS))
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin", 2)[-1]


def test_span_scores_against_means(spark):
    """Ties of spans and indicators, vectors that cancel out, zero vectors, and an indicator equal to a token."""
    rng = random.Random(2)
    whole = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    sents = {i: [whole() for _ in range(rng.randint(1, 9))] for i in range(60)}
    sents[60] = [[0.3, 0.1, 0.7], [1e-3, 0.2, 0.0], [-1e-3, -0.2, 0.0], [0.1, 0.1, 0.1]]
    sents[61] = [[0.0, 0.0, 0.0]] * 3
    kpis = {j: whole() for j in range(6)} | {6: [0.0, 0.0, 0.0], 7: sents[0][0], 8: sents[0][0]}

    def score(vs, k):
        m = [sum(x) / len(vs) for x in zip(*vs, strict=True)]
        both = math.sqrt(sum(x * x for x in m)) * math.sqrt(sum(x * x for x in k))
        return round(sum(a * b for a, b in zip(m, k, strict=True)) / both if both else 0.0, 12)

    tokens = spark.createDataFrame([(i, p, f"w{p}", v) for i, vs in sents.items() for p, v in enumerate(vs)], "sent_id long, pos int, token string, v array<double>")
    listed = spark.createDataFrame([(j, f"k{j}", v) for j, v in kpis.items()], "kpi_id long, kpi string, v array<double>")
    every = {(i, x, y, j): score(vs[x:y], k) for i, vs in sents.items() for x in range(len(vs)) for y in range(x + 1, min(len(vs), x + 5) + 1) for j, k in kpis.items()}
    got = {(r["sent_id"], r["x"], r["y"], r["kpi_id"]): r["score"] for r in E.ngram_scores(tokens, listed).collect()}
    assert got.keys() == every.keys() and all(abs(got[k] - v) < 2e-12 for k, v in every.items())
    best = {i: min((-s, x, y, j) for (n, x, y, j), s in every.items() if n == i) for i in sents}
    made = {r["sent_id"]: (r["ngram"], r["kpi_ngram"]) for r in E.compare_ngrams(tokens, listed).collect()}
    assert made == {i: (" ".join(f"w{p}" for p in range(x, y)), f"k{j}") for i, (_, x, y, j) in best.items()}


def test_label_matches_by_one_grouping(spark):
    plan = registry.QUERIES["compare_clean"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(pos") == 1


def layout_rows(spark, rng, docs):
    rows = [(doc, page, pos, rng.choice(["a", "b.", "c!", "- \n", "-", " -\nnext", "d\n\n\ne", "f?", "One. Two", " - x", "", "end. -\n"])) for doc in range(docs) for page in range(rng.randint(1, 6)) for pos in range(rng.randint(0, 5))]
    return spark.createDataFrame(rows, "doc_id long, page int, pos int, text string")


def test_sentences_of_runs_are_those_of_whole_documents(spark):
    df = layout_rows(spark, random.Random(3), 150)
    df = df.unionByName(spark.createDataFrame([(500, 0, 0, "- \n"), (500, 0, 1, "-"), (501, 0, 0, "a."), (501, 3, 0, "-\nb."), (501, 4, 0, "-\nc."), (501, 4, 1, "d"), (None, 1, 1, "x. y."), (None, None, 1, "z.")], df.schema))
    want = text.sentences(L.merge_pages(df)).collect()
    for pages, size in ((64, 4096), (2, 2), (1, 1)):
        got = L.sentences_of_runs(L.merge_runs(df, pages), size=size).select("doc_id", "sent_pos", "text", "sent_id").collect()
        assert collections.Counter(map(repr, map(tuple, got))) == collections.Counter(repr((r["doc_id"], r["sent_pos"], r["text"], r["sent_id"])) for r in want), (pages, size)


def test_a_huge_document_is_spread_over_tasks(spark):
    """One document of 10^6 blocks: no task numbers a large part of it, and the text is the same."""
    n, pages = 1_000_000, 20_000
    i = F.col("id")
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("doc_id"), (i % pages).cast("int").alias("page"), F.floor(i / pages).cast("int").alias("pos"), F.concat((i * 7919 % 10007).cast("string"), F.when(i % 3 == 0, ".").otherwise("")).alias("text"))
    parts, shuffles = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        runs = L.merge_runs(df).withColumn("task", F.spark_partition_id())
        tasks = sorted(r["n"] for r in runs.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())
        made = L.merge_pages(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert len(tasks) == 32 and tasks[-1] < 2 * sum(tasks) / 32
    groups, run = [], []
    for page in range(pages):
        for pos in range(n // pages):
            j = pos * pages + page
            run.append(f"{j * 7919 % 10007}" + ("." if j % 3 == 0 else ""))
            if j % 3 == 0:
                groups.append("\n".join(run))
                run = []
    assert [r["text"] for r in made] == ["\n\n".join(groups + (["".join(run)] if run else []))]


def lined(notes):
    """A reader for tests: a count, and 16 bytes per page. Every opened page is noted in a file."""

    class Lined:
        def count(self, file):
            file.seek(0)
            return int(file.read(8))

        def page(self, file, number):
            with open(notes, "a") as f:
                f.write(f"{number}\n")
            file.seek(8 + 16 * (number - 1))
            return file.read(16).rstrip()

    return Lined()


def test_only_the_pages_asked_for_are_opened(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, n in (("a.doc", 40), ("deep/b.v2.doc", 7), ("c.doc", 0), ("d.txt", 3)):
        (tmp_path / "in" / name).write_bytes(f"{n}\n".encode().ljust(8) + b"".join(f"{name} {i}".encode().ljust(16) for i in range(1, n + 1)))

    def run(where=None, **options):
        notes = tmp_path / f"notes-{random.random()}"
        notes.touch()
        df = read_pages(spark, str(tmp_path / "in"), lined(str(notes)), pattern="*.doc", **options)
        rows = (df if where is None else df.where(where)).select("doc_id", "page", "content").collect()
        return sorted((r["doc_id"], r["page"], bytes(r["content"]).decode()) for r in rows), sorted(map(int, notes.read_text().split()))

    every = sorted([("a", i, f"a.doc {i}") for i in range(1, 41)] + [("b.v2", i, f"deep/b.v2.doc {i}") for i in range(1, 8)])
    # The notes are of this machine's tasks only; counts of rows hold anywhere.
    assert run() == (every, sorted(i for _, i, _ in every))
    for options in ({}, {"splitBytes": 64, "pagesPerTask": 3}):
        want = [r for r in every if 5 <= r[1] <= 9]
        assert run(first=5, last=9, **options) == (want, sorted(i for _, i, _ in want))
        assert run(first=38, **options)[1] == [38, 39, 40] and run(last=2, **options)[0] == every
        assert run("page = 6", **options)[1] == [6, 6] and run("page < 3 and page > 1 and doc_id = 'a'", **options) == ([("a", 2, "a.doc 2")], [2, 2])
        assert run("page > 40", **options) == ([], [])


def test_stages_are_made_anew_when_what_they_read_changes(spark, tmp_path):
    source, store = str(tmp_path / "source"), io.StageStore(spark, str(tmp_path / "stages"))
    spark.range(5).write.parquet(source)
    make = lambda least=0: (lambda: spark.read.parquet(source).where(F.col("id") >= least))
    versions = lambda: len([*(tmp_path / "stages" / "s").glob("*/v*")])
    assert store.get("s", make()).count() == store.get("s", make()).count() == 5 and versions() == 1
    assert store.get("s", make(3)).count() == 2 and versions() == 2
    assert store.get("s", make(), model="b").count() == 5 and versions() == 3
    old = store.get("s", make())
    spark.range(9).write.mode("overwrite").parquet(source)
    assert store.get("s", make()).count() == 9 and versions() == 4
    assert old.count() == 5  # who read the old version still does
    # Past its time a stage is made anew; the version before stays for its readers, older ones go, and none is ever half there.
    late = io.StageStore(spark, str(tmp_path / "stages"), ttl=-1)
    before = late.get("t", make())
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(len(late.versions("t", late.fingerprint(make()()))))

    watcher = threading.Thread(target=watch)
    watcher.start()
    late.get("t", make())
    assert before.count() == 9
    late.get("t", make())
    stop.set()
    watcher.join()
    assert min(seen) >= 1 and len([*(tmp_path / "stages" / "t").glob("*/v*")]) == 2
    assert not [*(tmp_path / "stages").glob("*/.making*")]


def test_wide_cross_tables(spark):
    df = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r1", "zz"), ("r2", None), ("outofscope", "b"), (None, "b")], "r string, c string")
    headers = spark.createDataFrame([("T", "b"), ("S", "a"), ("U", "never"), ("A", "b"), ("o", "outofscope")], "topic string, subtopic string")
    wide = A.crosstab_wide(df, "r", "c", headers)
    assert wide.columns == ["r", "S__a", "T__b", "U__never", "o__outofscope", "__other"]
    assert {r[0]: tuple(r)[1:] for r in wide.collect()} == {"r1": (2, 0, 0, 0, 1), "r2": (0, 0, 0, 0, 1), "outofscope": (0, 1, 0, 0, 0), None: (0, 1, 0, 0, 0)}
    report = A.crosstab_report(df.where("r is not null"), "r", "c", headers.where("topic <> 'A'")).collect()
    assert {(r["topic"], r["subtopic"], r["r"], r["S__a"]) for r in report} == {("S", "a", "r1", 2), ("T", "b", None, 0), ("U", "never", None, 0), ("o", "outofscope", "r2", 0), ("o", "outofscope", "outofscope", 0)}
    with pytest.raises(ValueError):
        A.crosstab_wide(df, "r", "c", headers, most=2)


def test_workbooks_of_a_folder_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "kpi string, value double, ok boolean"
    for i in range(3):
        workbook.write_sheets(str(tmp_path / "in" / f"b{i}.xlsx"), {"KPIs": spark.createDataFrame([(f"k{i}", i + 0.5, True), (None, None, None), ("5", 3.0, False)], schema)})
    got = workbook.read_sheet(spark, str(tmp_path / "in" / "*.xlsx"), "KPIs")
    assert got.dtypes == [("kpi", "string"), ("value", "double"), ("ok", "boolean")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(f"k{i}", i + 0.5, True) for i in range(3)] + [("5", 3.0, False)] * 3))
    workbook.write_sheets(str(tmp_path / "in" / "c.xlsx"), {"KPIs": spark.createDataFrame([("x",)], "other string")})
    with pytest.raises(ValueError):
        workbook.read_sheet(spark, str(tmp_path / "in"), "KPIs")
    workbook.write_sheets(str(tmp_path / "mixed.xlsx"), {"S": spark.createDataFrame([("1e3", 1.0), ("y", None)], "a string, b double").select("a", "b"), "empty": spark.createDataFrame([], "a string")})
    assert workbook.read_sheet(spark, str(tmp_path / "mixed.xlsx"), "empty").columns == ["a"]


class Stalling(http.server.BaseHTTPRequestHandler):
    calls: collections.Counter = collections.Counter()
    open = most = 0
    lock = threading.Lock()

    def do_POST(self):
        own = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).get("text", [""])[0]
        with self.lock:
            self.calls[own] += 1
            nth = self.calls[own]
            Stalling.open += 1
            Stalling.most = max(Stalling.most, Stalling.open)
        try:
            time.sleep(3 if own == "stalls" or (own == "late" and nth == 1) else 0.02)
            status = 500 if own == "fails" or (own == "shaky" and nth < 3) else 400 if own == "refused" else 200
            body = f'[{{"text": "{own}", "start": 0}}]'.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
        except OSError:
            pass
        finally:
            with self.lock:
                Stalling.open -= 1

    def log_message(self, *_):
        pass


class Server(socketserver.ThreadingMixIn, http.server.HTTPServer):
    daemon_threads, request_queue_size = True, 64


def test_a_service_that_stalls_and_fails(spark):
    from ledgerloom.functions.text import entity_reply, entity_texts

    server = Server(("127.0.0.1", 0), Stalling)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    texts = ["fails", "stalls", "late", "shaky", "refused", "é & +", None] + [f"t{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id long, text string").coalesce(1)
    ask = service_annotator(f"http://127.0.0.1:{server.server_port}/parse", timeout=1, retries=2, wait=0.05, at_once=4, batch=16)
    got = {r["text"]: r for r in ask(df).withColumn("found", entity_texts(entity_reply(F.col("reply")))).collect()}
    server.shutdown()
    assert len(got) == len(texts) and Stalling.most <= 4 + 3  # those that have timed out may still be open at the server
    assert got["fails"]["reply"] is None and got["fails"]["error"] == "HTTP 500" and Stalling.calls["fails"] == 3
    assert "imed out" in got["stalls"]["error"] and got["refused"]["error"] == "HTTP 400" and Stalling.calls["refused"] == 1
    assert got["late"]["error"] is None and got["shaky"]["error"] is None and got["é & +"]["found"] == "é & +" and got["t7"]["found"] == "t7"
    gone = service_annotator("http://127.0.0.1:9/", timeout=1, retries=0)(df.limit(1)).first()
    assert gone["reply"] is None and gone["error"]


def test_counts_without_a_pass_of_their_own(spark):
    counts, sents = Observation("scoped"), standins.topics(spark, SF)
    rows = scope.inscope(flows.observed_scope(standins.classify(sents), counts))
    kept = len(rows.collect())
    want = registry.QUERIES["scope_counts"](spark, SF).first().asDict()
    assert counts.get == want and kept == want["inscope"]
    blocks = standins.blocks(spark, SF)
    flagged, scoped = Observation("flagged"), Observation("report")
    ids = lambda s: s.withColumns({"esg_topic": F.when(F.col("sent_pos") % 2 == 0, "energy").otherwise("outofscope"), "esg_score": F.lit(0.9)})
    made = flows.report_flow(blocks, standins.TOPICS, ids, flagged=flagged, scoped=scoped)
    n = len(made.collect())
    every = text.sentence_filter(flows.rule_annotator(text.sentences(L.merge_pages(L.reading_order(L.column_clusters(L.text_not_in_figure(blocks)))))))
    assert flagged.get == {"n": every.count(), "accepted": every.where("accepted").count()} and scoped.get["n"] == flagged.get["accepted"] and scoped.get["inscope"] == n
    assert "esg2_" not in made.columns


def test_plugs_for_segments_and_lemmas(spark):
    split = segmenter(lambda: lambda t: [p for p in t.split(";") if p])
    docs = spark.createDataFrame([("a", "one;two things"), ("b", ""), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, text.sentences(docs, split).select("sent_id", "text").collect())) == [("a:0", "one"), ("a:1", "two things")]
    lemmas = lemma_annotator(lambda: lambda texts: [t.lower().replace("waters", "water") for t in texts])
    sents = spark.createDataFrame([(0, "The waters here"), (1, None), (2, "no")], "sent_id long, text string")
    table = spark.createDataFrame([(0, "W", "waters,x", None), (1, "N", None, None)], "ord int, subtopic string, unigrams string, bigrams string")
    dictionary = K.topic_keywords(table, lemmas)
    assert {r["topic"]: r["keywords"] for r in dictionary.collect()} == {"W": ["water", "x"], "N": []}
    for given in (dictionary, {"W": ["water", "x"], "N": []}):
        got = {r["sent_id"]: (r["ntopics"], r["kw_topic1"], r["keywords1"]) for r in K.kwtopics(sents, given, lemmas=lemmas).collect()}
        assert got[0] == (2, "W", ["water"]) and got[1] == got[2] == (0, "outofscope", [])
    rows = [(1, 0, i, "Text", t, 0.0, float(i), 1.0, i + 1.0) for i, t in enumerate(["The waters;", "12 waters needed often;and 7 more boxes given.", "Nothing here."])]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, block int, type string, text string, x0 double, y0 double, x1 double, y1 double")
    got = flows.report_flow(blocks, {"W": ["water", "x"]}, lambda s: s.withColumns({"esg_topic": F.lit("e"), "esg_score": F.lit(0.9)}), split=split, lemmas=lemmas).collect()
    assert sorted((r["sent_id"], r["kw_topic1"]) for r in got) == [("1:1", "W"), ("1:2", "outofscope")]
    pages = spark.createDataFrame([("r", 0, "Using 12 boxes needed often;" + "x" * 90)], "doc_id string, page int, text string")
    assert [r["accepted"] for r in flows.preprocess(pages, split=split).orderBy("sent_pos").collect()] == [True, False]


def test_draws_with_replacement(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    draw = lambda n, **k: [(r["draw"], r["key"]) for r in A.sample_with_replacement(df, n, "key", **k).orderBy("draw").collect()]
    once = draw(3000)
    assert once == draw(3000) and [i for i, _ in once] == [*range(3000)] and once[:100] == draw(100) and once != draw(3000, seed=1)
    each = collections.Counter(k for _, k in once)
    assert len(each) > 290 and max(each.values()) < 30
    assert A.sample_with_replacement(df.limit(0), 5, "key").count() == 0 and draw(0) == []
    for rows in (300, 40, 1):
        ranks = sorted((r["rank"], r["key"]) for r in A.numbered(df, 0, "key", rows).collect())
        assert [r for r, _ in ranks] == [*range(300)] and [k for _, k in ranks] == [r["key"] for r in df.orderBy(*A.shuffled(0, "key")).collect()]
