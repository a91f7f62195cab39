"""How often a query reads its table and computes its expressions: what makes the seconds and the shuffle of large tables."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.keywords import TopicSearch
from ledgerloom.operators import analysis as A
from ledgerloom.operators import layout as L
from ledgerloom.operators import text as T
from ledgerloom.operators import topics as K
from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_f7_flags_are_computed_once(spark):
    plan = optimized(spark, "accepted_rejected")
    assert plan.count("[A-Za-z]{5,}") == 1
    flags = spark.createDataFrame([(True,), (False,), (None,)], "accepted boolean")
    assert [tuple(r) for r in T.parted(flags).collect()] == [(True, "accepted"), (False, "rejected")]


def test_f7_rules_of_text_against_their_plain_forms(spark):
    plan = optimized(spark, "text_filter")
    assert "Contains(text" in plan  # texts without line ends are left alone
    draw = random.Random(7)
    texts = ["".join(draw.choice(["a", "B", "-", "\n", " ", "\t", "\x0b", "\x85", "　", ".", "?!", "é", "\r"]) for _ in range(draw.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    filtered = F.regexp_replace("x", rf"{X.SPACE}*-{X.SPACE}*\n", "")
    filtered = F.regexp_replace(F.regexp_replace(filtered, rf"\n{X.SPACE}*\n", "\n"), rf"{X.SPACE}*\n{X.SPACE}*", " ")
    split = F.split(F.regexp_replace(F.trim("x"), r"([.!?]+)[ \t\n\x0B\f\r]+", "$1\n"), "\n")
    lemma = F.replace(F.trim(F.regexp_replace(F.lower("x"), rf"{X.SPACE}+", " ")), F.lit(" - "), F.lit("-"))
    pairs = ((X.text_filter(F.col("x")), filtered), (X.split_sentences(F.col("x")), split), (X.lemmatize(F.col("x")), lemma))
    for made, plain in pairs:
        assert df.where(~made.eqNullSafe(plain)).collect() == []


def test_f8_keywords_share_the_blank_in_front(spark):
    assert "(?:thing |then)" in optimized(spark, "missing_subtopics")
    draw = random.Random(8)
    topics = {"a": ["thing", "then"], "b": ["with the", "of the"], "c": ["x-y", "th"], "d": ["th.n", "of"], "e": ["of"], "f": []}
    texts = [" ".join(draw.choice(["thing", "then", "thens", "with", "the", "of", "x-y", "th", "thin"]) for _ in range(draw.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    for r in K.kwtopics(df, topics).collect():
        found = {t: sorted({w.strip(" ") for w in re.findall(p, r["text"])}) for t, p in K.patterns(topics)}
        best = sorted(((-len(ws), i, t) for i, (t, ws) in enumerate(found.items()) if ws))
        assert (r["ntopics"], r["kw_topic1"], r["keywords1"]) == ((len(best), best[0][2], found[best[0][2]]) if best else (0, "outofscope", []))


def reads(spark, name):
    return optimized(spark, name).count("Relation [")


def test_f5_dominant_reads_its_counts_once(spark):
    assert reads(spark, "dominant_subtopic") == 1
    counts = spark.createDataFrame([("r", "b", 2), ("r", "a", 2), ("r", None, 9), ("n", None, 1), (None, "a", 3)], "r string, c string, n long")
    assert {r["r"]: r["top"] for r in A.dominant(counts, "r", "c").collect()} == {"r": "a", "n": "outofscope", None: "outofscope"}


def test_f4_the_report_reads_its_table_once(spark):
    assert reads(spark, "crosstab_report") == 1
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("s", None), (None, "a")], "r string, c string")
    headers = spark.createDataFrame([("T", "a"), ("o", "outofscope")], "topic string, subtopic string")
    assert sorted(map(tuple, A.crosstab_report(df, "r", "c", headers).collect())) == [("T", "a", "r", 1, 0, 1), ("o", "outofscope", "s", 0, 0, 1)]


def test_f3_draws_number_only_the_ranges_drawn(spark):
    assert reads(spark, "sample_replaced") == 1
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3).alias("part"))
    rows = [tuple(r) for r in df.orderBy(*A.shuffled(0, "key")).collect()]
    got = A.sample_with_replacement(df, 700, "key").orderBy("draw").collect()
    want = [int(hashlib.md5(f"0:draw:{i}".encode()).hexdigest()[:15], 16) % 5000 for i in range(700)]
    assert [tuple(r) for r in got] == [(i, *rows[k]) for i, k in enumerate(want)]


def exchanges(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def some_blocks(spark):
    draw = random.Random(2)
    text = lambda: draw.choice([None, "", " ", "-", " - \n", "- item.", "a b", "Ends.", "x?", "\n", "y\n\nz", "w-\n", " -\nq!"])
    rows = [(d, p, k, text()) for d in (None, *range(60)) for p in range(draw.randrange(1, 9)) for k in range(draw.randrange(4))]
    return spark.createDataFrame(rows, "doc_id int, page int, pos int, text string")


def test_f9_merged_pages_take_one_exchange(spark):
    assert exchanges(spark, "merge_pages") == 1
    blocks = some_blocks(spark)
    runs = collections.defaultdict(list)
    for r in L.merge_runs(blocks, 2).collect():
        runs[r["doc_id"]].append((r["run"], r["text"]))
    assert {r["doc_id"]: r["text"] for r in L.merge_pages(blocks).collect()} == {d: "\n\n".join(t for _, t in sorted(own)) for d, own in runs.items()}


def test_f2_sentences_of_blocks_are_joined_where_they_are(spark):
    plan = registry.QUERIES["report_sentences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(coalesce(" not in plan  # joins find rows where windows and groupings have dealt them
    blocks = some_blocks(spark)
    rows = lambda df: sorted(map(repr, map(tuple, df.select("doc_id", "sent_pos", "text").collect())))
    want = rows(T.sentences(L.merge_pages(blocks)))
    for pages, size in ((1, 1), (2, 3), (64, 4096)):
        assert rows(L.sentences_of_blocks(blocks, pages=pages, size=size)) == want


def by_rule(topics, s):
    """Number of topics, place of the first with the most keywords, and these, by the patterns as they stand."""
    found = [(i, sorted({m.group().strip(" ") for m in re.finditer(p, s)})) for i, (_, p) in enumerate(K.patterns({str(i): ws for i, ws in enumerate(topics)}))]
    best = min(((-len(ws), i, ws) for i, ws in found if ws), default=(0, None, []))
    return sum(bool(ws) for _, ws in found), best[1], best[2]


def test_f1_topics_of_the_sheet_are_looked_up_in_place(spark):
    """No sentence is dealt out or joined: all of it is the one pass over the documents."""
    plan = registry.QUERIES["kwtopics_from_sheet"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and not any(s in plan for s in ("Join", "Exchange", "Aggregate"))


def test_f1_words_against_patterns():
    draw = random.Random(1)
    word = lambda signs, most: "".join(draw.choice(signs) for _ in range(draw.randint(0, most)))
    for signs in ("ab", "ab.", "ab .", "aé.b", "ab.+"):
        for _ in range(60):
            topics = [[w.lstrip("+").replace("++", "+").replace("++", "+") for w in (word(signs, draw.choice([2, 4, 8])) for _ in range(draw.randrange(5)))] for _ in range(draw.choice([1, 3, 70]))]
            search = TopicSearch(topics)
            for _ in range(30):
                s = " ".join(word("abé." if draw.random() < 0.1 else "ab", draw.choice([1, 2, 4, 9])) for _ in range(draw.randrange(10)))
                assert search.best(s) == by_rule(topics, s), (topics, s)
    # A keyword uses up the blank behind it; the last one doesn't. Dots may stand for blanks, and texts found twice count once.
    assert TopicSearch([["ab", "x"]]).best("a ab ab x xy") == (1, 0, ["ab", "x"]) and TopicSearch([["ab", "cd", "q"]]).best("a ab cd ab") == (1, 0, ["ab"])
    assert TopicSearch([["a.", "z"], [".", "ab"]]).best("x a  ab") == by_rule([["a.", "z"], [".", "ab"]], "x a  ab")
    assert TopicSearch([["t.", "th"]]).best("x th y the") == (1, 0, ["th"]) and TopicSearch([]).best("a b") == TopicSearch([["a"]]).best(None) == (0, None, [])


def test_f1_handed_and_joined_topics_agree(spark, monkeypatch):
    """Tables too large to be handed to the tasks are joined; both give the same, with the sheet's topics and with lemmas that keep blanks."""
    lemmas = lambda texts: F.transform(texts, lambda t: F.lower(t))
    topics = [["a", "b.", "the"], ["", "a"], [], ["a b", "b a"], ["(?:a|b) x", "x"], ["ab*", "b"], ["the.a", "x."]]
    table = spark.createDataFrame([*((i, f"t{i}", ws) for i, ws in enumerate(topics)), (9, "none", None)], "ord int, topic string, keywords array<string>")
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["A", "b", "", "the", "bc", "x", "there"]) for _ in range(draw.randrange(9))) for _ in range(300)]
    sents = spark.createDataFrame([*enumerate(texts), (300, None)], "sent_id int, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    handed = K.kwtopics(sents, table, lemmas=lemmas)
    assert {r["sent_id"]: (r["ntopics"], r["kw_topic1"], r["keywords1"]) for r in handed.where("text is not null").collect()} == {
        i: (n, "outofscope" if t is None else f"t{t}", ws) for i, s in enumerate(texts) for n, t, ws in [by_rule(topics, s.lower())]
    }
    made = rows(handed), rows(registry.QUERIES["kwtopics_from_sheet"](spark, SF))
    monkeypatch.setattr(K, "HANDED", 0)
    joined = K.kwtopics(sents, table, lemmas=lemmas)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert (rows(joined), rows(registry.QUERIES["kwtopics_from_sheet"](spark, SF))) == made
