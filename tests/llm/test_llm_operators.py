"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import context_tree, exact_dedup, fingerprints, html_extract, licenses, mixing, near_dedup, packing, pii, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    out = [(i, prose(rng, rng.randint(5, 60)), f"s{i % 3}") for i in range(20)]
    out += [(20, None, "s0"), (21, "", "s1"), (22, " \n\t", None), (None, "no id here", "s2"), (None, None, None)]
    out += [(30, base, "s0"), (31, base + "  ", "s1"), (32, " ".join(near), "s2"), (33, base.replace(" ", ""), "s0")]
    out += [(40, "twice", "s1"), (40, "twice", "s1"), (40, "other text of the same id", "s1")]
    out += [(50, "x" * 70_000 + " " + prose(rng, 3000), "s0"), (51, prose(rng, 5000), "s1")]
    return out


EXTRA = ("row", "key", "size", "kept", "node", "unit", "bucket", "guest", "range", "keys", "label", "unused")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(3)
    path = exact_dedup.written(df.withColumns({c: F.lit("clash") for c in EXTRA}), "test-docs")
    return path


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_large_ids_stay_whole_beside_null_ids(spark):
    big = [(1 << 60) + i for i in range(4)] + [None]
    df = exact_dedup.written(spark.createDataFrame([(i, "one same text of more than five words in all") for i in big], "doc_id long, text string").coalesce(1), "test-ids")
    made = {
        "fingerprints": fingerprints.fingerprints(df),
        "pii": pii.personal_data(df, np.zeros((4, pii.FEATURES))),
        "context_tree": context_tree.scores(df),
        "licenses": licenses.licenses(df),
        "packing": packing.pack(df),
        "exact": exact_dedup.exact_groups(df),
        "near": near_dedup.near_duplicates(df),
        "pages": html_extract.main_text(df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>x</p>").alias("html")), html_extract.train(50)),
    }
    for name, out in made.items():
        rows = out.collect()
        assert {r["page_id" if name == "pages" else "doc_id"] for r in rows} == set(big) and len(rows) == len(big), name
    assert {r["keep_id"] for r in made["exact"].collect()} == {big[0]} == {r["class_id"] for r in made["near"].collect()}


def text_of(t):
    return t or ""


def _slow_fingerprint(text):
    """The two parts of a fingerprint by their definition, one paragraph and one run of bytes at a time, in whole numbers."""
    exact, lanes, two = [0] * fingerprints.EXACT, [0] * fingerprints.ALIKE, 1 << 64
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
    for p in text.encode().split(b"\n") if text else []:
        spread = hashlib.shake_128(p).digest(2 * fingerprints.EXACT)
        for i in range(fingerprints.EXACT):
            exact[i] = (exact[i] + int.from_bytes(spread[2 * i : 2 * i + 2], "little")) % (1 << 16)
        runs = [(int.from_bytes(p[i : i + 8], "little") * a + (int.from_bytes(p[i + 2 : i + 10], "little") ^ b) * c) % two for i in range(len(p) - 9)]
        for h in runs or [int.from_bytes(spread[:8], "little")]:
            h = (h ^ h >> 32) * c % two >> 55
            lanes[h >> 1] += -1 if h & 1 else 1
    return exact, lanes


def _slow_alike(x, y):
    both, apart = sum(v * v for v in x + y), sum((v - w) ** 2 for v, w in zip(x, y, strict=True))
    return min(1.0, max(0.0, 1 - apart / both)) if both else 1.0


def test_fingerprints(docs, none):
    """Against the definition, and the next document by the order of ids, then of places."""
    order = [(r["doc_id"], text_of(r["text"])) for r in sorted(docs.select("doc_id", "text", fingerprints.tie().alias("t")).collect(), key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["t"]), reverse=True)]
    got = fingerprints.fingerprints(docs).collect()
    found, want = collections.Counter(), collections.Counter()
    for r in got:
        exact, lanes = fingerprints.parsed([r["fingerprint"], r["edited_fingerprint"]])
        found[r["doc_id"], r["n_chars"], r["edited_sha256"], *(str((e.tolist(), x.tolist())) for e, x in zip(exact, lanes, strict=True)), round(r["near_edited"], 9), round(r["near_next"], 9)] += 1
    for k, (i, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(t) // 3
        e = t[: len(t) - n] + after[:n]
        own, changed, next_ = map(_slow_fingerprint, (t, e, after))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(own), str(changed), round(_slow_alike(own[1], changed[1]), 9), round(_slow_alike(own[1], next_[1]), 9)] += 1
    assert found == want
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprint_likeness_is_that_of_the_fingerprints(docs):
    for r in fingerprints.fingerprints(docs).collect():
        assert fingerprints.alike(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"]
    assert len(fingerprints.of_paragraph("x")) < 1400


def test_fingerprint_ranges(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 50, 1000):
        bounds = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)})
        keys = [fingerprints.LOWEST, *bounds, *(b + 1 for b in bounds), *(b - 1 for b in bounds)]
        got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", fingerprints._place(F.col("key"), bounds).alias("b"), fingerprints._place(F.col("key"), bounds, True).alias("u")).collect()
        assert all(r["b"] == sum(b < r["key"] for b in bounds) and r["u"] == sum(b <= r["key"] for b in bounds) for r in got)


def test_fingerprint_ranges_of_an_id_that_stands_often(spark):
    """A third of all rows without an id, and an id that stands a thousand times: no range holds them alone, and the chain stays whole."""
    rng = random.Random(6)
    ids = [None] * 1200 + [7] * 1000 + [rng.randrange(10**6) for _ in range(1400)]
    df = exact_dedup.written(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(8), "test-ties")
    sizes = [r["count"] for r in fingerprints.chained(df).where("not guest").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) < 4 * len(ids) / len(sizes)
    order = [r["text"] for r in sorted(df.select("doc_id", "text", fingerprints.tie().alias("t")).collect(), key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["t"]), reverse=True)]
    want = collections.Counter(hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][: len(t) // 3]).encode()).hexdigest() for k, t in enumerate(order))
    assert collections.Counter(r["edited_sha256"] for r in fingerprints.fingerprints(df).collect()) == want


def test_fingerprint_is_edited_by_paragraphs():
    a, b, c = "first line of text\nsecond line here\n\nthird", "third\nfirst line of text\n\nsecond line here", "first line of text\n\nthird"
    of = lambda t: fingerprints.shown(*fingerprints.vectors([t]))[0]
    line = fingerprints.of_paragraph("second line here")
    assert of(a) == of(b) != of(c)
    assert fingerprints.combined(of(c), line) == of(a) and fingerprints.combined(of(a), line, -1) == of(c)
    assert fingerprints.combined(of(a), fingerprints.of_paragraph(""), -1) == of(a.replace("\n\n", "\n"))
    made = of("")
    for p in b.split("\n"):
        made = fingerprints.combined(made, fingerprints.of_paragraph(p))
    assert made == of(a)


def test_pii_base_rules_and_field():
    weights = pii.train()
    text = "mail a.b+c@x-y.example.com, host 10.0.255.1 or 10.0.256.1; card 4111 1111 1111 1111 not 4111 1111 1111 1112; call +1 (555) 234-5678. é@é"
    base, _ = pii.find(text, weights)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in base] == [("email", "a.b+c@x-y.example.com"), ("ip", "10.0.255.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 234-5678")]
    for s, kind in (("write to john at example dot com today", "email"), ("call (555) 234-5678 now", "phone"), ("server 10[.]0[.]0[.]12 is down", "ip")):
        assert kind in [pii.KINDS[k] for k, _, _ in pii.find(s, weights)[1]], s
    for s in ("order 123456 of 2021-04-05", "we met at the station. Nothing", "version 1.2.3"):
        assert pii.find(s, weights)[1] == [], s
    good = sum(set(pii.decode(w, weights)) == g for w, g in pii.examples(300, 99))
    assert good >= 285


def test_pii_field_reads_what_stands_beside_the_rules():
    weights = pii.train()
    shown = lambda text: [(pii.KINDS[k], text[a:b]) for own in pii.find(text, weights) for k, a, b in own]
    assert shown("+1 555 123 4567\n555-987-6543") == [("phone", "+1 555 123 4567"), ("phone", "555-987-6543")]
    assert shown("host 10.0.0.1 (555) 123-4567") == [("ip", "10.0.0.1"), ("phone", "(555) 123-4567")]
    assert shown("10.0.0.1 - 192[.]168[.]0[.]1") == [("ip", "10.0.0.1"), ("ip", "192[.]168[.]0[.]1")]
    column = "555-987-6543\n10.0.0.1\n555-222-3333\n10.0.0.2\n192[.]168[.]0[.]1"
    assert shown(column) == [("ip", "10.0.0.1"), ("ip", "10.0.0.2"), ("phone", "555-987-6543"), ("phone", "555-222-3333"), ("ip", "192[.]168[.]0[.]1")]
    # Every text is read as one: an entity is met wherever it stands.
    far = "call (555) 234-5678 " + "now and " * 40 + "call (555) 234-5679 now"
    assert len(shown(far)) == 2


def test_pii_mail_may_end_at_every_word():
    weights, mail = pii.train(), "bob [at] foo [dot] com"
    for after in (". Yes. No. Fine. Ok. Good. Then", ". Yes. No. Fine. Ok. Good. Then. So. It. Goes. On. And. On" * 9):
        assert (0, 0, len(mail)) in pii.candidates(mail + after)
        assert pii.find(mail + after, weights)[1] == [(0, 0, len(mail))]
    assert pii.find(mail.upper(), weights)[1] == [(0, 0, len(mail))]
    # Ends are counted from the start of the address, and none lies inside a word.
    own = pii.candidates("bob [at] " + "foo-bar. " * 500)
    assert len(own) == 7 and all(b % 9 == 7 for _, _, b in own)


def test_pii_field_needs_no_trigger():
    weights = pii.train()
    for s in ("bob at example.com", "bob at mail.example.org", "bob at\nexample dot com"):
        assert pii.find(f"write to {s} today", weights)[1] == [(0, 9, 9 + len(s))], s
    for s in ("call me at home. Es ist", "we met at noon. Com", "was hend at anerhe. Eres this", "the file at index.html is", "go to x at 10.30 today"):
        assert pii.find(s, weights)[1] == [], s


def test_pii_best_path_is_the_best_of_all_paths():
    weights = pii.train(60, 3)
    for window, _ in pii.examples(40, 5):
        segments = pii.candidates(window)
        if len(segments) > 12:
            continue
        score = {s: float(weights[s[0]] @ pii.span_features(window, *s)) for s in segments}
        free = lambda own: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(own, 2))
        best = max(sum(score[s] for s in own) for n in range(4) for own in itertools.combinations(segments, n) if free(own))
        assert abs(sum(score[s] for s in pii.decode(window, weights)) - best) < 1e-9


def test_pii_email_matches_the_pattern():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-+ é1") for _ in range(rng.randint(0, 14)))
        assert pii._emails(t) == [m.span() for m in pii.EMAIL.finditer(t)], t


def _plain_base(text):
    """The rules as they are stated: each pattern as it stands, failing matches dropped."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        own = [int(c) for c in digits(s)[::-1]]
        return 13 <= len(own) <= 19 and (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m[0])]


def test_pii_base_against_the_patterns():
    rng = random.Random(7)
    parts = ["1", "12", "255", "256", "0001", ".", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "a", "@", "b.c", "\n", "é", "192.168.0.1", "+49 170 1234567"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == _plain_base(t), t


def test_pii_table(spark, docs, none):
    texts = [t for _, t, _ in rows()] + ["mail a.b@c.example, host 10.0.0.1, 010.1.1.255 and 1.2.3.256", "card 4111-1111 11111111 +1 (555) 234-5678 +12 3", "é@é x@y.z é1.2.3.4é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        base = _plain_base(text_of(texts[r["doc_id"]]))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        shown = [f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda x: (pii.KINDS.index(x[0]), x[1]))]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans) and len(spans) == len(base) + r["n_added"] == r["n_spans"]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
    assert pii.personal_data(docs).count() == len(rows())
    assert pii.personal_data(none).count() == 0


@pytest.mark.parametrize("piece", ["1", "5.1.2.3 ", " ", "\n", "x", "a.", "a@b.c ", "x at ", "1 ", "1(", "+1", "bob [at] foo. ", "a@b."])
def test_pii_takes_time_in_proportion(piece):
    weights = pii.train(60, 2)
    seconds = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        pii.find((piece * n)[:n] + "@x.com", weights)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 20 * seconds[0] + 0.5


def test_pii_numbers_of_any_length(spark):
    texts = ["5" * 5000 + ".1.2.3", "0" * 5000 + "1.2.3.4", "1" * 1_000_000, "1." * 500_000, " " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000 + "@y.com"]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_ip"] for i in range(7)] == [0, 1, 0, 125_000, 0, 0, 0] and got[6]["n_email"] == 1


def test_context_tree_base_model(docs, none):
    tokens = [(i, text_of(t).encode().lower().split() + [None]) for i, t, _ in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    got = context_tree.scores(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert context_tree.scores(none).count() == 0


def _slow_tree(train, depth):
    """Counts of every context and the weighted probability of its subtree, by recursion."""
    count = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for t in train:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for bit in range(8):
                prefix = (bit, s[i] >> (8 - bit))
                for d in range(depth + 1):
                    ctx = s[i - d : i]
                    count[ctx, prefix][s[i] >> (7 - bit) & 1] += 1
                    if d:
                        children[ctx[1:], prefix].add(ctx)
    return count, children


def test_context_tree_against_recursion(spark):
    import math

    train = [b"abra cadabra", b"abra abra", b"cad"]
    depth = 3
    count, children = _slow_tree(train, depth)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, prefix):
        own = kt(*count[ctx, prefix])
        if len(ctx) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, prefix) for c in children[ctx, prefix])) - math.log(2)

    def bit(ctx_full, prefix, one, d=0):
        ctx = ctx_full[depth - d :]
        if (ctx, prefix) not in count:
            return None
        n = count[ctx, prefix]
        own = (n[one] + 0.5) / (sum(n) + 1)
        if d == depth or (below := bit(ctx_full, prefix, one, d + 1)) is None:
            return own
        k, s = kt(*n), sum(weighted(c, prefix) for c in children[ctx, prefix])
        stop = 1 / (1 + math.exp(min(700, s - k)))
        return stop * own + (1 - stop) * below

    def score(t):
        s, out = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(s)):
            for b in range(8):
                out += math.log10(bit(s[i - depth : i], (b, s[i] >> (8 - b)), s[i] >> (7 - b) & 1) or 0.5)
        return out

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:3] + [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [*train, b"abra zzz", b""]
    df = exact_dedup.written(spark.createDataFrame([(i, t.decode()) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string"), "ctw")
    got = {r["doc_id"]: r["score"] for r in context_tree.scores(df, depth).collect()}
    for i, t in zip(ids, texts, strict=True):
        assert got[i] == pytest.approx(score(t), rel=1e-9), t


def test_license_templates():
    m = licenses.compile_template("licensed under [[the [[old]] terms of]] {{name:2}} license [[version {{n:1|[0-9]+}}]]")
    accepts = lambda s: m.match(licenses.words_of(s), 0) == len(licenses.words_of(s))
    for s in ("Licensed under Foo License", "licensed under the terms of foo bar license, version 2", "licensed under the old terms of foo license"):
        assert accepts(s), s
    for s in ("licensed under license", "licensed under a b c license", "licensed under the foo of bar license", "licensed under foo license version two"):
        assert not accepts(s), s


def test_license_template_with_long_beginning():
    found = licenses.Templates({"own": ["start {{holder:40}} [[of the [[very]] end|x]] with these fixed words here"]}).find
    for n, tail in ((40, "of the very end"), (40, ""), (1, "x")):
        words = licenses.words_of(f"before start {'w ' * n}{tail} with these fixed words here after")
        assert found(words, b" " + b" ".join(words) + b" ") == [("own", 1, len(words) - 1)], (n, tail)
    words = licenses.words_of(f"start {'w ' * 41} with these fixed words here")
    assert found(words, b" " + b" ".join(words) + b" ") == []


def test_licenses_table(spark, none):
    texts = [(1, "All rights reserved. CC-BY cc  by"), (2, None), (3, "This is the GNU General Public License"), (4, "Released under the MIT License."), (5, "ccby")]
    got = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert got[3]["base_labels"] == "gpl" and got[4]["labels"] == "mit-notice" and got[4]["score"] == 1.0 and got[5]["n_base"] == 0
    assert licenses.licenses(none).count() == 0


def _check_packing(got, docs, capacity=1024):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary_path())
    want = collections.Counter()
    for i, t in docs:
        ids = np.array([*coder.encode(text_of(t), add_special_tokens=False).ids, 2], "<u4")
        bounds = [0, len(ids)] if len(ids) <= capacity else [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(bounds)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return used


def test_packing(docs, none):
    _check_packing(packing.pack(docs).collect(), [(i, t) for i, t, _ in rows()])
    assert packing.pack(none).count() == 0


MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_licences(spark):
    clause = BSD[BSD.index("3. Neither") : BSD.index("THIS SOFTWARE")]
    texts = {
        MIT: "mit,mit-grant",
        "before\n# " + MIT.replace("\n", "\n# ").replace("THE\n# AUTHORS OR COPYRIGHT HOLDERS", "Some Body") + " after": "mit,mit-grant",
        MIT.replace("without restriction", "without restriction, if you must,"): "mit-grant",
        MIT.replace("sell\ncopies of", "NOT sell\ncopies of"): "mit-grant",
        MIT[: MIT.index("The above")] + "You may NOT sell it.": "mit-grant",
        BSD: "bsd-3-clause,bsd-grant",
        BSD.replace("1. ", "").replace("2. ", "").replace("3. ", "").replace("of its", "of any"): "bsd-3-clause,bsd-grant",
        BSD.replace(clause, ""): "bsd-2-clause,bsd-grant",
        BSD.replace("not limited to, the\nimplied", "limited to the\nimplied").replace("DISCLAIMED", "GIVEN"): "bsd-grant",
    }
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        text, want = list(texts.items())[r["doc_id"]]
        assert r["labels"] == want, (text, r["labels"])


def test_license_table_with_repeated_rows(spark):
    one = [(1, "Released under the MIT License. All rights reserved.", "x")]
    df = spark.createDataFrame(one * 5 + [(None, None, None), (None, "cc by", "y")], "doc_id long, text string, labels string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in licenses.licenses(df).collect())
    assert got == {(1, 8, 1, "mit-notice,reserved"): 5, (None, 0, 0, ""): 1, (None, 2, 1, "cc-by"): 1}


def _best_fit_decreasing(counts, capacity):
    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
                opened += 1
    return opened


def test_packing_sweep_takes_the_successor():
    """Against one document at a time, from large to small, each with the smallest gap that was there before the sweep or what the same length has left of it."""
    rng = random.Random(2)
    for _ in range(300):
        gaps = [(rng.randint(1, 40), 100 * i, rng.randint(1, 4)) for i in range(rng.randint(0, 8))]
        pieces = [(size, 0, rng.randint(1, 12)) for size in rng.sample(range(1, 41), rng.randint(1, 8))]
        placed, updated, free, left = packing.sweep(gaps, pieces, 40)
        whole = {f + i: s for s, f, n in gaps for i in range(n)}
        open_, want = dict(whole), collections.Counter()
        for size, _, n in sorted(pieces, reverse=True):
            own = {}
            for k in range(n):
                fits = [(g, s) for s, g in own.items() if g >= size] or [(g, s) for s, g in open_.items() if g >= size]
                if not fits:
                    want["left", size] += n - k
                    break
                g, at = min(fits)
                open_.pop(at, None)
                own[at] = g - size
                want["placed", size, whole[at]] += 1
        got = collections.Counter()
        for size, _, n, _, _, offset in placed:
            got["placed", size, 40 - offset] += n
        for size, _, n in left:
            got["left", size] += n
        assert got == want
        assert sum(n * s for s, _, n in updated) + sum(n * s for s, _, n in free) == sum(whole.values()) - sum(x[0] * x[2] for x in placed)


def test_packing_supersteps(spark):
    """Every document has one place, none overlap, and there are hardly more sequences than best-fit decreasing opens."""
    rng = random.Random(2)
    for gen in (lambda: rng.randint(1, 100), lambda: rng.choice([51, 49, 2, 1]), lambda: 1 + int(rng.expovariate(1 / 20)) % 100, lambda: 3):
        counts = collections.Counter(gen() for _ in range(1500))
        table = spark.createDataFrame([*counts.items()], "length long, n long")
        steps = packing.supersteps(table, 100).collect()
        ranks, fill = collections.defaultdict(list), collections.defaultdict(list)
        for r in steps:
            ranks[r["size"]] += range(r["first"], r["first"] + r["n"])
            for k in range(r["n"]):
                fill[r["sequence"] + k // r["each"]].append((r["offset"] + k % r["each"] * r["size"], r["size"]))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for own in fill.values():
            assert [a for a, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 100
        assert len(fill) <= _best_fit_decreasing(counts, 100) * 1.01 + 1
    assert packing.supersteps(table.limit(0), 100).collect() == []


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    coder, rng = Tokenizer.from_file(packing.vocabulary_path()), random.Random(1)
    ids = packing.Ids(packing.vocabulary_path())
    parts = [" ", "  ", " \n", "\n", " a", "b", "'s", "12", "é", "\t", "ß.", "!!", "<|endoftext|>", "日本", "\r\n"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert ids(t).tolist() == coder.encode(t, add_special_tokens=False).ids
    assert 50256 in ids("a <|endoftext|> b").tolist()


def test_packing_of_texts_that_the_rank_coder_gives_up_on(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, None, "a <|endoftext|> b"]
    _check_packing(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), list(enumerate(texts)))


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    for i, t, _ in rows():
        groups[text_of(t).encode().translate(None, exact_dedup.SPACE)].append((-len(text_of(t)), i is None, i or 0, i))
    want = collections.Counter((g[3], min(own)[3], len(own), hashlib.sha256(norm).hexdigest()) for norm, own in groups.items() for g in own)
    got = exact_dedup.exact_groups(docs).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_radix_splits_hot_prefixes(spark):
    texts = ["p" * 64 + ("q" * 256 if i % 2 else "") + str(i % 700) for i in range(2100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    want = collections.Counter(texts)
    assert all(r["group_size"] == want[texts[r["doc_id"]]] for r in got) and sum(r["kept"] for r in got) == len(want)


def test_html():
    model = html_extract.train(500)
    page = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><div class='cookie-notice'><p>We use cookies on this site, as all do.</p></div><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n word.<p>Second<br>line, with more text in it.</article><section id=comments><div class=comment><p>Great article, thanks.</p></div></section><form><label>Name</label><input></form><footer>&copy; 2020 someone</footer></body></html>"
    assert html_extract.extract([page], model) == ["Head & line One bold word. Second line, with more text in it."]
    assert html_extract.extract(["", "no markup at all", "<p", "<div></p></div><![CDATA[x"], model)[0] == ""
    rng = random.Random(77)
    import re

    good = 0
    for _ in range(100):
        source = html_extract._compose(rng)
        parsed = html_extract.Page(source)
        want = parsed.text([bool(re.search(r"\sy$", a)) for a in parsed.attrs])
        good += want == html_extract.extract([re.sub(r" y>", ">", source)], model)[0]
    assert good >= 85


def test_html_text_in_no_block():
    model = html_extract.train()
    plain = "Plain text with no markup at all. It has two sentences, and some commas."
    inline = "Some <b>bold</b> words and <a href=/x>a link</a>. More text follows<br>here, in no block."
    mixed = "First text, in no block.<p>Then a paragraph, which is long enough.</p>Last text, in no block again."
    want = [plain, "Some bold words and a link. More text follows here, in no block.", "First text, in no block. Then a paragraph, which is long enough. Last text, in no block again."]
    assert html_extract.extract([plain, inline, mixed], model) == want


def test_html_attributes_and_text_in_a_body():
    model = html_extract.train()
    long = "One two three four five, six seven. More text of the page, as it goes on."
    pages = {
        f"<title>Title here</title><p title=it's>{long}</p>": long,
        f"<p class = \"a>b\">{long} <p data-x=>Second one, with text.": f"{long} Second one, with text.",
        f"{long} <b class=a'b\"c>bold</b> words, and so on.": f"{long} bold words, and so on.",
        f"<html><body>{long}</body></html>": long,
        f"<body>{long}<br>And a line more.</body>": f"{long} And a line more.",
        f"<body><nav><a href=/>Home</a> <a href=/b>News</a></nav>{long}<footer>&copy; 2020 someone</footer></body>": long,
    }
    assert html_extract.extract(list(pages), model) == list(pages.values())
    began = time.perf_counter()
    html_extract.extract(["<a =" + '="' * 100_000, "<p " + "='x " * 100_000, "<" * 200_000, '<a="' * 100_000, "<!--" * 50_000], model)
    assert time.perf_counter() - began < 5


class _Article(HTMLParser):
    """The text inside article elements without what an article holds that is none; by the standard library's parser."""

    APART = ("script", "style", "aside", "form", "nav", "footer", "noscript")
    BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "ul", "section", "blockquote")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = self.apart = 0
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.open += tag == "article"
        self.apart += bool(self.open) and tag in self.APART
        if tag in self.BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.open -= tag == "article"
        self.apart -= bool(self.open) and tag in self.APART
        if tag in self.BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.open and not self.apart:
            self.out.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_html_of_whole_tables_against_another_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_extract.op7_html_main_text(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = _Article()
        article.feed(r["html"] or "")
        article.close()
        want = " ".join("".join(article.out).split())
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>Some text, here it is.</p></article>"), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.main_text(df, html_extract.train(200)).collect()
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == {1: ("u", "", 0), None: (None, "Some text, here it is.", 22), 2: ("v", "", 0)}
    again = html_extract.main_text(df.union(df).repartition(3), html_extract.train(200)).collect()
    assert collections.Counter((r["page_id"], r["text"]) for r in again) == {(1, ""): 2, (None, "Some text, here it is."): 2, (2, ""): 2}
    assert html_extract.main_text(df.limit(0), html_extract.train(50)).count() == 0


def test_toxicity(spark, docs, none, monkeypatch):
    assert toxicity.fold("You 1D10T!! Іdiоt wоrth1ess—x") == toxicity.fold("you idiot idiot worthless x") == " you idiot idiot worthiess x "
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 80)) + (" foulword" if i % 4 == 0 else " foulwordless town" if i % 9 == 1 else "") for i in range(600)]
    lexicon = toxicity.learn(texts, [int(i % 4 == 0) for i in range(600)])
    score = lambda t: lexicon.score(toxicity.fold(t))
    assert score("what a F0ulw0rd this is") > 0.5 > score("the town of foulwordless town") and score("") < 0.5
    assert toxicity.toxicity(docs, lexicon).count() == len(rows()) and toxicity.toxicity(none, lexicon).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels.limit(0)).entries == {}
    toxicity.train(docs, labels)
    sizes = []
    monkeypatch.setattr(toxicity, "learn", lambda texts, toxic: sizes.append(len(texts)))
    toxicity.train(docs.union(docs).union(docs.withColumn("text", F.lit("more"))), labels)
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))]


def test_toxicity_exceptions_against_every_pair():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" foo": 1.5, " foobar ": 2.5, " bar ": 1.0}, {" foob ", " foo bar ", " bar ", " bar foo "}, [0.0] * 4)
    for _ in range(500):
        folded = " " + " ".join(rng.choice(["foo", "foob", "foobar", "bar", "x"]) for _ in range(rng.randint(0, 12))) + " "
        at = lambda e, t=folded: [i for i in range(len(t)) if t.startswith(e, i)]
        clear = [(i, i + len(e)) for e in lexicon.exceptions for i in at(e)]
        want = {}
        for e, w in lexicon.entries.items():
            if e in lexicon.exceptions:
                continue
            for i in at(e):
                if not any(a <= i and i + len(e) <= b for a, b in clear):
                    word = folded[i + 1 : folded.index(" ", i + 1)]
                    want[word] = max(w, want.get(word, 0))
        assert lexicon.hits(folded) == want
    seconds = []
    for n in (4000, 32000):
        began = time.perf_counter()
        lexicon.hits(" foob foobar" * n + " ")
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 20 * seconds[0] + 0.3


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    met = []
    monkeypatch.setattr(toxicity, "learn", lambda texts, toxic: met.extend(texts))
    toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")), sample_bytes=4250)
    assert len(met) == 42


def test_toxicity_on_held_out_labels(spark):
    """Held-out accuracy on the supplied labels, by a tally of its own."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == docs.count() and {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.95 * len(held) and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def _multiset(t):
    ws = text_of(t).encode().lower().split()
    return collections.Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else collections.Counter()


def test_toxicity_learns_from_all_of_several_thousand_labels(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    met = []
    monkeypatch.setattr(toxicity, "learn", lambda texts, toxic: met.extend(texts))
    toxicity.train(docs, labels)
    assert collections.Counter(met) == collections.Counter(f"text {i}" for i in range(9000) if zlib.crc32(str(i).encode()) % 5) and len(met) > 5000


def test_near_dedup(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    all_rows = rows()
    sets, parent = [_multiset(t) for _, t, _ in all_rows], list(range(len(all_rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(all_rows)), 2):
        either = sum((sets[a] | sets[b]).values())
        if (not either) or sum((sets[a] & sets[b]).values()) / either >= 0.8:
            parent[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for i, (doc_id, _, _) in enumerate(all_rows):
        classes[root(i)].append(doc_id)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter((i, least(ids)) for ids in classes.values() for i in ids)
    assert sum(r["kept"] for r in got) == len(classes)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(1300):  # more than a block holds
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [prose(rng, 50) for _ in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[i] for i in range(1300)} == {0} and len({got[i] for i in range(1300, 1350)}) == 50


def test_near_dedup_loses_no_link_of_large_buckets(spark, monkeypatch):
    """Families of texts that share many bands without all being alike, in blocks of four; against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng, texts = random.Random(10), []
    for f in range(3):
        heads = [[f"f{f}w{i}" for i in range(150)]]
        for _ in range(3):  # a family's branches, between 0.5 and 0.9 alike
            t = list(heads[0])
            for i in rng.sample(range(0, 150, 5), rng.choice([2, 4, 6])):
                t[i] = f"b{rng.randrange(10**6)}"
            heads.append(t)
        for _ in range(45):
            t = list(rng.choice(heads))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    met, of = [], near_dedup.unsettled
    monkeypatch.setattr(near_dedup, "unsettled", lambda e, c: met.append((g := of(e, c)) is not None and g.count()) or g)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, head = [_multiset(t) for t in texts], list(range(len(texts)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
            head[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in range(len(texts))} and met[0] > 0
    assert len(set(got.values())) > 3


def test_classes_of_chains_take_few_rounds(spark, monkeypatch):
    rng, n = random.Random(8), 400
    ids = list(range(n))
    rng.shuffle(ids)
    chains = [*itertools.pairwise(range(n)), *((n + a, n + b) for a, b in itertools.pairwise(ids))]
    nodes = spark.createDataFrame([(str(i).encode(), (False, i, i)) for i in range(2 * n)], "node binary, label struct<none: boolean, doc_id: long, row: long>")
    links = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in chains], "a binary, b binary")
    steps = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: steps.append(name) or exact_dedup.written(df, name))
    got = {int(r["node"]): r["label"]["doc_id"] for r in near_dedup.classes(nodes, links).collect()}
    assert got == {i: i // n * n for i in range(2 * n)} and steps.count("near-ways") <= 8 and len(steps) <= 40
    assert near_dedup.classes(nodes, links.limit(0)).collect() == []


def test_classes_of_random_graphs(spark):
    rng = random.Random(11)
    for n, m in ((300, 200), (300, 290), (200, 900)):
        pairs, head = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)], list(range(n))

        def root(i, head=head):
            while head[i] != i:
                i = head[i]
            return i

        for a, b in pairs:
            x, y = root(a), root(b)
            head[max(x, y)] = min(x, y)
        nodes = spark.createDataFrame([(str(i).encode(), (i < 3, None if i < 3 else i, i)) for i in range(n)], "node binary, label struct<none: boolean, doc_id: long, row: long>")
        links = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in pairs], "a binary, b binary")
        got = {int(r["node"]): r["label"]["row"] for r in near_dedup.classes(nodes, links).collect()}
        linked = {i for a, b in pairs for i in (a, b) if a != b}
        order = lambda i: (i < 3, i)
        assert got == {i: min((j for j in range(n) if root(j) == root(i)), key=order) for i in linked}


def test_linked_equals_pairs():
    rng = np.random.default_rng(5)
    units = [np.unique(rng.integers(0, 60, rng.integers(3, 50))) for _ in range(60)]
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if len(np.intersect1d(units[i], units[j])) >= 0.5 * len(np.union1d(units[i], units[j]))}
    parent = list(range(60))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in want:
        parent[root(parent, i)] = root(parent, j)
    own = list(range(60))
    for i, j in near_dedup.linked(units, 0.5):
        own[root(own, i)] = root(own, j)
    same = lambda p: {(i, j) for i, j in itertools.combinations(range(60), 2) if root(p, i) == root(p, j)}
    assert same(own) == same(parent)


def test_strung_texts_are_connected_by_few_links_each():
    rng = random.Random(2)
    marks = [rng.randrange(1 << 32) for _ in range(1000)]
    links = near_dedup.strung(list(range(1000)), marks)
    degree = collections.Counter(i for pair in links for i in pair)
    assert len(links) == 999 and len({i for pair in links for i in pair}) == 1000 and max(degree.values()) < 100
    # Without a few of them nearly all links are the same.
    fewer = near_dedup.strung(rng.sample(range(1000), 980), marks)
    assert len(set(fewer) & set(links)) > 850


def test_dart_signatures_estimate_weighted_jaccard():
    rng = random.Random(6)
    a = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(800)]
    b = a[:700] + [f"z{i}" for i in range(100)]
    units, bounds = near_dedup.elements([" ".join(a).encode(), " ".join(b).encode()])
    signed = near_dedup.signatures(units, bounds, 2000)
    true = near_dedup.similarities([" ".join(a).encode()], [" ".join(b).encode()])[0] if hasattr(near_dedup, "similarities") else sum((_multiset(" ".join(a)) & _multiset(" ".join(b))).values()) / sum((_multiset(" ".join(a)) | _multiset(" ".join(b))).values())
    assert abs((signed[0] == signed[1]).mean() - true) < 0.05


def test_mix(docs, none, monkeypatch):
    got = mixing.mix(docs).collect()
    size = lambda t: len(text_of(t).encode().split())
    per = collections.Counter()
    for _, t, s in rows():
        per[s] += size(t)
    total, sources = sum(per.values()), sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        rest = total - sum(3 * per[s] for s in full)
        among = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * per[s] if s in full else rest * weight[s] / among for s in sources}
        if not (over := {s for s in sources if target[s] > 3 * per[s]}):
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == per[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sources) and len(got) == len(rows())
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    shown = lambda df: sorted(str((r["doc_id"], r["source"], r["size"], r["taken"])) for r in df.collect())
    monkeypatch.setattr(mixing, "LEAST_RANGES", 1)
    assert shown(mixing.mix(docs, rows_per_range=3)) == shown(mixing.mix(docs))
    assert mixing.mix(none).count() == 0


def test_rows_keep_their_place_when_files_are_split_otherwise(spark, tmp_path):
    """What decides on rows and what picks them read the files at different times, perhaps on different numbers of cores."""
    import corpus_pipeline

    rng = random.Random(12)
    base = [prose(rng, 300) for _ in range(60)]
    texts = [rng.choice(base) if i % 3 == 0 else prose(rng, 300) for i in range(900)]
    made = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "docs")
    made.coalesce(2).write.option("parquet.block.size", 65536).parquet(path)
    docs, few, many = spark.read.parquet(path), ("spark.sql.files.maxPartitionBytes", "128m"), ("spark.sql.files.maxPartitionBytes", "20k")
    assert docs.rdd.getNumPartitions() <= 4
    same = lambda df: collections.Counter(tuple(r) for r in df.collect())
    try:
        for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
            spark.conf.set(*few)
            want = same(stage(spark, docs, ""))
            lazy = stage(spark, spark.read.parquet(path), "")
            spark.conf.set(*many)
            assert spark.read.parquet(path).rdd.getNumPartitions() > 4
            assert same(lazy) == want and sum(want.values()) > 500, stage.__name__
        spark.conf.set(*few)
        want = same(context_tree.scores(docs).select("doc_id", F.round("score", 6), F.round("base_score", 6)))
        lazy = context_tree.scores(spark.read.parquet(path)).select("doc_id", F.round("score", 6), F.round("base_score", 6))
        spark.conf.set(*many)
        assert same(lazy) == want and len(want) == 900
    finally:
        spark.conf.unset(few[0])


def test_on_files_writes_what_is_no_plain_read(docs, spark):
    common = exact_dedup.written.__globals__
    on_files, place = common["on_files"], common["place"]
    assert on_files(docs) is docs and on_files(kept := docs.where("doc_id > 3").select("doc_id", "text")) is kept
    for other in (docs.union(docs), docs.withColumn("n", F.monotonically_increasing_id()), docs.join(docs.select("doc_id").distinct(), "doc_id"), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        made = on_files(other)
        assert made is not other and made.count() == other.count() == made.select(place().alias("p")).distinct().count()


def test_context_tree_splits_hot_trees(docs):
    whole = {(r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in context_tree.scores(docs).collect()}
    for share in (4, 40):
        assert {(r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in context_tree.scores(docs, share=share).collect()} == whole


def test_exact_dedup_merges_a_text_of_many_blocks_in_steps(spark, monkeypatch):
    texts = ["hot" if i % 3 == 0 else f"own {i // 2}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    names = []
    monkeypatch.setattr(exact_dedup, "written", lambda d, name, f=exact_dedup.written: names.append(name) or f(d, name))
    got = exact_dedup.exact_groups(df, limit=10).collect()
    norms = [t.replace(" ", "") for t in texts]
    want, least = collections.Counter(norms), {}
    for i, t in enumerate(norms):
        least.setdefault(t, i)
    assert len(got) == 3000 and all(r["group_size"] == want[norms[r["doc_id"]]] and r["keep_id"] == least[norms[r["doc_id"]]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert "radix-merged" in names
