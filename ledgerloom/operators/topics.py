"""The topic dictionary, and topics of sentences by keyword."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import FAR, HEAD, SIGN, topic_finder
from ..functions.text import lemmatize, strip

#: A plug for lemmas: from an array of texts to their lemmas.
Lemmas = Callable[[Column], Column]

# Words that are no keywords, and spellings put right.
STOP = ("", "nan", "good", "material", "right", "cycle")
SPELLING = {"abseteeism": "absenteeism", "laeble": "label", "_emissions": "emissions"}


def rule_lemmas(texts: Column) -> Column:
    """T3's default: the rule, text by text."""
    return F.transform(texts, lemmatize)


def topic_keywords(sheet: DataFrame, lemmas: Lemmas = rule_lemmas) -> DataFrame:
    """Ord, topic, keywords from rows (ord, subtopic, unigrams, bigrams) of comma lists.

    An empty cell reads "nan", a stop word. Of a topic given twice the last row counts, at the first one's place.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    words = F.transform(F.split(F.concat(cell("unigrams"), F.lit(","), cell("bigrams")), ","), lambda w: strip(F.replace(w, F.lit("_"), F.lit(" "))))
    spelled = F.create_map(*(F.lit(x) for pair in SPELLING.items() for x in pair))
    words = lemmas(F.transform(words, lambda w: F.coalesce(F.try_element_at(spelled, w), w)))
    words = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP))))
    rows = sheet.select("ord", F.col("subtopic").alias("topic"), words.alias("keywords"))
    return rows.groupBy("topic").agg(F.min("ord").alias("ord"), F.max_by("keywords", "ord").alias("keywords")).select("ord", "topic", "keywords")


def append_constant(topics: DataFrame, **row: object) -> DataFrame:
    """U-2: the topic table with one more row of constants; columns not given are null."""
    values = [F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in topics.schema]
    return topics.unionByName(topics.sparkSession.range(1).select(*values))


def without_overlap(keywords: Column) -> Column:
    """Without keywords that another one begins a word of."""
    return F.filter(keywords, lambda b: ~F.exists(keywords, lambda a: (a != b) & F.contains(F.concat(F.lit(" "), b), F.concat(F.lit(" "), a))))


def patterns(topics: dict[str, list[str]], strict_words: bool = False) -> list[tuple[str, str]]:
    """(topic, regular expression) in dictionary order.

    A keyword stands between blanks, but the last one of a topic only needs a blank in front, and none
    matches at the beginning of a sentence: that is how the results to match come about. ``strict_words``
    takes whole words anywhere instead.
    """
    if strict_words:
        return [(t, r"\b(?:" + "|".join(ws) + r")\b" if ws else r"\b\B") for t, ws in topics.items()]
    return [(t, " |".join(f" {w}" for w in ws) or " ") for t, ws in topics.items()]


def _plain(words: list[str]) -> bool:
    """Whether none of the words holds signs of a pattern."""
    return all(re.fullmatch(r"[\w -]+", w) for w in words)


def kwtopics(sents: DataFrame, topics: dict[str, list[str]] | DataFrame, strict_words: bool = False, lemmas: Lemmas = rule_lemmas) -> DataFrame:
    """T5: adds ntopics, kw_topic1 (most distinct keywords, then dictionary order; ``outofscope`` if none) and keywords1, sorted.

    A dictionary as a dict is part of the expression: all within a row, nothing is joined or shuffled. One as a
    table (ord, topic, keywords), as ``topic_keywords`` makes it, may hold any number of topics: see ``kwtopics_by_table``.
    """
    if isinstance(topics, DataFrame):
        if strict_words:
            raise ValueError("whole words need the dictionary as a dict")
        return kwtopics_by_table(sents, topics, lemmas)
    # Step by step: each column is used more than once, and steps keep Spark from computing it for each use.
    out, given = sents.withColumn("lemma", F.element_at(lemmas(F.array("text")), 1)), patterns(topics, strict_words)
    # Plain keywords share the blank in front: a text is looked through for it, not for each keyword at every place.
    given = [(t, f" (?:{' |'.join(topics[t])})" if not strict_words and len(topics[t]) > 1 and _plain(topics[t]) else p) for t, p in given]

    def words(pattern: str, plain: list[str]) -> Column:
        found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("lemma", F.lit(pattern), F.lit(0)), lambda w: F.trim(w))))
        # The pattern is tried only where one of the words stands at all; that is a plain search for bytes.
        stands = reduce(lambda a, b: a | b, (F.contains(F.col("lemma"), F.lit(w)) for w in plain)) if plain else F.lit(True)
        return F.when(stands, found).otherwise(F.array().cast("array<string>"))

    # A keyword is part of a pattern, so only one without signs of patterns can be looked for as it stands.
    plain = [ws if _plain(ws) else [] for ws in topics.values()]
    lists = F.struct(*(words(p, plain[i]).alias(f"words{i}") for i, (_, p) in enumerate(given)))
    # The one-row generator keeps later filters from being pushed below, where they would compute the lists again.
    out = out.select(*sents.columns, F.explode(F.array(lists)).alias("lists")).select(*sents.columns, "lists.*")
    found = [F.struct((-F.size(f"words{i}")).alias("less"), F.lit(i).alias("ord"), F.lit(t).alias("topic"), F.col(f"words{i}").alias("words")) for i, (t, _) in enumerate(given)]
    out = out.withColumn("ranked", F.array_sort(F.filter(F.array(*found), lambda s: s["less"] < 0)))
    best = F.try_element_at("ranked", F.lit(1))
    out = out.withColumns({"ntopics": F.size("ranked"), "kw_topic1": F.coalesce(best["topic"], F.lit("outofscope")), "keywords1": F.coalesce(best["words"], F.array().cast("array<string>"))})
    return out.select(*sents.columns, "ntopics", "kw_topic1", "keywords1")


#: Words of a keyword that is looked up whole in a join, at most.
WORDS = 5
#: What a table may hold to be handed to the tasks: topics and keywords in all, their characters, and keywords of one topic.
HANDED, HANDED_CHARS, HANDED_EACH = 100_000, 4_000_000, 1_000


def _pattern(words: Column) -> Column:
    """The pattern of a topic from (place, keyword, last), sorted: see ``patterns``."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w["keyword"], F.when(w["last"], "").otherwise(" "))), "|")


def keyword_keys(topics: DataFrame) -> DataFrame:
    """ord, topic, place, keyword, last, key of every keyword: where ``key`` stands at no word's beginning of a sentence, the keyword can't match.

    The key of a plain keyword, unless it is its topic's last, is the keyword and a blank. All others may match part of a word, or
    are patterns: their key is what they begin with as plain text. Null: it may match anywhere.
    """
    each = topics.select("ord", "topic", F.size("keywords").alias("n"), F.posexplode("keywords").alias("place", "keyword")).withColumn("last", F.col("place") == F.col("n") - 1)
    head = F.regexp_extract("keyword", rf"\A(?:[^{SIGN}](?![*?{{]))*", 0)
    whole = ~F.col("last") & ~F.col("keyword").rlike(f"[{SIGN}]") & (F.size(F.split("keyword", " ")) <= WORDS)
    key = F.when(whole, F.concat("keyword", F.lit(" "))).when(~F.col("keyword").rlike(FAR) & (head != ""), F.substring(head, 1, HEAD))
    return each.select("ord", "topic", "place", "keyword", "last", key.alias("key"))


def kwtopics_by_table(sents: DataFrame, topics: DataFrame, lemmas: Lemmas = rule_lemmas) -> DataFrame:
    """T5 with the dictionary as a table (ord, topic, keywords), however many topics it has.

    It is counted first. Up to ``HANDED`` topics and keywords are handed to the tasks, where each sentence looks up its own
    words: nothing is joined or shuffled. A larger table meets the sentences in a join.
    """
    size = F.greatest(F.size("keywords"), F.lit(0))
    sums = topics.agg(F.count(F.lit(1)), F.sum(size), F.sum(F.length(F.array_join("keywords", "")) + F.coalesce(F.length("topic"), F.lit(0))), F.max(size)).first()
    count, keywords, chars, most = (n or 0 for n in sums)
    if count + keywords > HANDED or chars > HANDED_CHARS or most > HANDED_EACH:
        return kwtopics_by_join(sents, topics, lemmas)
    rows = topics.where("keywords is not null").orderBy("ord", "topic").select("topic", F.array_compact("keywords").alias("keywords")).collect()
    best = topic_finder([(r["topic"], r["keywords"]) for r in rows])(F.element_at(lemmas(F.array("text")), 1))
    out = sents.withColumn("best", best)
    return out.select(*sents.columns, "best.ntopics", F.coalesce("best.topic", F.lit("outofscope")).alias("kw_topic1"), F.col("best.words").alias("keywords1"))


def kwtopics_by_join(sents: DataFrame, topics: DataFrame, lemmas: Lemmas = rule_lemmas) -> DataFrame:
    """T5 with a table of any size.

    What may begin a keyword, the word n-grams and the beginnings of a sentence's words, meets the keywords' keys in a
    hash join. The exact pattern is tried only for the topics found so, made of the keywords found so: others can't match, so they
    change nothing. Topics with a keyword that has no key, and those without any keyword, are tried on every sentence. Rows that share a sent_id
    share their candidates, which changes nothing either.
    """
    keys = keyword_keys(topics)
    free = keys.where("key is null").select("ord").distinct()
    keyed = keys.join(free, "ord", "left_anti")
    sizes = F.collect_set(F.when(~F.col("key").endswith(" "), F.length("key")))
    words, heads = keyed.agg(F.coalesce(F.max(F.when(F.col("key").endswith(" "), F.size(F.split("keyword", " ")))), F.lit(0)), sizes).first()
    listed = F.array_sort(F.collect_list(F.struct("place", "keyword", "last")))
    # Few by nature: they go to every sentence, as one row.
    patterned = keys.join(free, "ord", "left_semi").groupBy("ord", "topic").agg(listed.alias("w")).select("ord", "topic", _pattern(F.col("w")).alias("pattern"))
    always = patterned.unionByName(topics.where(F.size("keywords") == 0).select("ord", "topic", F.lit(" ").alias("pattern"))).agg(F.collect_list(F.struct("ord", "topic", "pattern")).alias("always"))

    # Dealt by sentence once, before the work: candidates, both groupings and the join find their rows together. As many parts as set, and
    # not fewer by their bytes: what follows is work, not bytes. The lemma by a one-row generator, as in `kwtopics`.
    parts = int(sents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sents.repartition(parts, "sent_id").withColumn("lemma", F.explode(F.array(F.element_at(lemmas(F.array("text")), 1))))
    split = rows.select("sent_id", F.split("lemma", " ").alias("w")).where(F.size("w") > 1)
    starts, size = F.sequence(F.lit(2), F.size("w")), F.size("w")
    # A whole keyword has a blank after it, so it doesn't end the sentence; none stands at its beginning.
    grams = F.flatten(F.transform(F.filter(starts, lambda i: i < size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(words, 1)), size - i)), lambda n: F.concat(F.array_join(F.slice("w", i, n), " "), F.lit(" ")))))
    begun = lambda i: F.array_join(F.slice("w", i, F.lit(HEAD // 2)), " ")
    cut = F.array(*map(F.lit, sorted(heads))).cast("array<int>")
    begins = F.flatten(F.transform(starts, lambda i: F.flatten(F.transform(F.array(begun(i)), lambda b: F.transform(F.filter(cut, lambda n: n <= F.length(b)), lambda n: F.substring(b, F.lit(1), n))))))
    candidates = F.array_distinct(F.concat(*([grams] if words else []), *([begins] if heads else []), F.array().cast("array<string>")))
    hits = split.select("sent_id", F.explode(candidates).alias("key")).join(keyed, "key")
    found = hits.groupBy("sent_id", "ord", "topic").agg(F.array_sort(F.collect_set(F.struct("place", "keyword", "last"))).alias("w"))
    found = found.select("sent_id", F.struct("ord", "topic", _pattern(F.col("w")).alias("pattern")).alias("p")).groupBy("sent_id").agg(F.collect_list("p").alias("found"))

    out = rows.join(found, "sent_id", "left").crossJoin(F.broadcast(always)).withColumn("tried", F.concat(F.coalesce("found", F.array().cast("array<struct<ord: int, topic: string, pattern: string>>")), "always"))
    matched = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("lemma", p["pattern"], F.lit(0)), lambda w: F.trim(w))))
    ranked = F.transform("tried", lambda p: F.transform(F.array(matched(p)), lambda w: F.struct((-F.size(w)).alias("less"), p["ord"].alias("ord"), p["topic"].alias("topic"), w.alias("words")))[0])
    out = out.select(*sents.columns, F.explode(F.array(F.array_sort(F.filter(ranked, lambda s: s["less"] < 0)))).alias("ranked"))
    best = F.try_element_at("ranked", F.lit(1))
    out = out.withColumns({"ntopics": F.size("ranked"), "kw_topic1": F.coalesce(best["topic"], F.lit("outofscope")), "keywords1": F.coalesce(best["words"], F.array().cast("array<string>"))})
    return out.select(*sents.columns, "ntopics", "kw_topic1", "keywords1")
