"""Every query of the library with its SQL, by name. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import block_rtrim, numbers, split_distinct, text_filter
from ..operators import analysis as A
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import layout as L
from ..operators import scope, text
from ..operators import topics as K
from ..sources.io import union_sources
from . import flows
from . import standins as S
from .standins import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__], SQL[name or f.__name__] = f, sql
        return f

    return add


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("keywords1", F.array_join("keywords1", "|"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return S.classify(S.topics(s, d))


# Text -----------------------------------------------------------------------


@query("SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn, text) AS text, length(string_agg(text, ' ' ORDER BY turn, text)) >= 100 AS ok FROM conversations GROUP BY conv_id")
def pages_to_text(s, d):
    return text.pages_to_text(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations", "union_sources")
def union_all_sources(s, d):
    return union_sources(*(table(s, d, t).select(F.col(k).alias("id"), "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id"))))


@query(f"WITH {S.FILT} SELECT doc_id, text FROM filt", "text_filter")
def text_filtered(s, d):
    return table(s, d, "documents").select("doc_id", text_filter(F.col("text")).alias("text"))


@query(rf"SELECT doc_id, regexp_replace(text, '{S.SPACE}+$', '') AS text FROM documents", "block_rtrim")
def block_rtrimmed(s, d):
    return table(s, d, "documents").select("doc_id", block_rtrim(F.col("text")).alias("text"))


@query(f"WITH {S.SENTS} SELECT doc_id, sent_pos, sent_id, text FROM sents")
def sentences(s, d):
    return S.sents(s, d).select("doc_id", "sent_pos", "sent_id", "text")


@query(f"WITH {S.ANN} SELECT sent_id, accepted FROM flagged")
def sentence_filter(s, d):
    return S.filtered(s, d).select("sent_id", "accepted")


@query(f"WITH {S.ANN} SELECT sent_id, loosely AS accepted FROM flagged")
def sentence_filter_nodigit(s, d):
    return S.filtered(s, d, False).select("sent_id", "accepted")


@query(f"WITH {S.ANN} SELECT sent_id, 'accepted' AS part FROM flagged WHERE accepted UNION ALL SELECT sent_id, 'rejected' FROM flagged WHERE NOT accepted")
def accepted_rejected(s, d):
    return text.parted(S.filtered(s, d)).select("sent_id", "part")


_PAGES = "documents AS (SELECT * FROM (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id) WHERE length(text) >= 100)"


@query(f"WITH {_PAGES}, {S.ANN} SELECT sent_id, text, accepted FROM flagged")
def preprocess_flow(s, d):
    pages = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return flows.preprocess(pages).select("sent_id", "text", "accepted")


@query("SELECT doc_id, substr(text, 1, 512) AS head FROM documents")
def truncate_text(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 512).alias("head"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'nterti')")
def contains_filter(s, d):
    return table(s, d, "documents").where(F.col("text").contains("nterti")).select("doc_id")


@query(f"WITH {S.TOPIC} SELECT sent_id, esg_topic, esg_score FROM esg WHERE esg_topic IS NOT NULL AND esg_score IS NOT NULL")
def dropna_any(s, d):
    return S.esg(S.sents(s, d)).na.drop("any")


@query(f"WITH {S.TOPIC} SELECT sent_id, kw_topic1 FROM topics WHERE kw_topic1 IN ('alpha', 'delta')")
def isin_topics(s, d):
    return S.topics(s, d).where(F.col("kw_topic1").isin("alpha", "delta")).select("sent_id", "kw_topic1")


@query(f"WITH {S.SENTS} SELECT sent_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*%?'), '|') AS numbers FROM sents WHERE regexp_matches(text, '[0-9]')")
def extract_numbers(s, d):
    return S.sents(s, d).where(F.col("text").rlike("[0-9]")).select("sent_id", F.array_join(numbers(F.col("text")), "|").alias("numbers"))


# Layout ---------------------------------------------------------------------


@query(f"WITH {S.BLOCKS} SELECT doc_id, page, block FROM blocks t WHERE type = 'Text' AND NOT EXISTS (SELECT 1 FROM blocks f WHERE f.type = 'Figure' AND f.doc_id = t.doc_id AND f.page = t.page AND t.x0 >= f.x0 AND t.y0 >= f.y0 AND t.x1 <= f.x1 AND t.y1 <= f.y1)")
def text_not_in_figure(s, d):
    return L.text_not_in_figure(S.blocks(s, d)).select("doc_id", "page", "block")


@query(f"WITH {S.BLOCKS} SELECT doc_id, page, block, cluster, x0group FROM grouped")
def column_clusters(s, d):
    return L.column_clusters(S.blocks(s, d)).select("doc_id", "page", "block", "cluster", "x0group")


@query(f"WITH {S.BLOCKS} SELECT doc_id, page, block, pos FROM ordered")
def reading_order(s, d):
    return L.reading_order(L.column_clusters(S.blocks(s, d))).select("doc_id", "page", "block", "pos")


_MERGED = (
    r"""ended AS (SELECT *, CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END AS e FROM ordered),
runs AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM ended),
joined AS (SELECT doc_id, run, replace(string_agg(text, CASE WHEN true THEN chr(10) END ORDER BY page, pos), chr(10) || chr(10), chr(10)) AS whole, replace(string_agg(text, '' ORDER BY page, pos), chr(10) || chr(10), chr(10)) AS tail, max(e) AS e FROM runs GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN e = 1 THEN whole ELSE tail END, chr(10) || chr(10) ORDER BY run) AS text FROM joined GROUP BY doc_id""".replace("CASE WHEN true THEN chr(10) END", "chr(10)")
)


@query(f"WITH {S.BLOCKS}, {_MERGED}")
def merge_pages(s, d):
    # Dealt by document at once: pages are put in order, and documents gathered, where they are.
    return L.merge_pages(L.reading_order(L.column_clusters(S.blocks(s, d).repartition("doc_id"))))


# Merged texts in place of the table ``documents``: of all blocks, and of text blocks outside figures.
_BLOCKS = S.BLOCKS.replace("FROM documents", "FROM main.documents")
_REPORTS = f"documents AS (WITH {_BLOCKS}, {_MERGED})"
_KEPT = "kept AS (SELECT * FROM blocks t WHERE type = 'Text' AND NOT EXISTS (SELECT 1 FROM blocks f WHERE f.type = 'Figure' AND f.doc_id = t.doc_id AND f.page = t.page AND t.x0 >= f.x0 AND t.y0 >= f.y0 AND t.x1 <= f.x1 AND t.y1 <= f.y1)),\ngaps AS"
_TEXTS = f"documents AS (WITH {_BLOCKS.replace('gaps AS', _KEPT).replace('FROM blocks WINDOW', 'FROM kept WINDOW')}, {_MERGED})"


@query(f"WITH {_REPORTS}, {S.SENTS} SELECT doc_id, sent_pos, sent_id, text FROM sents")
def report_sentences(s, d):
    """The sentences of merged pages, run by run."""
    return L.sentences_of_blocks(L.reading_order(L.column_clusters(S.blocks(s, d)))).select("doc_id", "sent_pos", "sent_id", "text")


@query(f"WITH {_TEXTS}, {S.TOPIC} SELECT sent_id, text, ntopics, kw_topic1, keywords1, esg2 AS esg_topic, esg_score FROM both_ JOIN (WITH {S.ANN} SELECT sent_id FROM flagged WHERE accepted) a USING (sent_id) WHERE esg2 <> 'outofscope'")
def report_flow(s, d):
    """Entry A: blocks to numeric sentences in scope."""
    return _words(flows.report_flow(S.blocks(s, d), S.TOPICS, S.classify)).select("sent_id", "text", "ntopics", "kw_topic1", "keywords1", "esg_topic", "esg_score")


# Topics and scope -----------------------------------------------------------

_CELL = "(" + "), (".join(f"{o}, '{t}', '{u}', {'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)}" for o, t, u, a, b in S.SHEET) + ")"
_SPELLED = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.SPELLING.items()) + " ELSE w END"
_KEYWORDS = f"""fixed(ord, field, subtopic, unigrams, bigrams) AS (VALUES {_CELL}),
sheet AS (SELECT * FROM fixed UNION ALL SELECT (item_id + 100)::INT, 'T' || (item_id % 3), 'item ' || (item_id % 29), replace(text, ' ', ','), CASE WHEN item_id % 5 <> 0 THEN replace(substr(text, 1, 60), ' ', '_') END FROM benchmark),
split AS (SELECT ord, subtopic, list_transform(string_split(coalesce(unigrams, 'nan') || ',' || coalesce(bigrams, 'nan'), ','), lambda w: trim(replace(w, '_', ' '))) AS ws FROM sheet),
lemma AS (SELECT ord, subtopic, list_transform(list_transform(ws, lambda w: {_SPELLED}), lambda w: {S.lemma_sql('w')}) AS ws FROM split),
clean AS (SELECT ord, subtopic, list_sort(list_distinct(list_filter(ws, lambda w: w NOT IN {K.STOP!r}))) AS ws FROM lemma),
words AS (SELECT min(ord)::INT AS ord, subtopic AS topic, arg_max(ws, ord) AS ws FROM clean GROUP BY subtopic)"""


@query(f"WITH {_KEYWORDS} SELECT ord, topic, array_to_string(ws, '|') AS keywords FROM words")
def topic_keywords(s, d):
    return K.topic_keywords(S.sheet(s, d)).withColumn("keywords", F.array_join("keywords", "|"))


@query(f"WITH {_KEYWORDS} SELECT ord, topic, array_to_string(list_filter(ws, lambda b: len(list_filter(ws, lambda a: a <> b AND contains(' ' || b, ' ' || a))) = 0), '|') AS keywords FROM words")
def keyword_overlap(s, d):
    return K.topic_keywords(S.sheet(s, d)).withColumn("keywords", F.array_join(K.without_overlap(F.col("keywords")), "|"))


@query(f"WITH {S.TOPIC} SELECT sent_id, ntopics, kw_topic1, keywords1 FROM topics")
def kwtopics(s, d):
    return _words(S.topics(s, d)).select("sent_id", "ntopics", "kw_topic1", "keywords1")


_SHEET_TOPICS = f"""{S.TOPIC}, {_KEYWORDS},
dictionary AS (SELECT ord, topic, list_filter(ws, lambda b: len(list_filter(ws, lambda a: a <> b AND contains(' ' || b, ' ' || a))) = 0) AS ws FROM words),
listed AS (SELECT ord, topic, len(ws) AS n, unnest(ws) AS kw, unnest(range(len(ws))) AS place FROM dictionary),
tried AS (SELECT sent_id, any_value(lemma) AS lemma, ord, topic, string_agg(' ' || kw || CASE WHEN place = n - 1 THEN '' ELSE ' ' END, '|' ORDER BY place) AS p
  FROM lemmas JOIN listed ON lemma LIKE '% ' || replace(kw, '.', '_') || '%' GROUP BY sent_id, ord, topic
  UNION ALL SELECT sent_id, lemma, ord, topic, ' ' FROM lemmas, dictionary WHERE len(ws) = 0),
matched AS (SELECT sent_id, ord, topic, list_sort(list_distinct(list_transform(regexp_extract_all(lemma, p), lambda w: trim(w)))) AS ws FROM tried),
bests AS (SELECT sent_id, count(*) AS ntopics, arg_min(topic, {{'less': -len(ws), 'ord': ord}}) AS topic, arg_min(ws, {{'less': -len(ws), 'ord': ord}}) AS ws FROM matched WHERE len(ws) > 0 GROUP BY sent_id)"""


@query(f"WITH {_SHEET_TOPICS} SELECT l.sent_id, coalesce(b.ntopics, 0)::INT AS ntopics, coalesce(b.topic, 'outofscope') AS kw_topic1, coalesce(array_to_string(b.ws, '|'), '') AS keywords1 FROM lemmas l LEFT JOIN bests b ON b.sent_id = l.sent_id")
def kwtopics_from_sheet(s, d):
    """The dictionary that the topic sheet gives, over all sentences."""
    dictionary = K.topic_keywords(S.sheet(s, d)).withColumn("keywords", K.without_overlap(F.col("keywords")))
    return _words(K.kwtopics(S.sents(s, d), dictionary)).select("sent_id", "ntopics", "kw_topic1", "keywords1")


@query(f"WITH {S.TOPIC} SELECT sent_id, ntopics, kw_topic1, esg2 AS esg_topic, esg_score FROM both_ WHERE esg2 <> 'outofscope'")
def inscope(s, d):
    return scope.inscope(_classified(s, d)).select("sent_id", "ntopics", "kw_topic1", "esg_topic", "esg_score")


@query(f"WITH {S.TOPIC} SELECT sent_id, esg_topic, esg2 FROM both_")
def esg2_relabel(s, d):
    return scope.relabel(_classified(s, d)).select("sent_id", "esg_topic", "esg2")


@query(f"WITH {S.TOPIC} SELECT count(*) AS n, count(*) FILTER (esg2 <> 'outofscope') AS inscope, count(*) FILTER (ntopics > 0) AS with_topic FROM both_")
def scope_counts(s, d):
    return scope.relabel(_classified(s, d)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("esg2") != "outofscope").alias("inscope"), F.count_if(F.col("ntopics") > 0).alias("with_topic"))


# Embeddings -----------------------------------------------------------------


@query(f"WITH {S.VEC} SELECT sent_id, unnest(range(len(v)))::INT AS j, round(unnest(v), 9) AS x FROM pooled")
def mean_pool(s, d):
    return E.sent_feats(S.tokens(s, d)).select("sent_id", F.posexplode("v").alias("j", "x")).withColumn("x", F.round("x", 9))


@query(f"WITH {S.VEC} SELECT sent_id, kpi_id, round(score, 6) AS score FROM pairs")
def cosine_pairs(s, d):
    return E.cosine_pairs(E.sent_feats(S.tokens(s, d)), S.kpis(s, d)).select("sent_id", "kpi_id", F.round("score", 6).alias("score"))


@query(f"WITH {S.VEC} SELECT sent_id, kpi_sent, round(score_sent, 6) AS score_sent FROM best")
def compare_sents(s, d):
    return E.compare_sents(E.sent_feats(S.tokens(s, d)), S.kpis(s, d)).withColumn("score_sent", F.round("score_sent", 6))


@query(f"WITH {S.VEC} SELECT sent_id, x::INT AS x, y::INT AS y FROM spans")
def ngram_indexes(s, d):
    return E.sentence_tokens(S.tokens(s, d)).select("sent_id", F.explode(E.ngram_spans(F.size("tokens"))).alias("s")).select("sent_id", "s.x", "s.y")


@query(f"WITH {S.VEC} SELECT sent_id, ngram, kpi_ngram, round(score_ngram, 6) AS score_ngram FROM bestgram")
def compare_ngrams(s, d):
    return E.compare_ngrams(S.tokens(s, d), S.kpis(s, d)).withColumn("score_ngram", F.round("score_ngram", 6))


@query(f"WITH {S.VEC} SELECT sent_id, kpi, round(score, 6) AS score FROM pairs")
def unpivot_scores(s, d):
    pairs = E.cosine_pairs(E.sent_feats(S.tokens(s, d)), S.kpis(s, d))
    wide = pairs.groupBy("sent_id").pivot("kpi", [f"kpi_{i}" for i in range(10)]).agg(F.first("score"))
    return E.unpivot(wide, "sent_id").where("score is not null").withColumn("score", F.round("score", 6))


@query(f"WITH {S.VEC} SELECT sent_id, x::INT AS x, y::INT AS y, ngram, kpi, round(score, 6) AS score FROM grams WHERE score > 0.2")
def ngram_debug(s, d):
    return E.ngram_debug(E.ngram_scores(S.tokens(s, d), S.kpis(s, d)), 0.2).select("sent_id", "x", "y", "ngram", "kpi", F.round("score", 6).alias("score"))


@query(f"WITH {S.VEC} SELECT sent_id, ngram, kpi, round(score, 6) AS score FROM grams ORDER BY grams.score DESC, sent_id, x, y, kpi_id LIMIT 10")
def top10_ngrams(s, d):
    best = E.ngram_scores(S.tokens(s, d), S.kpis(s, d)).orderBy(F.desc("score"), "sent_id", "x", "y", "kpi_id").limit(10)
    return best.select("sent_id", "ngram", "kpi", F.round("score", 6).alias("score"))


# Stage results together -----------------------------------------------------


@query(
    f"WITH {S.TOPIC}, {S.VEC} SELECT b.sent_id, kpi_ngram, kpi_sent, kw_topic1, esg2 AS esg_topic, array_to_string(regexp_extract_all(b.text, '[0-9]+(?:[.,][0-9]+)*%?'), '|') AS ducks, ngram, ntopics, keywords1, round(score_sent, 6) AS score_sent, round(score_ngram, 6) AS score_ngram, esg_score "
    "FROM both_ b LEFT JOIN best USING (sent_id) LEFT JOIN bestgram USING (sent_id) WHERE esg2 <> 'outofscope'"
)
def aggregate_features(s, d):
    made = flows.create_features(S.sents(s, d), S.tokens(s, d), S.kpis(s, d), S.TOPICS, S.classify)
    return _words(made).withColumns({c: F.round(c, 6) for c in ("score_sent", "score_ngram")})


_THREE = ", ".join(
    f"{S.kpi_sql(f'kpi{m}', m)}, m{m} AS (SELECT sent_id, kpi, score FROM (SELECT sent_id, kpi_id, kpi, round(coalesce(list_cosine_similarity(v, kv), 0), 12) AS score FROM pooled, kpi{m}) QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, kpi_id) = 1)"
    for m in (3, 2)
)


@query(
    f"WITH {S.VEC}, {_THREE} SELECT sent_id, Akpi, Atopic, Avalue, b.kpi_sent AS kpi, round(b.score_sent, 6) AS score_kpi, m3.kpi AS topic, round(m3.score, 6) AS score_topic, m2.kpi AS value, round(m2.score, 6) AS score_value, "
    "coalesce(b.kpi_sent = Akpi, false) AS kpi_match, coalesce(m3.kpi = Atopic, false) AS topic_match, coalesce(m2.kpi = Avalue, false) AS value_match FROM labels_ JOIN best b USING (sent_id) JOIN m3 USING (sent_id) JOIN m2 USING (sent_id)"
)
def compare_clean(s, d):
    made = flows.evaluate_labels(S.labels(s, d), S.tokens(s, d), {"kpi": S.kpis(s, d), "topic": S.kpis(s, d, 3), "value": S.kpis(s, d, 2)})
    return made.withColumns({c: F.round(c, 6) for c in ("score_kpi", "score_topic", "score_value")})


@query(f"WITH {S.VEC}, {_THREE} SELECT count(*) AS n, count(*) FILTER (b.kpi_sent = Akpi) AS kpi, count(*) FILTER (m3.kpi = Atopic) AS topic, count(*) FILTER (m2.kpi = Avalue) AS value FROM labels_ JOIN best b USING (sent_id) JOIN m3 USING (sent_id) JOIN m2 USING (sent_id)")
def match_accuracy(s, d):
    made = flows.evaluate_labels(S.labels(s, d), S.tokens(s, d), {"kpi": S.kpis(s, d), "topic": S.kpis(s, d, 3), "value": S.kpis(s, d, 2)})
    return made.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f"{c}_match").alias(c) for c in ("kpi", "topic", "value")))


def _matches(s, d):
    return E.compare_both(S.tokens(s, d), S.kpis(s, d))


@query(f"WITH {S.VEC} SELECT sent_id, ngram, kpi_ngram, round(score_ngram, 6) AS score_ngram, kpi_sent, round(score_sent, 6) AS score_sent FROM bestgram LEFT JOIN best USING (sent_id)")
def ngram_vs_sent(s, d):
    t, k = S.tokens(s, d), S.kpis(s, d)
    return V.ngram_vs_sent(E.compare_ngrams(t, k), E.compare_sents(E.sent_feats(t), k)).withColumns({c: F.round(c, 6) for c in ("score_sent", "score_ngram")})


@query(f"WITH {S.VEC} SELECT sent_id, kpi_ngram, kpi_sent FROM bestgram LEFT JOIN best USING (sent_id) WHERE (kpi_ngram IS DISTINCT FROM kpi_sent OR kpi_ngram IS NULL) AND score_ngram > 0.2 AND score_sent < 0.8")
def kpi_disagreement(s, d):
    return V.kpi_disagreement(_matches(s, d), above=0.2).select("sent_id", "kpi_ngram", "kpi_sent")


@query(f"WITH {S.VEC} SELECT sent_id, kpi_ngram, kpi_sent, Akpi AS true_kpi, coalesce(kpi_ngram = Akpi, false) AS correct, coalesce(kpi_sent = Akpi, false) AS correct_sent FROM bestgram LEFT JOIN best USING (sent_id) LEFT JOIN labels_ USING (sent_id)")
def labelled_matches(s, d):
    truth = S.labels(s, d).select("sent_id", F.col("Akpi").alias("true_kpi"))
    return V.labelled_matches(_matches(s, d), truth).select("sent_id", "kpi_ngram", "kpi_sent", "true_kpi", "correct", "correct_sent")


# Analysis -------------------------------------------------------------------


@query(f"WITH {S.TOPIC} SELECT kw_topic1, count(*) AS n FROM topics GROUP BY 1")
def topic_counts(s, d):
    return A.value_counts(S.topics(s, d), "kw_topic1")


@query("SELECT doc_id, coalesce(len(list_distinct(string_split(text, ','))), 0)::INT AS n FROM documents")
def subtopic_count(s, d):
    return table(s, d, "documents").select("doc_id", split_distinct(F.col("text")).alias("n"))


@query(f"WITH {S.TOPIC}, c AS (SELECT ntopics, count(*) AS n FROM topics GROUP BY 1) SELECT ntopics, n, trunc(n * 100 / sum(n) OVER ())::INT AS pct FROM c")
def subtopic_pct(s, d):
    return A.percent(A.value_counts(S.topics(s, d), "ntopics"))


def _cross(s, d):
    return scope.relabel(_classified(s, d)).groupBy("kw_topic1", "esg2").agg(F.count(F.lit(1)).alias("n"))


_CROSS = f"{S.TOPIC}, cross_ AS (SELECT kw_topic1, esg2, count(*) AS n FROM both_ GROUP BY 1, 2)"
_COLUMNS = (*S.ESG, "missing")


@query(f"WITH {S.TOPIC} SELECT kw_topic1, {', '.join(f"count(*) FILTER (esg2 = '{c}') AS {c}" for c in _COLUMNS)} FROM both_ GROUP BY 1")
def crosstab(s, d):
    return A.crosstab(scope.relabel(_classified(s, d)), "kw_topic1", "esg2", list(_COLUMNS))


@query(f"WITH {_CROSS}, b AS (SELECT kw_topic1, esg2 FROM cross_ WHERE esg2 <> 'outofscope' QUALIFY row_number() OVER (PARTITION BY kw_topic1 ORDER BY n DESC, esg2) = 1) SELECT DISTINCT c.kw_topic1, CASE WHEN c.kw_topic1 = 'outofscope' THEN 'outofscope' ELSE coalesce(b.esg2, 'outofscope') END AS top FROM cross_ c LEFT JOIN b ON b.kw_topic1 = c.kw_topic1")
def dominant_subtopic(s, d):
    return A.dominant(_cross(s, d), "kw_topic1", "esg2")


@query(f"WITH {_CROSS} SELECT kw_topic1, esg2, n, coalesce(esg2 <> 'outofscope' AND n <> 0 AND n = max(CASE WHEN esg2 <> 'outofscope' THEN n END) OVER (PARTITION BY kw_topic1), false) AS top FROM cross_")
def crosstab_highlight(s, d):
    return A.highlight(_cross(s, d), "kw_topic1", "esg2")


_FIELDS = {"alpha": "first", "beta": "first", "gamma": "second", "zeta": "third"}


@query(f"WITH {_CROSS}, f(kw_topic1, field) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _FIELDS.items())}) SELECT c.kw_topic1, esg2, n, field FROM cross_ c LEFT JOIN f ON f.kw_topic1 = c.kw_topic1")
def crosstab_topics(s, d):
    fields = s.createDataFrame([*_FIELDS.items()], "kw_topic1 string, field string")
    return _cross(s, d).join(fields, "kw_topic1", "left")


_HEADERS = sorted((v, k) for k, v in {**_FIELDS, "outofscope": "outofscope"}.items())
_CELLS = ", ".join([*(f"""(count(*) FILTER (kw_topic1 = '{k}'))::BIGINT AS "{v}__{k}\"""" for v, k in _HEADERS), f"""(count(*) FILTER (kw_topic1 NOT IN ({', '.join(repr(k) for _, k in _HEADERS)})))::BIGINT AS "__other\""""])
_WIDE = ", ".join(f'"{c}"' for c in [*(f"{v}__{k}" for v, k in _HEADERS), "__other"])


def _headers(s):
    return K.append_constant(s.createDataFrame([(v, k) for k, v in _FIELDS.items()], "topic string, subtopic string"), topic="outofscope", subtopic="outofscope")


@query(f"WITH {S.TOPIC} SELECT esg2, {_CELLS} FROM both_ GROUP BY esg2")
def crosstab_wide(s, d):
    return A.crosstab_wide(scope.relabel(_classified(s, d)), "esg2", "kw_topic1", _headers(s))


@query(
    f"WITH {S.TOPIC}, wide AS (SELECT esg2, {_CELLS} FROM both_ GROUP BY esg2), c AS (SELECT esg2, kw_topic1, count(*) AS n FROM both_ GROUP BY 1, 2), "
    "t AS (SELECT esg2, kw_topic1 FROM c WHERE kw_topic1 <> 'outofscope' QUALIFY row_number() OVER (PARTITION BY esg2 ORDER BY n DESC, kw_topic1) = 1), "
    "d AS (SELECT DISTINCT c.esg2, CASE WHEN c.esg2 = 'outofscope' THEN 'outofscope' ELSE coalesce(t.kw_topic1, 'outofscope') END AS subtopic FROM c LEFT JOIN t ON t.esg2 = c.esg2), "
    f"h(topic, subtopic) AS (VALUES {', '.join(map(repr, _HEADERS))}) SELECT h.topic, h.subtopic, wide.esg2, "
    + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _WIDE.split(", "))
    + " FROM h LEFT JOIN (d JOIN wide USING (esg2)) ON h.subtopic = d.subtopic"
)
def crosstab_report(s, d):
    return A.crosstab_report(scope.relabel(_classified(s, d)), "esg2", "kw_topic1", _headers(s))


@query(f"WITH {_CROSS}, f(kw_topic1, field) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in {**_FIELDS, 'outofscope': 'outofscope'}.items())}) SELECT f.field, f.kw_topic1, esg2, n FROM f LEFT JOIN cross_ c ON f.kw_topic1 = c.kw_topic1")
def topic_rows(s, d):
    fields = K.append_constant(s.createDataFrame([*_FIELDS.items()], "kw_topic1 string, field string"), kw_topic1="outofscope", field="outofscope")
    return fields.join(_cross(s, d), "kw_topic1", "left").select("field", "kw_topic1", "esg2", "n")


@query(f"WITH {S.TOPIC}, f(kw_topic1) AS (VALUES {', '.join(f"('{k}')" for k in _FIELDS)}) SELECT kw_topic1 FROM f WHERE kw_topic1 NOT IN (SELECT kw_topic1 FROM topics)")
def missing_subtopics(s, d):
    names = s.createDataFrame([(k,) for k in _FIELDS], "kw_topic1 string")
    return names.exceptAll(S.topics(s, d).select("kw_topic1").distinct())


@query(f"WITH {S.TOPIC}, e AS (SELECT min(esg_score) AS lo, max(esg_score) AS hi FROM esg) SELECT least(floor(CASE WHEN hi > lo THEN (esg_score - lo) * 10 / (hi - lo) ELSE 0 END), 9)::INT AS bin, count(*) AS n FROM esg, e WHERE esg_score IS NOT NULL GROUP BY 1")
def score_histogram(s, d):
    return A.histogram(S.esg(S.sents(s, d)), "esg_score")


@query(f"WITH {S.ANN}, picked AS (SELECT * FROM flagged ORDER BY md5('0:' || sent_id), sent_id LIMIT 1000) SELECT sent_id, text FROM picked WHERE loosely")
def sample_filter(s, d):
    return text.accepted(A.sample(S.filtered(s, d, False), 1000, "sent_id")).select("sent_id", "text")


@query(f"WITH {S.SENTS}, r AS (SELECT sent_id, text, row_number() OVER (ORDER BY md5('0:' || sent_id), sent_id) - 1 AS rank, count(*) OVER () AS size FROM sents) SELECT draw, sent_id, text FROM range(2000) g(draw) JOIN r ON rank = ('0x' || substr(md5('0:draw:' || draw), 1, 15))::BIGINT % size")
def sample_replaced(s, d):
    return A.sample_with_replacement(S.sents(s, d).select("sent_id", "text"), 2000, "sent_id")


@query(f"WITH {S.TOPIC} SELECT kw_topic1, sent_id FROM topics QUALIFY row_number() OVER (PARTITION BY kw_topic1 ORDER BY md5('0:' || sent_id), sent_id) <= 5")
def stratified_sample(s, d):
    return A.stratified_sample(S.topics(s, d), "kw_topic1", 5, "sent_id").select("kw_topic1", "sent_id")


@query(f"WITH {S.TOPIC} SELECT kw_topic1, esg_topic, count(*) AS n FROM (SELECT b.kw_topic1, b.esg2 AS esg_topic FROM both_ b JOIN ({f'WITH {S.ANN} SELECT sent_id FROM flagged WHERE accepted'}) a USING (sent_id) WHERE esg2 <> 'outofscope') GROUP BY 1, 2")
def flagship(s, d):
    """Documents to numeric sentences, topics, scope and counts."""
    found = K.kwtopics(text.accepted(S.filtered(s, d)), S.TOPICS)
    return scope.inscope(S.classify(found)).groupBy("kw_topic1", "esg_topic").agg(F.count(F.lit(1)).alias("n"))
