"""Stand-ins for the inputs of the flows, from the supplied tables: once as DataFrames, once as SQL.

Sentences come from ``documents``, pages from ``conversations``, token vectors from ``embeddings``;
blocks, classifier results and labels are arithmetic on ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotators import NUMBERS, rule_annotator
from ..operators import text as T
from ..operators import topics as K

TOPICS = {"alpha": ["thing", "then"], "beta": ["with the", "of the"], "gamma": ["from", "this"], "delta": ["nterti"]}
ESG = ("energy", "water", "waste", "social", "outofscope")
SHEET = [
    (0, "Energy", "Emissions", "emission,co2_level,good", "energy use,greenhouse_gas"),
    (1, "Water", "Water use", "water,waterproof,use", None),
    (2, "People", "Absence", "abseteeism,sick", "sick leave,laeble"),
    (3, "Energy", "Fuel", "fuel,biofuel,cycle", "fuel cell, - fuel"),
    (4, "Water", "Empty", None, None),
    (5, "Energy", "Emissions", "emission,carbon", "carbon dioxide,emission right"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sents(spark: SparkSession, d: str) -> DataFrame:
    return T.sentences(table(spark, d, "documents").select("doc_id", "text"))


def filtered(spark: SparkSession, d: str, require_digit: bool = True) -> DataFrame:
    return T.sentence_filter(rule_annotator(sents(spark, d)), require_digit)


def number() -> Column:
    """A number for each sentence of the supplied documents, from which stand-ins are made; the library's own key is ``sent_id``."""
    return F.col("doc_id") * 1_000_000 + F.col("sent_pos")


def classify(rows: DataFrame) -> DataFrame:
    """A classifier's columns, as an annotator adds them."""
    i = number()
    return rows.withColumns({"esg_topic": F.element_at(F.array(*map(F.lit, ESG)), (i % 5 + 1).cast("int")), "esg_score": F.when(i % 11 != 0, (i % 101) / 100)})


def esg(rows: DataFrame) -> DataFrame:
    """The same as a table by itself."""
    return classify(rows).select("sent_id", "esg_topic", "esg_score")


def topics(spark: SparkSession, d: str) -> DataFrame:
    return K.kwtopics(sents(spark, d), TOPICS)


def sheet(spark: SparkSession, d: str) -> DataFrame:
    """A topic table: rows that hold every special case, and one for each text of ``benchmark``, some of them of the same subtopic."""
    fixed = spark.createDataFrame(SHEET, "ord int, topic string, subtopic string, unigrams string, bigrams string")
    item, text = F.col("item_id"), F.col("text")
    made = table(spark, d, "benchmark").select(
        (item + 100).cast("int").alias("ord"),
        F.concat(F.lit("T"), item % 3).alias("topic"),
        F.concat(F.lit("item "), item % 29).alias("subtopic"),
        F.replace(text, F.lit(" "), F.lit(",")).alias("unigrams"),
        F.when(item % 5 != 0, F.replace(F.substring(text, 1, 60), F.lit(" "), F.lit("_"))).alias("bigrams"),
    )
    return fixed.unionByName(made)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    i, figure = number(), number() % 7 == 0
    x0, y0 = (i * 37 % 600).cast("double"), (i * 53 % 800).cast("double")
    return sents(spark, d).select(
        "doc_id",
        F.floor(F.col("sent_pos") / 12).cast("int").alias("page"),
        (F.col("sent_pos") % 12).alias("block"),
        F.when(figure, "Figure").when(i % 5 == 0, "Title").otherwise("Text").alias("type"),
        "text",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.when(figure, 400).otherwise(40 + i % 100)).alias("x1"),
        (y0 + F.when(figure, 500).otherwise(20 + i % 60)).alias("y1"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.concat(F.lit("0:"), F.floor(i / 10)).alias("sent_id"), (i % 10).cast("int").alias("pos"), F.concat(F.lit("t"), i % 97).alias("token"), F.col("embedding").cast("array<double>").alias("v"))


def kpis(spark: SparkSession, d: str, groups: int = 10) -> DataFrame:
    """Indicators: the mean vectors of the labels, modulo ``groups``."""
    each = table(spark, d, "embeddings").select((F.col("label") % groups).alias("kpi_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    means = each.groupBy("kpi_id", "j").agg(F.round(F.avg("x"), 9).alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])
    return means.groupBy("kpi_id").agg(v.alias("v")).select("kpi_id", F.concat(F.lit("kpi_"), "kpi_id").alias("kpi"), "v")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """True labels of the embedded sentences; some unknown."""
    i = F.substring_index("sent_id", ":", -1).cast("long")
    name = lambda m: F.when(i % 7 != 0, F.concat(F.lit("kpi_"), i % m))
    return tokens(spark, d).select("sent_id").distinct().select("sent_id", name(10).alias("Akpi"), name(3).alias("Atopic"), name(2).alias("Avalue"))


# --- the same in SQL --------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lemma_sql(c: str) -> str:
    return f"replace(regexp_replace(regexp_replace(lower({c}), '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+', ' ', 'g'), ' - ', '-')"


FILT = rf"""filt AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{SPACE}*-{SPACE}*\n', '', 'g'), '\n{SPACE}*\n', chr(10), 'g'), '{SPACE}*\n{SPACE}*', ' ', 'g') AS text FROM documents)"""
SENTS = FILT + r""",
parts AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?]+)[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM filt),
pos AS (SELECT doc_id, unnest(range(0, len(p)))::INT AS sent_pos, unnest(p) AS text FROM parts),
sents AS (SELECT *, doc_id || ':' || sent_pos AS sent_id, doc_id * 1000000 + sent_pos AS i FROM pos)"""
ANN = SENTS + rf""",
ann AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS n_nouns, len(regexp_extract_all(text, '(?:ed|ing|en)(?:[^A-Za-z]|$)')) AS n_verbs,
  regexp_matches(text, '[0-9]|(?:^| )(?:{NUMBERS})(?: |$)') AS has_number, regexp_matches(text, '[0-9]') AS has_digit FROM sents),
flagged AS (SELECT *, has_number AND n_nouns >= 2 AND n_verbs >= 1 AND has_digit AS accepted, has_number AND n_nouns >= 2 AND n_verbs >= 1 AS loosely FROM ann)"""
_FOUND = ", ".join(
    f"{{'less': -len(w{i}), 'ord': {i}, 'topic': '{t}', 'words': w{i}}}" for i, t in enumerate(TOPICS)
)
_LISTS = ", ".join(f"list_sort(list_distinct(list_transform(regexp_extract_all(lemma, '{p}'), lambda w: trim(w)))) AS w{i}" for i, (_, p) in enumerate(K.patterns(TOPICS)))
TOPIC = SENTS + f""",
lemmas AS (SELECT doc_id, sent_id, i, text, {lemma_sql('text')} AS lemma FROM sents),
lists AS (SELECT *, {_LISTS} FROM lemmas),
ranked AS (SELECT doc_id, sent_id, i, text, list_sort(list_filter([{_FOUND}], lambda s: s.less < 0)) AS r FROM lists),
topics AS (SELECT doc_id, sent_id, i, text, len(r)::INT AS ntopics, coalesce(r[1].topic, 'outofscope') AS kw_topic1, coalesce(array_to_string(r[1].words, '|'), '') AS keywords1 FROM ranked),
esg AS (SELECT sent_id, {list(ESG)!r}[(i % 5 + 1)::INT] AS esg_topic, CASE WHEN i % 11 <> 0 THEN (i % 101) / 100.0 END::DOUBLE AS esg_score FROM sents),
both_ AS (SELECT t.*, e.esg_topic, e.esg_score, CASE WHEN e.esg_score < 0.5 AND t.ntopics = 0 THEN 'outofscope' ELSE e.esg_topic END AS esg2 FROM topics t JOIN esg e USING (sent_id))"""
BLOCKS = SENTS + """,
xy AS (SELECT *, (i * 37 % 600)::DOUBLE AS x0, (i * 53 % 800)::DOUBLE AS y0, i % 7 = 0 AS figure FROM sents),
blocks AS (SELECT doc_id, (sent_pos // 12)::INT AS page, (sent_pos % 12)::INT AS block, CASE WHEN figure THEN 'Figure' WHEN i % 5 = 0 THEN 'Title' ELSE 'Text' END AS type, text,
  x0, y0, x0 + CASE WHEN figure THEN 400 ELSE 40 + i % 100 END AS x1, y0 + CASE WHEN figure THEN 500 ELSE 20 + i % 60 END AS y1 FROM xy),
gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w > 15 THEN 1 ELSE 0 END AS gap FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0, block)),
clusters AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, page ORDER BY x0, block)::INT AS cluster FROM gaps),
grouped AS (SELECT *, trunc(median(x0) OVER (PARTITION BY doc_id, page, cluster))::INT AS x0group FROM clusters),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0group, y0, block)::INT AS pos FROM grouped)"""


def kpi_sql(name: str, groups: int) -> str:
    return f"""{name} AS (SELECT kpi_id, 'kpi_' || kpi_id AS kpi, list(a ORDER BY j) AS kv FROM (SELECT label % {groups} AS kpi_id, j, round(avg(x), 9) AS a FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS j FROM embeddings) GROUP BY 1, 2) GROUP BY kpi_id)"""


_COS = "round(CASE WHEN isnan(list_cosine_similarity(v, kv)) THEN 0 ELSE coalesce(list_cosine_similarity(v, kv), 0) END, 12)"
VEC = f"""tok AS (SELECT '0:' || (vec_id // 10) AS sent_id, vec_id // 10 AS n, vec_id % 10 AS pos, 't' || (vec_id % 97) AS token, embedding::DOUBLE[] AS v FROM embeddings),
idx AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY pos, token) - 1 AS i FROM tok),
{kpi_sql('kpi', 10)},
pooled AS (SELECT sent_id, list(a ORDER BY j) AS v FROM (SELECT sent_id, j, avg(x) AS a FROM (SELECT sent_id, unnest(v) AS x, unnest(range(len(v))) AS j FROM tok) GROUP BY 1, 2) GROUP BY sent_id),
pairs AS (SELECT sent_id, kpi_id, kpi, {_COS} AS score FROM pooled, kpi),
best AS (SELECT sent_id, kpi AS kpi_sent, score AS score_sent FROM pairs QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, kpi_id) = 1),
spans AS (SELECT a.sent_id, a.i AS x, b.i + 1 AS y FROM idx a JOIN idx b ON a.sent_id = b.sent_id AND b.i >= a.i),
short AS (SELECT * FROM spans WHERE y - x <= 5),
gram AS (SELECT s.sent_id, x, y, string_agg(token, ' ' ORDER BY i) AS ngram FROM short s JOIN idx t ON t.sent_id = s.sent_id AND t.i >= x AND t.i < y GROUP BY 1, 2, 3),
gramv AS (SELECT sent_id, x, y, list(a ORDER BY j) AS v FROM (SELECT sent_id, x, y, j, avg(e) AS a FROM (SELECT s.sent_id, x, y, unnest(t.v) AS e, unnest(range(len(t.v))) AS j
  FROM short s JOIN idx t ON t.sent_id = s.sent_id AND t.i >= x AND t.i < y) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
grams AS (SELECT sent_id, x, y, ngram, kpi_id, kpi, {_COS} AS score FROM gramv JOIN gram USING (sent_id, x, y), kpi),
bestgram AS (SELECT sent_id, ngram, kpi AS kpi_ngram, score AS score_ngram FROM grams QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, x, y, kpi_id) = 1),
labels_ AS (SELECT DISTINCT sent_id, CASE WHEN n % 7 <> 0 THEN 'kpi_' || (n % 10) END AS Akpi, CASE WHEN n % 7 <> 0 THEN 'kpi_' || (n % 3) END AS Atopic, CASE WHEN n % 7 <> 0 THEN 'kpi_' || (n % 2) END AS Avalue FROM tok)"""
