"""Queries of what questions ask for, over the questions of evaluation items and the titles of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import questions as Q
from quillmesh.functions.names import fold
from quillmesh.operators import catalog as C
from quillmesh.plans.knowledge import _FOLD
from quillmesh.plans.registry import Registry
from quillmesh.plans.retrieval import _CAND, _candidates
from quillmesh.session import table

R = Registry()

_ASKED = "asked AS (SELECT 'item' AS source, item_id AS id, question FROM eval_items UNION ALL SELECT 'title', doc_id, title FROM documents)"
_lit = lambda p: "'" + p.replace("'", "''") + "'"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items").select(F.lit("item").alias("source"), F.col("item_id").alias("id"), "question")
    return items.unionByName(table(spark, sf, "documents").select(F.lit("title").alias("source"), F.col("doc_id").alias("id"), F.col("title").alias("question")))


_MODE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, {_lit(p)}) THEN '{m}'" for m, p in Q.TIMES.items()) + " ELSE 'none' END"


@R.query("temporal_modes", f"WITH {_ASKED}, p AS (SELECT source, id, regexp_replace(lower(coalesce(question, '')), '\\bfuture\\s+of\\b', ' ', 'g') AS q FROM asked) SELECT source, id, {_MODE_SQL} AS mode FROM p")
def temporal_modes(spark: SparkSession, sf: str) -> DataFrame:
    """What time each question is about."""
    return _asked(spark, sf).select("source", "id", Q.temporal_mode(F.col("question")).alias("mode"))


@R.query("relevance_tolerances", f"WITH {_ASKED} SELECT source, id, CASE WHEN regexp_matches(lower(question), {_lit(Q.VOLATILE)}) THEN 0.06::DOUBLE ELSE 0.03::DOUBLE END AS tolerance FROM asked")
def relevance_tolerances(spark: SparkSession, sf: str) -> DataFrame:
    """How far apart scores may be for each question, wider on topics that go out of date."""
    return _asked(spark, sf).select("source", "id", Q.relevance_tolerance(F.col("question")).alias("tolerance"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in Q.STOP) + ")"
_first = lambda x: f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda z: list_position({x}, z[1]) = z[2]), lambda z: z[1])"


def _content_sql(c: str) -> str:
    return f"list_filter(string_split({_FOLD.format(c)}, ' '), lambda w: length(w) >= 4 AND w NOT IN {_STOPS})"


@R.query("question_terms", f"""WITH {_ASKED}, t AS (SELECT source, id, regexp_extract_all(question, '\\b[A-Z]{{2,6}}\\b') AS a, {_content_sql('question')} AS w FROM asked WHERE question IS NOT NULL),
u AS (SELECT source, id, {_first('a')} AS a, {_first('w')} AS w FROM t) SELECT source, id, array_to_string(list_concat(a, list_filter(w, lambda x: NOT list_contains(list_transform(a, lambda y: lower(y)), x))), '|') AS terms FROM u""")
def question_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The acronyms and content words of each question."""
    return _asked(spark, sf).where("question is not null").select("source", "id", F.array_join(Q.content_terms(F.col("question")), "|").alias("terms"))


@R.query("question_key_terms", f"""WITH {_ASKED}, t AS (SELECT source, id, list_concat(regexp_extract_all(question, '"([^"]{{2,80}})"', 1), regexp_extract_all(question, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b'), regexp_extract_all(question, '\\b[A-Za-z]+[0-9][A-Za-z0-9]*\\b'),
  regexp_extract_all(question, '\\b[A-Z]{{2,6}}\\b'), regexp_extract_all(question, '\\b(?:19|20)[0-9]{{2}}\\b')) AS k, {_content_sql('question')} AS w FROM asked WHERE question IS NOT NULL), u AS (SELECT source, id, {_first('k')} AS k, {_first('w')} AS w FROM t)
SELECT source, id, array_to_string(CASE WHEN len(k) > 0 THEN list_filter(k, lambda x: len(list_filter(k, lambda y: y <> x AND starts_with(lower(y), lower(x)))) = 0) ELSE w END, '|') AS terms FROM u""")
def question_key_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that a keyword search of each question would look for."""
    return _asked(spark, sf).where("question is not null").select("source", "id", F.array_join(Q.key_terms(F.col("question")), "|").alias("terms"))


@R.query("residual_topics", f"""WITH t AS (SELECT item_id, {_content_sql('question')} AS w FROM eval_items WHERE question IS NOT NULL), d AS (SELECT DISTINCT doc_id, unnest(string_split({_FOLD.format('title')}, ' ')) AS w FROM documents WHERE title IS NOT NULL),
n AS (SELECT count(*) AS n FROM documents WHERE title IS NOT NULL), f AS (SELECT w, count(*) AS df FROM d GROUP BY 1), v AS (SELECT DISTINCT unnest(string_split({_FOLD.format('theme')}, ' ')) AS w FROM documents_theme WHERE theme IS NOT NULL)
SELECT DISTINCT item_id, w AS word FROM (SELECT item_id, unnest(w) AS w FROM t) LEFT JOIN f USING (w) CROSS JOIN n WHERE w NOT IN (SELECT w FROM v) AND coalesce(df, 0) <= 0.1 * n.n""")
def residual_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Words of questions that no theme covers and that few titles have."""
    w = table(spark, sf, "eval_items").where("question is not null").select("item_id", F.explode(Q.content_words(F.col("question"))).alias("word"))
    titles = table(spark, sf, "documents").where("title is not null")
    df = titles.select(F.explode(F.array_distinct(F.split(fold(F.col("title")), " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    themes = table(spark, sf, "documents_theme").where("theme is not null").select(F.explode(F.split(fold(F.col("theme")), " ")).alias("word")).distinct()
    # the few words of questions are the side that decides what is kept
    kept = w.select("word").distinct().join(themes, "word", "left_anti").join(df, "word", "left").crossJoin(titles.agg(F.count("*").alias("n"))).where(F.coalesce("df", F.lit(0)) <= 0.1 * F.col("n"))
    return w.join(kept.select("word"), "word").select("item_id", "word")


@R.query("plan_support", f"WITH t AS (SELECT item_id, list_distinct({_content_sql('question')}) AS w, string_split({_FOLD.format('passage')}, ' ') AS p FROM eval_items WHERE question IS NOT NULL) SELECT item_id, len(list_filter(w, lambda x: list_contains(coalesce(p, []), x))) > 0 AS supported, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(coalesce(p, []), x))) / len(w), 6) END AS coverage FROM t")
def plan_support(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any content word of a question stands in its passage, and the share that does."""
    t = table(spark, sf, "eval_items").where("question is not null").select("item_id", Q.content_words(F.col("question")).alias("w"), "passage")
    share = Q.covered_share(F.col("w"), F.col("passage"))
    return t.select("item_id", F.coalesce(share > 0, F.lit(False)).alias("supported"), F.round(share, 6).alias("coverage"))


_SCORE_SQL = "(0.5 + 0.5 / len(t))"


@R.query("prefix_matches", f"""WITH q AS (SELECT DISTINCT w AS asked FROM (SELECT unnest({_content_sql('question')}) AS w FROM eval_items WHERE question IS NOT NULL)), v AS (SELECT DISTINCT theme, list_filter(string_split({_FOLD.format('theme')}, ' '), lambda x: x <> '') AS t FROM documents_theme WHERE theme IS NOT NULL),
s AS (SELECT asked, theme, list_max(list_transform(t, lambda x: CASE WHEN x = asked THEN {_SCORE_SQL} WHEN starts_with(x, asked) OR starts_with(asked, x) THEN {_SCORE_SQL} * (0.6 + 0.4 * least(length(x), length(asked)) / greatest(length(x), length(asked))) ELSE 0 END)) AS score FROM q, v WHERE len(t) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(score, 9) DESC, theme) AS rank FROM s WHERE score >= 0.5) SELECT asked, theme, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def prefix_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The three themes that each word asked for names best, of those that are likely enough.

    Words and themes meet over the first three letters, which one that begins the other shares; themes of shorter words
    meet over all beginnings of a word.
    """
    asked = table(spark, sf, "eval_items").where("question is not null").select(F.explode(Q.content_words(F.col("question"))).alias("asked")).distinct()
    themes = table(spark, sf, "documents_theme").where("theme is not null").select("theme", F.filter(F.split(fold(F.col("theme")), " "), lambda x: x != "").alias("t")).distinct()
    heads = lambda w: F.array_distinct(F.transform(w, lambda x: F.substring(x, 1, 3)))
    a = asked.select("asked", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.col("asked"), F.lit(1), n)))).alias("head"))
    met = a.join(themes.select("theme", "t", F.explode(heads(F.col("t"))).alias("head")), "head").select("asked", "theme", "t").distinct()
    s = met.withColumn("score", Q.prefix_score(F.col("asked"), F.col("t"))).where("score >= 0.5")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), "theme"))).where("rank <= 3")
    return s.select("asked", "theme", F.round("score", 6).alias("score"), "rank")


@R.query("asked_editions", f"""WITH {_ASKED}, p AS (SELECT source, id, lower(question) AS q FROM asked WHERE question IS NOT NULL) SELECT source, id, CASE WHEN regexp_matches(q, '\\b(?:19|20)\\d{{2}}(?:-\\d{{2,4}})?\\b') THEN regexp_extract(q, '\\b((?:19|20)\\d{{2}}(?:-\\d{{2,4}})?)\\b', 1)
 WHEN regexp_matches(q, '\\b(?:latest|newest|most recent|current)\\b') THEN 'latest' WHEN regexp_matches(q, '\\b(?:first|earliest|oldest)\\b') THEN 'earliest' END AS edition FROM p""")
def asked_editions(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).where("question is not null").select("source", "id", Q.edition_asked(F.col("question")).alias("edition"))


@R.query("asked_relations", r"""WITH asked AS (SELECT item_id, lower(question) AS q FROM eval_items WHERE question IS NOT NULL), c(name, p) AS (VALUES ('funded_by', '\b(?:fund(?:ed|s|ing|er)|sponsor(?:ed|s)?|donor)'), ('partner_of', '\b(?:partner|collaborat)'), ('led_by', '\b(?:led by|leads?\b|principal investigator|headed by)'),
 ('works_at', '\b(?:works? (?:at|for)|employed)'), ('member_of', '\bmembers? of'), ('authored', '\b(?:wrote|written by|authored|author of)'))
SELECT a.item_id, (SELECT arg_min(c.name, (length(regexp_extract(a.q, '(?s)^(.*?)(?:' || c.p || ')', 1)), c.name)) FROM c WHERE regexp_matches(a.q, c.p)) AS relation FROM asked a""")
def asked_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The relationship that each question names first."""
    return table(spark, sf, "eval_items").where("question is not null").select("item_id", Q.relation_asked(F.col("question")).alias("relation"))


@R.query("asked_theme_scopes", r"""WITH asked AS (SELECT item_id, lower(question) AS q FROM eval_items), m AS (SELECT item_id, regexp_matches(coalesce(q, ''), '\b(?:main|primary|core|key)\s+themes?\b') AS a, regexp_matches(coalesce(q, ''), '\b(?:other|secondary|remaining|additional)\s+themes?\b') AS b FROM asked)
SELECT item_id, CASE WHEN a AND NOT b THEN 'main' WHEN b AND NOT a THEN 'other' ELSE 'all' END AS scope FROM m""")
def asked_theme_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", Q.theme_scope(F.col("question")).alias("scope"))


def _catalog(spark: SparkSession, sf: str) -> C.Catalog:
    return C.Catalog(table(spark, sf, "documents").withColumnRenamed("source", "bundle"), table(spark, sf, "documents_author"), table(spark, sf, "documents_theme"))


@R.query("zero_widening", """WITH s AS (SELECT * FROM documents WHERE source_type = 'manual'), n(scope, documents) AS (SELECT 'asked', count(*) FILTER (effective_start_date >= DATE '2031-01-01') FROM s UNION ALL SELECT 'without_period', count(*) FROM s
 UNION ALL SELECT 'without_type', count(*) FILTER (effective_start_date >= DATE '2031-01-01') FROM documents) SELECT * FROM n""")
def zero_widening(spark: SparkSession, sf: str) -> DataFrame:
    """What an empty scope would hold without its period, and without its type."""
    return C.widened_counts(_catalog(spark, sf), C.Scope(source_type="manual", effective_from="2031-01-01"))


@R.query("lookup_chain", """SELECT title, CASE WHEN count(DISTINCT document_id) = 1 THEN min(document_id) END AS document_id, count(DISTINCT document_id) AS documents FROM (SELECT lower(trim(title)) AS title, document_id FROM documents WHERE title IS NOT NULL) WHERE title <> '' GROUP BY 1""")
def lookup_chain(spark: SparkSession, sf: str) -> DataFrame:
    """For each title the document that it names, if it names one alone."""
    return C.unique_titles(table(spark, sf, "documents"))


@R.query("asked_constraints", f"""WITH {_ASKED}, q AS (SELECT source, id, question, lower(coalesce(question, '')) AS q FROM asked) SELECT source, id, regexp_matches(q, {_lit(Q.ON_TEXT)}) AS on_text, regexp_matches(q, {_lit(Q.ON_TAGS)}) AS on_tags, regexp_matches(q, {_lit(Q.FOR_DOCUMENT)}) AND NOT regexp_matches(q, {_lit(Q.ABOUT_CONTENT)}) AS for_document,
 (contains(q, '?') OR regexp_matches(q, '^\\s*(?:who|what|when|where|why|how|which|is|are|was|were|do|does|did|can|list|show|tell)\\b')) AND coalesce(len({_content_sql('question')}), 0) > 0 AS asks FROM q""")
def asked_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each question is put to the text, to tags or for a document, and whether it is one."""
    return _asked(spark, sf).select("source", "id", Q.constraints(F.col("question")).alias("c"), Q.is_question(F.col("question")).alias("asks")).select("source", "id", "c.*", "asks")


@R.query("covered_topics", f"""WITH q AS (SELECT item_id, list_distinct({_content_sql('question')}) AS a FROM eval_items WHERE question IS NOT NULL), t AS (SELECT DISTINCT theme, list_distinct(list_filter(string_split({_FOLD.format('theme')}, ' '), lambda x: length(x) >= 4)) AS w FROM documents_theme WHERE theme IS NOT NULL)
SELECT item_id, theme, len(list_intersect(w, a)) = len(w) AS covered, len(list_intersect(w, a)) = len(a) AS stands_for FROM q JOIN t ON len(list_intersect(w, a)) > 0""")
def covered_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Themes that share a word with a question: whether all words of the theme are asked for, and whether the theme carries all words asked."""
    q = table(spark, sf, "eval_items").where("question is not null").select("item_id", Q.content_words(F.col("question")).alias("a"))
    t = table(spark, sf, "documents_theme").where("theme is not null").select("theme", F.array_distinct(F.filter(F.split(fold(F.col("theme")), " "), lambda x: F.length(x) >= 4)).alias("w")).distinct()
    met = q.select("item_id", F.size("a").alias("n"), F.explode("a").alias("word")).join(t.select("theme", F.size("w").alias("m"), F.explode("w").alias("word")), "word")
    g = met.groupBy("item_id", "theme", "n", "m").agg(F.count("*").alias("k"))
    return g.select("item_id", "theme", (F.col("k") == F.col("m")).alias("covered"), (F.col("k") == F.col("n")).alias("stands_for"))


@R.query("narrow_margins", f"WITH {_CAND} SELECT query_id, CAST(max(score) FILTER (rank = 2) - max(score) FILTER (rank = 3) AS DOUBLE) < 0.02 AS ambiguous FROM cand GROUP BY 1")
def narrow_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the best answer to each question, after the question's own row, leads the next by too little to be taken for it."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return _candidates(spark, sf).groupBy("query_id").agg((at(2) - at(3) < 0.02).alias("ambiguous"))


@R.query("stale_runs", "WITH r AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, coalesce(last < TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR, false) AS stale FROM r")
def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the last run is older than half a day; one of unknown age is not stale."""
    r = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return r.select("user_id", F.coalesce(F.col("last") < F.expr("timestamp_ntz'2024-01-30' - INTERVAL 12 HOUR"), F.lit(False)).alias("stale"))
