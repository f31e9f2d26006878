"""Queries of the structure of texts: headings, runs of numbers, sections, chunk ids, tokens and surfaces of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import phrases as Ph
from quillmesh.functions import structure as S
from quillmesh.operators.graph import predicate_name
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()
_lit = lambda p: "'" + p.replace("'", "''") + "'"
_CHUNKS = "c AS (SELECT DISTINCT chunk_id, text FROM chunk WHERE text IS NOT NULL), l AS (SELECT md5(chunk_id || text) AS k, chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    return c.select(F.md5(F.concat("chunk_id", "text")).alias("k"), "chunk_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


@R.query("number_runs", rf"""WITH {_CHUNKS}, f AS (SELECT *, regexp_matches(trim(line), '^[\d.,%+\-–—()]+$') AND regexp_matches(line, '\d') AS num, trim(line) <> '' AND NOT starts_with(trim(line), '|') AND NOT regexp_matches(trim(line), '[.:;!?]$') AND length(trim(line)) <= 28 AND len(string_split_regex(trim(line), '\s+')) <= 4 AS label FROM l),
g AS (SELECT *, sum(CASE WHEN num OR label THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS island FROM f), r AS (SELECT chunk_id, k, island, count(*) AS n, count(*) FILTER (num) AS nums FROM g WHERE num OR label GROUP BY 1, 2, 3)
SELECT chunk_id, CAST(sum(n) AS BIGINT) AS dropped_lines, count(*) AS runs FROM r WHERE nums >= 4 AND nums >= 0.4 * n GROUP BY 1""")
def number_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are dropped as data of charts: runs of numbers and labels with four numbers or more, two fifths of the run."""
    f = _lines(spark, sf).withColumn("num", S.number_line(F.col("line"))).withColumn("member", F.col("num") | S.label_line(F.col("line")))
    g = f.withColumn("island", F.sum(F.when(F.col("member"), 0).otherwise(1)).over(Window.partitionBy("k").orderBy("i"))).where("member")
    r = g.groupBy("chunk_id", "k", "island").agg(F.count("*").alias("n"), F.count(F.when(F.col("num"), 1)).alias("nums")).where("nums >= 4 and nums >= 0.4 * n")
    return r.groupBy("chunk_id").agg(F.sum("n").alias("dropped_lines"), F.count("*").alias("runs"))


_WORDS_SQL = r"list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')"
_MINOR_SQL = "(" + ", ".join(f"'{w}'" for w in S.MINOR) + ")"
_LEVEL_SQL = rf"""CASE WHEN s = '' THEN NULL WHEN regexp_matches(s, '^#{{1,6}}\s+\S') THEN length(regexp_extract(s, '^(#{{1,6}})\s', 1)) WHEN regexp_matches(s, '(?i)https?://|www\.') OR regexp_matches(s, '^(?:[-*•–]|\(?[a-z]\))\s') OR starts_with(s, '|') OR len({_WORDS_SQL}) > 14 THEN NULL
 WHEN regexp_extract(s, '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,3}})\.?\s+[A-Z]', 1) <> '' AND NOT ended AND len({_WORDS_SQL}) <= 8 THEN len(string_split(regexp_extract(s, '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,3}})\.?\s+[A-Z]', 1), '.')) WHEN regexp_matches(s, {_lit(S.LABELLED)}) AND NOT ended THEN 2 WHEN NOT start OR NOT regexp_matches(next, '[a-z]{{2,}}.*\s') THEN NULL
 WHEN letters <> '' AND len({_WORDS_SQL}) <= 8 AND length(regexp_replace(letters, '[a-z]', '', 'g')) > 0.85 * length(letters) THEN 2
 WHEN len({_WORDS_SQL}) <= 8 AND NOT ended AND len(content) > 0 AND len(list_filter(content, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN 3 END"""


@R.query("heading_levels", rf"""WITH {_CHUNKS}, b AS (SELECT *, coalesce(trim(lag(line) OVER (PARTITION BY k ORDER BY i)), '') = '' AS start, CASE WHEN trim(line) <> '' THEN line END AS body FROM l),
n AS (SELECT chunk_id, k, i, trim(line) AS s, start, coalesce(first_value(body IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS next FROM b),
x AS (SELECT *, regexp_matches(s, '[.!?:;,]$') AS ended, regexp_replace(s, '[^A-Za-z]', '', 'g') AS letters, list_filter({_WORDS_SQL}, lambda w: regexp_replace(lower(w), '[.,;:()]', '', 'g') NOT IN {_MINOR_SQL}) AS content FROM n),
v AS (SELECT chunk_id, s AS heading, CAST({_LEVEL_SQL} AS INTEGER) AS level FROM x) SELECT chunk_id, heading, level, count(*) AS n FROM v WHERE level IS NOT NULL GROUP BY 1, 2, 3""")
def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are headings, with their levels."""
    w = Window.partitionBy("k").orderBy("i")
    after = F.first(F.when(F.trim("line") != "", F.col("line")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    d = _lines(spark, sf).withColumn("start", F.coalesce(F.trim(F.lag("line").over(w)), F.lit("")) == "").withColumn("next", F.coalesce(after, F.lit("")))
    d = d.select("chunk_id", F.trim("line").alias("heading"), S.heading_level(F.col("line"), F.col("start"), F.col("next")).alias("level")).where("level is not null")
    return d.groupBy("chunk_id", "heading", "level").agg(F.count("*").alias("n"))


_SECTIONS = r"""b0 AS (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS b, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, trim(b, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM b0), k AS (SELECT doc_id, i, b, length(b) <= 80 AND NOT regexp_matches(b, '[.!?:;,।]\s*$') AND NOT regexp_matches(b, '^\s*\|') AND NOT regexp_matches(b, '^\s*([-*•–]|\d{1,3}[.)])\s') AS h FROM b WHERE b <> ''),
s AS (SELECT *, row_number() OVER w = 1 OR h AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sec FROM s),
sec AS (SELECT doc_id, CAST(sec AS INTEGER) AS section_index, CAST(sum(CASE WHEN h THEN 0 ELSE length(b) END) AS INTEGER) AS chars FROM g GROUP BY doc_id, sec)"""


@R.query("merged_sections", f"""WITH {_SECTIONS}, m AS (SELECT *, sum(CASE WHEN section_index = 0 OR chars >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section_index) AS grp FROM sec),
t AS (SELECT doc_id, grp, sum(chars) AS chars, count(*) AS sections, count(*) OVER (PARTITION BY doc_id) AS groups FROM m GROUP BY 1, 2), f AS (SELECT *, CASE WHEN grp = 1 AND chars < 200 AND groups > 1 THEN 2 ELSE grp END AS g FROM t) SELECT doc_id, CAST(g AS BIGINT) AS section_group, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(sections) AS BIGINT) AS sections FROM f GROUP BY 1, 2""")
def merged_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with those under 200 characters merged into the one before, and a short first one into the next."""
    s = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(Ph.sections(F.col("text"))).alias("section_index", "s")).select("doc_id", "section_index", F.col("s.chars").alias("chars"))
    g = s.withColumn("grp", F.sum(F.when((F.col("section_index") == 0) | (F.col("chars") >= 200), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("section_index")))
    t = g.groupBy("doc_id", "grp").agg(F.sum("chars").alias("chars"), F.count("*").alias("sections"))
    t = t.withColumn("groups", F.count("*").over(Window.partitionBy("doc_id")))
    return t.groupBy("doc_id", F.when((F.col("grp") == 1) & (F.col("chars") < 200) & (F.col("groups") > 1), 2).otherwise(F.col("grp")).alias("section_group")).agg(F.sum("chars").alias("chars"), F.sum("sections").alias("sections"))


@R.query("chunk_ids", f"""WITH c AS (SELECT DISTINCT document_id, section_type, chunk_index, text FROM chunk WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, section_type, text ORDER BY chunk_index) - 1 AS ordinal FROM c),
h AS (SELECT document_id, chunk_index, sha256(text) AS content_key, sha1(unhex('{S.NAMESPACE.replace("-", "")}') || encode(concat_ws('|', document_id, section_type, sha256(text), CAST(ordinal AS VARCHAR)))) AS h FROM o)
SELECT document_id, chunk_index, content_key, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1), h[18:20], '-', h[21:32]) AS stable_id FROM h""")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The identity of each chunk by its own content within its document, whatever its place."""
    c = table(spark, sf, "chunk").where("text is not null").select("document_id", "section_type", "chunk_index", "text").distinct()
    c = c.select("document_id", "section_type", "chunk_index", F.sha2("text", 256).alias("content_key"))
    c = c.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id", "section_type", "content_key").orderBy("chunk_index")) - 1)
    return c.select("document_id", "chunk_index", "content_key", S.uuid5(F.concat_ws("|", "document_id", "section_type", "content_key", F.col("ordinal").cast("string"))).alias("stable_id"))


@R.query("chunk_trails", r"""WITH d AS (SELECT document_id, min(title) AS title FROM documents GROUP BY 1), c AS (SELECT DISTINCT chunk_id, document_id, section_heading FROM chunk), t AS (SELECT chunk_id, section_heading, array_to_string(list_filter([trim(title), trim(section_heading)], lambda x: x IS NOT NULL AND x <> ''), ' › ') AS t FROM c LEFT JOIN d USING (document_id))
SELECT chunk_id, section_heading, array_to_string(string_split_regex(t, '\s+')[1:32], ' ') AS trail FROM t""")
def chunk_trails(spark: SparkSession, sf: str) -> DataFrame:
    """Title and heading that stand before a chunk where it is embedded."""
    d = table(spark, sf, "documents").groupBy("document_id").agg(F.min("title").alias("title"))
    c = table(spark, sf, "chunk").select("chunk_id", "document_id", "section_heading").distinct().join(d, "document_id", "left")
    return c.select("chunk_id", "section_heading", S.trail(F.col("title"), F.col("section_heading")).alias("trail"))


_PLAIN_SQL = lambda c: f"trim(regexp_replace(replace(regexp_replace(lower({c}), '[''’]s\\b', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@R.query("singular_tokens", f"""WITH t AS (SELECT doc_id, list_filter(string_split({_PLAIN_SQL('title')}, ' '), lambda w: length(w) >= 3) AS w FROM documents WHERE title IS NOT NULL), u AS (SELECT DISTINCT doc_id, unnest(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[^s]s$') AND length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END)) AS token FROM t) SELECT * FROM u""")
def singular_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("title is not null").select("doc_id", F.explode(S.singular_tokens(F.col("title"))).alias("token"))


@R.query("name_surfaces", r"""WITH s AS (SELECT DISTINCT surface FROM (SELECT section_heading AS surface FROM chunk UNION ALL SELECT title FROM documents UNION ALL SELECT theme FROM documents_theme) WHERE surface IS NOT NULL)
SELECT surface, len(string_split_regex(trim(surface), '\s+')) > 10 OR regexp_matches(surface, '(?i)\b(?:is|are|was|were|has|have|will|which|that)\b') OR NOT regexp_matches(surface, '[A-Z]') AS prose FROM s""")
def name_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, titles and themes, with whether they are too much of a sentence to be names."""
    s = table(spark, sf, "chunk").select(F.col("section_heading").alias("surface")).unionByName(table(spark, sf, "documents").select(F.col("title").alias("surface"))).unionByName(table(spark, sf, "documents_theme").select(F.col("theme").alias("surface")))
    return s.where("surface is not null").distinct().select("surface", S.is_prose(F.col("surface")).alias("prose"))


@R.query("file_slugs", r"""WITH t AS (SELECT DISTINCT title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL) SELECT title, CASE WHEN length(s) <= 30 THEN s ELSE regexp_replace(s[1:31], '-[^-]*$', '')[1:30] END AS slug FROM t""")
def file_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("title is not null").select("title").distinct().select("title", S.file_slug(F.col("title"), 30).alias("slug"))


@R.query("predicate_names", r"""SELECT DISTINCT section_heading AS surface, upper(regexp_replace(regexp_replace(trim(section_heading), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS predicate FROM chunk WHERE section_heading IS NOT NULL""")
def predicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk").where("section_heading is not null").select(F.col("section_heading").alias("surface")).distinct().select("surface", predicate_name(F.col("surface")).alias("predicate"))


@R.query("quote_places", r"""SELECT DISTINCT chunk_id, section_heading AS quote, strpos(regexp_replace(trim(text), '\s+', ' ', 'g'), regexp_replace(trim(section_heading), '\s+', ' ', 'g')) AS place FROM chunk WHERE text IS NOT NULL AND trim(section_heading) <> '' AND strpos(regexp_replace(trim(text), '\s+', ' ', 'g'), regexp_replace(trim(section_heading), '\s+', ' ', 'g')) > 0""")
def quote_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where a chunk's heading stands in its text, blanks of any length being equal."""
    squeezed = lambda c: F.regexp_replace(F.trim(F.col(c)), r"\s+", " ")
    d = table(spark, sf, "chunk").where("text is not null and trim(section_heading) <> ''").select("chunk_id", F.col("section_heading").alias("quote"), F.instr(squeezed("text"), squeezed("section_heading")).cast("long").alias("place"))
    return d.where("place > 0").distinct()


@R.query("pattern_mentions", r"""WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, 'code' AS kind, unnest(regexp_extract_all(text, '\b[A-Z]{2,}[0-9]{2,}[A-Z0-9]*\b')) AS surface FROM t UNION ALL SELECT doc_id, 'person', unnest(regexp_extract_all(text, '\b(?:Dr|Prof|Mr|Mrs|Ms)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)*')) FROM t
 UNION ALL SELECT doc_id, 'organisation', unnest(regexp_extract_all(text, '\b(?:[A-Z][a-z]+ )+(?:Institute|Foundation|Council|University|Ministry|Agency)\b')) FROM t) SELECT doc_id, kind, surface, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def pattern_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Codes, titled persons and organisations that texts name, by their form."""
    forms = {"code": r"\b[A-Z]{2,}[0-9]{2,}[A-Z0-9]*\b", "person": r"\b(?:Dr|Prof|Mr|Mrs|Ms)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)*", "organisation": r"\b(?:[A-Z][a-z]+ )+(?:Institute|Foundation|Council|University|Ministry|Agency)\b"}

    def named(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface"))

    each = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), named(k)) for k, p in forms.items())))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.inline(each)).groupBy("doc_id", "kind", "surface").agg(F.count("*").alias("n"))


@R.query("uncovered_blocks", r"""WITH p AS (SELECT DISTINCT document_id, front_text FROM pdf_evidence WHERE front_text IS NOT NULL), d AS (SELECT document_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(min(text), '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4)) AS page FROM documents GROUP BY 1),
b AS (SELECT document_id, unnest(string_split_regex(front_text, '\n[ \t]*\n')) AS block FROM p), w AS (SELECT document_id, block, list_distinct(list_filter(string_split(trim(regexp_replace(lower(block), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)) AS w FROM b)
SELECT document_id, md5(block) AS block, count(*) AS n FROM w LEFT JOIN d USING (document_id) WHERE len(w) > 0 AND len(list_intersect(w, coalesce(page, []))) < 0.6 * len(w) GROUP BY 1, 2""")
def uncovered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a PDF's text of which the page that it hangs on says less than three fifths of the words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= 4))
    d = table(spark, sf, "documents").groupBy("document_id").agg(F.min("text").alias("text")).select("document_id", words(F.coalesce("text", F.lit(""))).alias("page"))
    p = table(spark, sf, "pdf_evidence").where("front_text is not null").select("document_id", "front_text").distinct()
    b = p.select("document_id", F.explode(F.split("front_text", r"\n[ \t]*\n", -1)).alias("block")).withColumn("w", words(F.col("block"))).where(F.size("w") > 0)
    j = b.join(d, "document_id", "left").where(F.size(F.array_intersect("w", F.coalesce("page", F.array().cast("array<string>")))) < 0.6 * F.size("w"))
    return j.groupBy("document_id", F.md5("block").alias("block")).agg(F.count("*").alias("n"))


@R.query("props_redacted", r"""SELECT event_id, event_type, CASE WHEN regexp_matches(k, '(?i)(?:secret|token|password|passwd|api_?key|authorization|credential)') THEN '[hidden]' ELSE v END AS v, k FROM (SELECT event_id, event_type, unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events)""")
def props_redacted(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", S.redacted(F.from_json("props", "map<string,string>")).alias("m"))
    return e.select("event_id", "event_type", F.explode("m").alias("k", "v"))


@R.query("score_scalars", """WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(coalesce(nullif(round(x, 1), 0), y), 6) AS dense FROM s""")
def score_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """The logistic of a score, and the second score where the first is zero."""
    s = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return s.select("vec_id", F.round(S.sigmoid(F.col("x")), 6).alias("sigmoid"), F.round(F.coalesce(F.nullif(F.round("x", 1), F.lit(0.0)), "y"), 6).alias("dense"))
