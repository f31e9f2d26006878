"""Queries of profiles, leading rows, inheritance, identifiers, date checks and table clean-up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import names as N
from quillmesh.operators.likeness import like_texts, ratio
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()

_CURRENT = "cur AS (SELECT chunk_id, unnest(arg_max(s, (indexed_at, s)), recursive := true) FROM (SELECT chunk_id, indexed_at, {'document_id': document_id, 'bundle': bundle, 'chunk_index': chunk_index, 'section_type': section_type, 'text': text} AS s FROM chunk) GROUP BY chunk_id)"


def _current_chunks(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["document_id", "bundle", "chunk_index", "section_type", "text"]
    s = F.max(F.struct("indexed_at", *cols)).alias("s")
    return table(spark, sf, "chunk").where("chunk_id is not null").groupBy("chunk_id").agg(s).select("chunk_id", *(F.col(f"s.{c}").alias(c) for c in cols))


@R.query("load_chunks", f"WITH {_CURRENT} SELECT document_id, chunk_id, chunk_index, length(text) AS chars FROM cur")
def load_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The current version of every chunk."""
    return _current_chunks(spark, sf).select("document_id", "chunk_id", "chunk_index", F.length("text").cast("long").alias("chars"))


@R.query("lead_chunks", f"WITH {_CURRENT} SELECT document_id, arg_min(chunk_id, (chunk_index, chunk_id)) AS chunk_id, min(chunk_index) AS chunk_index FROM cur WHERE chunk_index IS NOT NULL AND document_id IS NOT NULL GROUP BY 1")
def lead_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first chunk of every document."""
    c = _current_chunks(spark, sf).where("chunk_index is not null and document_id is not null")
    return c.groupBy("document_id").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("m")).select("document_id", "m.chunk_id", "m.chunk_index")


@R.query("leading_chunks", f"WITH {_CURRENT} SELECT document_id, chunk_id, position FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS position FROM cur WHERE chunk_index IS NOT NULL AND document_id IS NOT NULL) WHERE position <= 3")
def leading_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first three chunks of every document; salted, so that a document with many chunks sends three per salt on."""
    c = _current_chunks(spark, sf).where("chunk_index is not null and document_id is not null").select("document_id", "chunk_id", "chunk_index", F.pmod(F.xxhash64("chunk_id"), F.lit(16)).alias("salt"))
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index", "chunk_id"))
    few = c.withColumn("p", w("document_id", "salt")).where("p <= 3")
    return few.withColumn("position", w("document_id").cast("long")).where("position <= 3").select("document_id", "chunk_id", "position")


@R.query("chunk_ordinals", f"WITH {_CURRENT} SELECT chunk_id, row_number() OVER (PARTITION BY document_id, section_type, text ORDER BY chunk_index NULLS FIRST, chunk_id) - 1 AS ordinal FROM cur")
def chunk_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Which occurrence of the same text of a document each chunk is; texts are compared by their hash and length."""
    c = _current_chunks(spark, sf).select("chunk_id", "document_id", "section_type", F.sha2("text", 256).alias("h"), "chunk_index")
    w = Window.partitionBy("document_id", "section_type", "h").orderBy(F.col("chunk_index").asc_nulls_first(), "chunk_id")
    return c.select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@R.query("chunk_sizes", f"WITH {_CURRENT} SELECT bundle, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS most FROM cur GROUP BY 1")
def chunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text").cast("long")
    return _current_chunks(spark, sf).groupBy("bundle").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.max(n).alias("most"))


@R.query("inherited_attachments", """SELECT DISTINCT p.document_id, p.url, d.title AS parent_title, d.lang, CAST(d.effective_start_date AS VARCHAR) AS inherited_date, 'inherited' AS date_source FROM pdf_evidence p JOIN documents d USING (document_id)""")
def inherited_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Attached files with what they take over from their page."""
    d = table(spark, sf, "documents").select("document_id", F.col("title").alias("parent_title"), "lang", F.col("effective_start_date").cast("string").alias("inherited_date"))
    return table(spark, sf, "pdf_evidence").select("document_id", "url").distinct().join(d, "document_id").select("document_id", "url", "parent_title", "lang", "inherited_date", F.lit("inherited").alias("date_source"))


@R.query("website_titles", "SELECT document_id, title, lang FROM documents WHERE source_type = 'website' AND title IS NOT NULL AND title <> ''")
def website_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source_type = 'website' and title is not null and title <> ''").select("document_id", "title", "lang")


@R.query("recent_log", "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'error'").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@R.query("theme_counts", "SELECT theme, count(DISTINCT document_id) AS documents FROM documents_theme WHERE theme IS NOT NULL GROUP BY 1")
def theme_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_theme").where("theme is not null").select("theme", "document_id").distinct().groupBy("theme").agg(F.count("document_id").alias("documents"))


@R.query("theme_latest", """SELECT theme, arg_max(document_id, (effective_start_date, document_id)) AS document_id, CAST(max(effective_start_date) AS VARCHAR) AS latest
FROM (SELECT DISTINCT t.theme, d.document_id, d.effective_start_date FROM documents_theme t JOIN documents d USING (document_id) WHERE d.effective_start_date IS NOT NULL AND t.theme IS NOT NULL) GROUP BY 1""")
def theme_latest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("effective_start_date is not null").select("document_id", "effective_start_date")
    j = table(spark, sf, "documents_theme").where("theme is not null").select("theme", "document_id").join(d, "document_id")
    return j.groupBy("theme").agg(F.max(F.struct("effective_start_date", "document_id")).alias("m")).select("theme", "m.document_id", F.col("m.effective_start_date").cast("string").alias("latest"))


_PROFILED = ["document_id", "title", "text", "lang", "source", "source_type", "linked_article_uuid", "effective_start_date"]


@R.query("field_profile", " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS different, CAST(min({c}) AS VARCHAR) AS least FROM documents" for c in _PROFILED if c != "text"))
def field_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Presence and different values of every field, in one pass over rows unpivoted to field and value."""
    fields = [c for c in _PROFILED if c != "text"]
    d = table(spark, sf, "documents").select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in fields))))
    d = d.groupBy("field", "v").agg(F.count("*").alias("n"))  # each value once before it is counted
    return d.groupBy("field").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("different"), F.min("v").alias("least"))


@R.query("vote_share", """WITH v AS (SELECT document_id, bundle, count(*) AS n FROM chunk WHERE bundle IS NOT NULL GROUP BY 1, 2) SELECT document_id, round(max(n) / sum(n), 6)::DOUBLE AS share FROM v GROUP BY 1""")
def vote_share(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk").where("bundle is not null").groupBy("document_id", "bundle").agg(F.count("*").alias("n"))
    return v.groupBy("document_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@R.query("claim_ids", """SELECT o_orderkey, 'claim_' || left(sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), 'PRIORITY', o_orderpriority)), 24) AS claim_id FROM orders""")
def claim_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that follow from what a claim says."""
    parts = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("PRIORITY"), "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("claim_"), F.left(F.sha2(parts, 256), F.lit(24))).alias("claim_id"))


@R.query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@R.query("copied_texts", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1")
def copied_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts under several documents; hashes are grouped, not texts."""
    d = table(spark, sf, "documents").where("text is not null and text <> ''").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@R.query("date_checks", """SELECT 'missing_date' AS check_name, count(DISTINCT document_id) AS offenders FROM state_record WHERE effective_start_date IS NULL
UNION ALL SELECT 'unreadable_date', count(DISTINCT document_id) FROM state_record WHERE effective_start_date IS NOT NULL AND TRY_CAST(effective_start_date AS DATE) IS NULL
UNION ALL SELECT 'date_without_precision', count(DISTINCT document_id) FROM state_record WHERE effective_start_date IS NOT NULL AND start_precision IS NULL
UNION ALL SELECT 'month_not_first_day', count(DISTINCT document_id) FROM state_record WHERE start_precision = 'month' AND day(TRY_CAST(effective_start_date AS DATE)) <> 1
UNION ALL SELECT 'implausible_year', count(DISTINCT document_id) FROM state_record WHERE year(TRY_CAST(effective_start_date AS DATE)) NOT BETWEEN 1990 AND 2026""")
def date_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against each rule, all rules in one pass."""
    d = F.col("effective_start_date").try_cast("date")
    rules = {
        "missing_date": F.col("effective_start_date").isNull(), "unreadable_date": F.col("effective_start_date").isNotNull() & d.isNull(), "date_without_precision": F.col("effective_start_date").isNotNull() & F.col("start_precision").isNull(),
        "month_not_first_day": (F.col("start_precision") == "month") & (F.day(d) != 1), "implausible_year": ~F.year(d).between(1990, 2026)}
    s = table(spark, sf, "state_record").agg(*(F.countDistinct(F.when(c, F.col("document_id"))).alias(n) for n, c in rules.items()))
    return s.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("offenders")) for n in rules))))


@R.query("date_deltas", """SELECT DISTINCT p.document_id, p.url, CAST(TRY_CAST(p.current_start_date AS DATE) AS VARCHAR) AS stated, y AS file_year, CASE WHEN year(TRY_CAST(p.current_start_date AS DATE)) - y > 1 THEN 'older_file' WHEN y - year(TRY_CAST(p.current_start_date AS DATE)) > 1 THEN 'late_upload' ELSE 'near' END AS kind
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(url, '/(\\d{4})-\\d{2}/', 1), '') AS INTEGER) AS y FROM pdf_evidence) p WHERE y IS NOT NULL AND TRY_CAST(p.current_start_date AS DATE) IS NOT NULL""")
def date_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """How the year of a file's path stands to the date stated for it."""
    y = F.regexp_extract("url", r"/(\d{4})-\d{2}/", 1).try_cast("int")
    d = table(spark, sf, "pdf_evidence").select("document_id", "url", F.col("current_start_date").try_cast("date").alias("d"), y.alias("file_year")).where("d is not null and file_year is not null").distinct()
    gap = F.year("d") - F.col("file_year")
    return d.select("document_id", "url", F.col("d").cast("string").alias("stated"), "file_year", F.when(gap > 1, "older_file").when(gap < -1, "late_upload").otherwise("near").alias("kind"))


@R.query("garbage_tables", r"""WITH r AS (SELECT table_id, unnest(string_split(markdown, chr(10))) AS row FROM (SELECT DISTINCT table_id, markdown FROM table_data WHERE markdown IS NOT NULL)),
c AS (SELECT table_id, unnest(string_split(trim(row, '| '), '|')) AS cell FROM r WHERE NOT regexp_matches(row, '^[\s|:-]*$'))
SELECT table_id, count(*) AS cells, count(*) FILTER (trim(cell) = '') AS empty_cells FROM c GROUP BY 1""")
def garbage_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and empty cells of each table, by which empty ones are thrown out."""
    t = table(spark, sf, "table_data").where("markdown is not null").select("table_id", "markdown").distinct()
    rows = F.filter(F.split("markdown", "\n", -1), lambda r: ~r.rlike(r"^[\s|:-]*$"))
    cells = F.flatten(F.transform(rows, lambda r: F.split(F.regexp_replace(r, r"^[| ]+|[| ]+$", ""), r"\|", -1)))
    d = t.select("table_id", cells.alias("c")).select("table_id", F.size("c").alias("n"), F.size(F.filter("c", lambda x: F.trim(x) == "")).alias("e"))
    return d.groupBy("table_id").agg(F.sum("n").alias("cells"), F.sum("e").alias("empty_cells")).where("cells > 0")


@R.query("mentioned_not_titled", """SELECT doc_id, title FROM documents WHERE contains(lower(text), 'ostrabrook') AND NOT contains(lower(coalesce(title, '')), 'ostrabrook')""")
def mentioned_not_titled(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(c), F.lit("ostrabrook"))
    return table(spark, sf, "documents").where(has(F.col("text")) & ~has(F.coalesce("title", F.lit("")))).select("doc_id", "title")


@R.query("by_period", """SELECT coalesce(CAST(year(effective_start_date) AS VARCHAR), 'Undated') AS period, count(*) AS documents, CAST(min(effective_start_date) AS VARCHAR) AS first_date FROM documents GROUP BY 1""")
def by_period(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("effective_start_date")
    return table(spark, sf, "documents").groupBy(F.coalesce(F.year(d).cast("string"), F.lit("Undated")).alias("period")).agg(F.count("*").alias("documents"), F.min(d).cast("string").alias("first_date"))


@R.query("year_spread", "SELECT source AS bundle, CAST(count(DISTINCT year(effective_start_date)) AS BIGINT) AS years, min(year(effective_start_date)) AS first_year, max(year(effective_start_date)) AS last_year FROM documents WHERE effective_start_date IS NOT NULL GROUP BY 1")
def year_spread(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("effective_start_date").cast("long")
    return table(spark, sf, "documents").where("effective_start_date is not null").groupBy(F.col("source").alias("bundle")).agg(F.countDistinct(y).alias("years"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@R.query("author_spellings", """WITH m AS (SELECT DISTINCT author, author_norm FROM documents_author WHERE author IS NOT NULL AND author_norm IS NOT NULL) SELECT author_norm, count(*) AS spellings, min(author) AS first_spelling FROM m GROUP BY 1 HAVING count(*) > 1""")
def author_spellings(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents_author").where("author is not null and author_norm is not null").select("author", "author_norm").distinct()
    return m.groupBy("author_norm").agg(F.count("*").alias("spellings"), F.min("author").alias("first_spelling")).where("spellings > 1")


@R.query("latest_publications", """SELECT author_norm, document_id, CAST(effective_start_date AS VARCHAR) AS day, position FROM (SELECT a.author_norm, d.document_id, d.effective_start_date, row_number() OVER (PARTITION BY a.author_norm ORDER BY d.effective_start_date DESC, d.document_id) AS position
 FROM (SELECT DISTINCT author_norm, document_id FROM documents_author WHERE author_norm IS NOT NULL) a JOIN documents d USING (document_id) WHERE d.effective_start_date IS NOT NULL) WHERE position <= 5""")
def latest_publications(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest documents of each author; salted, so that an author of very many documents sends five per salt on."""
    a = table(spark, sf, "documents_author").where("author_norm is not null").select("author_norm", "document_id").distinct()
    d = a.join(table(spark, sf, "documents").where("effective_start_date is not null").select("document_id", "effective_start_date"), "document_id").withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(16)))
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("effective_start_date"), "document_id"))
    d = d.withColumn("p", w("author_norm", "salt")).where("p <= 5").withColumn("position", w("author_norm").cast("long")).where("position <= 5")
    return d.select("author_norm", "document_id", F.col("effective_start_date").cast("string").alias("day"), "position")


@R.query("coauthors", """WITH a AS (SELECT DISTINCT document_id, author_norm FROM documents_author WHERE author_norm IS NOT NULL) SELECT x.author_norm AS author_a, y.author_norm AS author_b, count(*) AS documents FROM a x JOIN a y ON x.document_id = y.document_id AND x.author_norm < y.author_norm GROUP BY 1, 2""")
def coauthors(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of authors of the same documents; a document has few authors, and its pairs are the result."""
    a = table(spark, sf, "documents_author").where("author_norm is not null").select("document_id", "author_norm").distinct()
    b = a.withColumnRenamed("author_norm", "author_b")
    return a.withColumnRenamed("author_norm", "author_a").join(b, "document_id").where("author_a < author_b").groupBy("author_a", "author_b").agg(F.count("*").alias("documents"))


@R.query("reclassified_themes", """SELECT DISTINCT document_id, theme, CASE WHEN theme IN (SELECT theme FROM documents_theme WHERE parent IS NOT NULL) THEN 'sub' ELSE 'primary' END AS kind FROM documents_theme WHERE theme IS NOT NULL""")
def reclassified_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Theme rows with their kind derived anew: a theme that has a parent anywhere is a sub-theme."""
    t = table(spark, sf, "documents_theme").where("theme is not null")
    sub = t.where("parent is not null").select("theme").distinct().withColumn("kind", F.lit("sub"))
    return t.select("document_id", "theme").distinct().join(sub, "theme", "left").select("document_id", "theme", F.coalesce("kind", F.lit("primary")).alias("kind"))


@R.query("keep_listed", """SELECT chunk_id FROM (SELECT DISTINCT chunk_id, document_id FROM chunk) c WHERE NOT EXISTS (SELECT 1 FROM state_record s WHERE s.document_id = c.document_id AND s.source_type = 'manual') OR chunk_id IN (SELECT min(chunk_id) FROM chunk GROUP BY document_id)""")
def keep_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that remain when manual documents are deleted but for a keep-list, their first chunk."""
    c = table(spark, sf, "chunk").select("chunk_id", "document_id").distinct()
    gone = table(spark, sf, "state_record").where("source_type = 'manual'").select("document_id").distinct()
    keep = c.groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id")
    left = c.join(gone, "document_id", "left_anti").select("chunk_id")
    return left.unionByName(c.join(gone, "document_id", "left_semi").select("chunk_id").join(keep, "chunk_id", "left_semi"))


@R.query("rollup_shipments", "SELECT year(l_shipdate) AS y, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (year(l_shipdate), l_returnflag)")
def rollup_shipments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("y"), "l_returnflag", "l_quantity")
    return d.rollup("y", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@R.query("fuzzy_titles")
def fuzzy_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles like those of documents whose id is divisible by 50, by the longer of two matching ratios, with the band that the score falls into.

    Titles are compared where they share a word of four letters or more; without one they are unlike.
    """
    d = table(spark, sf, "documents").where("title is not null").select("doc_id", "title", N.fold(F.col("title")).alias("f"))
    asked = d.where("doc_id % 50 = 0").select(F.col("f").alias("asked")).distinct()
    s = like_texts(d.select("title", "f").distinct(), asked, "f", 0.6).select("asked", "title", "score")
    return s.withColumn("band", F.when(F.col("score") >= 0.9, "accept").otherwise("ambiguous"))
