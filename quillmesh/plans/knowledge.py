"""Queries of dates, names, text statistics, entities, claims and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import dates as D
from quillmesh.functions import names as N
from quillmesh.operators import claims as Cl
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()
S = lambda c: F.col(c).cast("string").alias(c)

# --- periods: an order from its date to its last shipment

_PERIODS = """periods AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_d, l.end_d FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS end_d FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey)"""


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("end_d"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("start_d")).join(ends, "o_orderkey", "left")


@R.query("period_overlap", f"WITH {_PERIODS} SELECT o_orderkey FROM periods WHERE start_d < DATE '1998-01-01' AND coalesce(end_d, start_d) >= DATE '1997-06-01'")
def period_overlap(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = F.lit("1997-06-01").cast("date"), F.lit("1998-01-01").cast("date")
    return _periods(spark, sf).where(D.period_overlaps(F.col("start_d"), F.col("end_d"), lo, hi)).select("o_orderkey")


@R.query("period_overlap_precision", """SELECT document_id, CAST(s AS VARCHAR) AS start_d FROM (SELECT DISTINCT document_id, TRY_CAST(effective_start_date AS DATE) AS s, start_precision AS p FROM state_record)
WHERE CASE p WHEN 'year' THEN date_trunc('year', s) WHEN 'month' THEN date_trunc('month', s) ELSE s END < DATE '2019-03-15'
 AND CASE p WHEN 'year' THEN make_date(year(s), 12, 31) WHEN 'month' THEN last_day(s) ELSE s END >= DATE '2019-03-10'""")
def period_overlap_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "state_record").select("document_id", F.col("effective_start_date").try_cast("date").alias("s"), F.col("start_precision").alias("p")).distinct()
    lo, hi = F.lit("2019-03-10").cast("date"), F.lit("2019-03-15").cast("date")
    return d.where(D.period_overlaps(F.col("s"), F.lit(None).cast("date"), lo, hi, F.col("p"))).select("document_id", F.col("s").cast("string").alias("start_d"))


@R.query("temporal_fit", f"""WITH {_PERIODS} SELECT o_orderkey, CASE WHEN start_d IS NULL THEN 0.25 WHEN start_d >= DATE '1997-01-01' AND coalesce(end_d, start_d) < DATE '1997-03-01' THEN 1.0
 WHEN start_d <= DATE '1997-01-01' AND coalesce(end_d, start_d) >= DATE '1997-02-28' THEN 0.75 WHEN start_d < DATE '1997-03-01' AND coalesce(end_d, start_d) >= DATE '1997-01-01' THEN 0.5 ELSE 0.25 END::DOUBLE AS fit FROM periods""")
def temporal_fit(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = F.lit("1997-01-01").cast("date"), F.lit("1997-03-01").cast("date")
    return _periods(spark, sf).select("o_orderkey", D.temporal_fit(F.col("start_d"), F.col("end_d"), lo, hi).alias("fit"))


@R.query("upcoming_gate", f"""WITH {_PERIODS}, k AS (SELECT *, coalesce(end_d, start_d) >= DATE '1998-08-01' AS live FROM periods)
SELECT o_custkey, o_orderkey FROM k WHERE live OR o_custkey NOT IN (SELECT o_custkey FROM k WHERE live)""")
def upcoming_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Finished ones are left out unless that would leave a customer without any."""
    k = _periods(spark, sf).withColumn("live", F.coalesce("end_d", "start_d") >= F.lit("1998-08-01").cast("date"))
    some = k.groupBy("o_custkey").agg(F.max("live").alias("some"))
    return k.join(some, "o_custkey").where("live or not some").select("o_custkey", "o_orderkey")


@R.query("iso_clean", "SELECT DISTINCT document_id, CAST(TRY_CAST(regexp_extract(node_created, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE) AS VARCHAR) AS d FROM date_candidates")
def iso_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "date_candidates").select("document_id", D.iso_date(F.col("node_created")).cast("string").alias("d")).distinct()


@R.query("display_dates", """SELECT DISTINCT document_id, CASE start_precision WHEN 'year' THEN strftime(s, '%Y') WHEN 'month' THEN strftime(s, '%b %Y') ELSE strftime(s, '%-d %b %Y') END AS label
FROM (SELECT document_id, start_precision, TRY_CAST(effective_start_date AS DATE) AS s FROM state_record)""")
def display_dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "state_record").select("document_id", D.display(F.col("effective_start_date").try_cast("date"), F.col("start_precision")).alias("label")).distinct()


@R.query("years_in_texts", r"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b(\d{4})\b', 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1980 AND 2029))) AS years FROM documents WHERE text IS NOT NULL")
def years_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", D.years_in(F.col("text")).alias("years"))


@R.query("path_months", r"SELECT DISTINCT document_id, nullif(regexp_extract(url, '/(\d{4}-\d{2})/', 1), '') AS month FROM pdf_evidence")
def path_months(spark: SparkSession, sf: str) -> DataFrame:
    m = F.regexp_extract("url", r"/(\d{4}-\d{2})/", 1)
    return table(spark, sf, "pdf_evidence").select("document_id", F.when(m != "", m).alias("month")).distinct()


@R.query("title_years", r"SELECT document_id, TRY_CAST(nullif(regexp_extract(title, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS edition FROM documents WHERE title IS NOT NULL")
def title_years(spark: SparkSession, sf: str) -> DataFrame:
    y = F.regexp_extract("title", r"\b((?:19|20)\d{2})\b", 1)
    return table(spark, sf, "documents").where("title is not null").select("document_id", F.when(y != "", y).cast("int").alias("edition"))


@R.query("edition_series", r"""SELECT series, CAST(count(DISTINCT edition) AS BIGINT) AS editions, max(edition) AS latest FROM (SELECT regexp_replace(lower(title), '\s*(?:19|20)\d{2}\b', '', 'g') AS series, TRY_CAST(nullif(regexp_extract(title, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS edition
 FROM documents WHERE title IS NOT NULL) WHERE edition IS NOT NULL GROUP BY 1 HAVING count(DISTINCT edition) > 1""")
def edition_series(spark: SparkSession, sf: str) -> DataFrame:
    y = F.regexp_extract("title", r"\b((?:19|20)\d{2})\b", 1)
    d = table(spark, sf, "documents").where(y != "").select(F.regexp_replace(F.lower("title"), r"\s*(?:19|20)\d{2}\b", "").alias("series"), y.cast("int").alias("edition"))
    d = d.distinct().groupBy("series").agg(F.count("*").alias("editions"), F.max("edition").alias("latest"))
    return d.where("editions > 1")


# --- names and text

_FOLD = "trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžłø', 'aaaaaaceeeeiiiinooooouuuuyyszlo'), '[^a-z0-9]+', ' ', 'g'))"


@R.query("fold_names", f"SELECT DISTINCT author, {_FOLD.format('author')} AS folded FROM documents_author")
def fold_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_author").select("author").distinct().select("author", N.fold(F.col("author")).alias("folded"))


@R.query("name_initials", f"SELECT DISTINCT author, array_to_string(list_transform(list_filter(string_split({_FOLD.format('author')}, ' '), lambda w: w <> ''), lambda w: w[1:1]), '') AS initials FROM documents_author WHERE author IS NOT NULL")
def name_initials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_author").where("author is not null").select("author").distinct().select("author", N.initials(N.fold(F.col("author"))).alias("initials"))


@R.query("person_names", f"SELECT DISTINCT author, regexp_replace(regexp_replace({_FOLD.format('author')}, '^(?:(?:dr|prof|professor|mr|mrs|ms|miss|sir) )+([a-z]+ )', '\\1'), '^([a-z]+ [a-z].*?)(?: (?:jr|sr|phd|md|ii|iii))+$', '\\1') AS person FROM documents_author")
def person_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_author").select("author").distinct().select("author", N.person(F.col("author")).alias("person"))


@R.query("slugs", "SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE title IS NOT NULL")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("title is not null").select("doc_id", N.slug(F.col("title")).alias("slug"))


def _sound_sql(x: str) -> str:
    s = f"lower({x})"
    for a, b in (("ee", "i"), ("oo", "u"), ("ck", "k"), ("ph", "f"), ("([bcdgkpt])h", "\\1")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    for c in "abcdefgiklmnoprstuz":
        s = f"regexp_replace({s}, '{c}{c}+', '{c}', 'g')"
    return s


@R.query("sound_keys", f"SELECT n_name, {_sound_sql('n_name')} AS sound FROM nation UNION ALL SELECT r_name, {_sound_sql('r_name')} FROM region")
def sound_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name").unionByName(table(spark, sf, "region").select(F.col("r_name").alias("n_name")))
    return n.select("n_name", N.sound(F.col("n_name")).alias("sound"))


@R.query("url_keys", "SELECT DISTINCT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '[?#].*$', ''), '^www\\.', ''), '/+$', '') AS url_key FROM pdf_evidence WHERE url IS NOT NULL")
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pdf_evidence").where("url is not null").select("url").distinct().select("url", N.url_key(F.col("url")).alias("url_key"))


@R.query("title_df", f"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split({_FOLD.format('title')}, ' ')) AS word FROM documents WHERE title IS NOT NULL) WHERE word <> '' GROUP BY 1")
def title_df(spark: SparkSession, sf: str) -> DataFrame:
    return _title_words(spark, sf).groupBy("word").agg(F.count("*").alias("df"))


def _title_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.split(N.fold(F.col("title")), " "))
    return table(spark, sf, "documents").where("title is not null").select("doc_id", F.explode(words).alias("word")).where("word <> ''")


@R.query("selective_terms", f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split({_FOLD.format('title')}, ' ')) AS word FROM documents WHERE title IS NOT NULL)
SELECT word, count(*) AS df FROM w WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) <= greatest(25, 0.01 * (SELECT count(*) FROM documents WHERE title IS NOT NULL))""")
def selective_terms(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").where("title is not null").agg(F.count("*")).scalar()
    return _title_words(spark, sf).where("length(word) >= 4").groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= F.greatest(F.lit(25.0), n * 0.01))


@R.query("title_scores", f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split({_FOLD.format('title')}, ' ')) AS word FROM documents WHERE title IS NOT NULL)
SELECT doc_id, count(*) AS score FROM w WHERE word IN ('annual', 'report', 'water', 'energy', 'pilot') GROUP BY 1 HAVING count(*) >= 2""")
def title_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _title_words(spark, sf).where(F.col("word").isin("annual", "report", "water", "energy", "pilot")).groupBy("doc_id").agg(F.count("*").alias("score")).where("score >= 2")


@R.query("shingle_owners", f"""WITH t AS (SELECT document_id, list_filter(string_split({_FOLD.format('title')}, ' '), lambda w: w <> '') AS w FROM documents WHERE title IS NOT NULL),
s AS (SELECT document_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM t WHERE len(w) >= 3)
SELECT shingle, min(document_id) AS owner FROM s GROUP BY 1 HAVING count(DISTINCT document_id) = 1""")
def shingle_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of three title words that one document alone has; owners are compared by least and greatest, not gathered."""
    w = F.filter(F.split(N.fold(F.col("title")), " "), lambda x: x != "")
    t = table(spark, sf, "documents").where("title is not null").select("document_id", w.alias("w")).where(F.size("w") >= 3)
    s = t.select("document_id", F.explode(F.zip_with(F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, b: F.concat_ws(" ", a, b)), F.slice("w", 3, F.size("w") - 2), lambda a, b: F.concat_ws(" ", a, b))).alias("shingle"))
    return s.groupBy("shingle").agg(F.min("document_id").alias("owner"), F.max("document_id").alias("other")).where("owner = other").select("shingle", "owner")


@R.query("content_token_coverage", f"""WITH c AS (SELECT chunk_id, list_distinct(list_filter(string_split({_FOLD.format('section_heading')}, ' '), lambda w: length(w) >= 4)) AS h, list_distinct(list_filter(string_split({_FOLD.format('text')}, ' '), lambda w: length(w) >= 4)) AS t
 FROM (SELECT DISTINCT chunk_id, section_heading, text FROM chunk WHERE text IS NOT NULL AND section_heading IS NOT NULL))
SELECT chunk_id, round(len(list_intersect(h, t)) / len(h), 6) AS coverage FROM c WHERE len(h) > 0""")
def content_token_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "chunk").where("text is not null and section_heading is not null").select("chunk_id", "section_heading", "text").distinct()
    d = d.select("chunk_id", N.content_words(F.col("section_heading")).alias("h"), N.content_words(F.col("text")).alias("t")).where(F.size("h") > 0)
    return d.select("chunk_id", F.round(F.size(F.array_intersect("h", "t")) / F.size("h"), 6).alias("coverage"))


@R.query("classify_sections", r"""WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT chunk_id, text FROM chunk WHERE text IS NOT NULL)),
g AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '\.{4,}\s*\d+\s*$')) AS dots, count(*) FILTER (regexp_matches(line, '\((19|20)\d{2}\)')) AS refs, count(*) FILTER (regexp_matches(line, '^\s*\|')) AS rows FROM l WHERE trim(line) <> '' GROUP BY 1)
SELECT chunk_id, CASE WHEN dots >= 0.3 * n THEN 'toc' WHEN refs >= 0.3 * n THEN 'references' WHEN rows >= 0.5 * n THEN 'table' ELSE 'body' END AS kind FROM g""")
def classify_sections(spark: SparkSession, sf: str) -> DataFrame:
    """By the shares of lines with dot leaders, citations or cells; lines are counted in arrays, without a shuffle of lines."""
    d = table(spark, sf, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    count = lambda p: F.size(F.filter("lines", lambda x: x.rlike(p)))
    d = d.select("chunk_id", lines.alias("lines")).select("chunk_id", F.size("lines").alias("n"), count(r"\.{4,}\s*\d+\s*$").alias("dots"), count(r"\((19|20)\d{2}\)").alias("refs"), count(r"^\s*\|").alias("rows"))
    d = d.groupBy("chunk_id").agg(*(F.sum(c).alias(c) for c in ("n", "dots", "refs", "rows"))).where("n > 0")
    return d.select("chunk_id", F.when(F.col("dots") >= 0.3 * F.col("n"), "toc").when(F.col("refs") >= 0.3 * F.col("n"), "references").when(F.col("rows") >= 0.5 * F.col("n"), "table").otherwise("body").alias("kind"))


@R.query("acronym_glosses", r"""SELECT gloss, count(*) AS n FROM (SELECT unnest(regexp_extract_all(author, '\(([A-Z]{2,6})\)', 1)) AS gloss FROM documents_author WHERE author IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2""")
def acronym_glosses(spark: SparkSession, sf: str) -> DataFrame:
    """Acronyms in brackets after names of authors; their pairs with expansions from all texts are ``expansion_pairs``."""
    return table(spark, sf, "documents_author").where("author is not null").select(F.explode(F.regexp_extract_all("author", F.lit(r"\(([A-Z]{2,6})\)"), F.lit(1))).alias("gloss")).groupBy("gloss").agg(F.count("*").alias("n")).where("n >= 2")


@R.query("surname_frequency", f"SELECT surname, count(*) AS n FROM (SELECT DISTINCT author, string_split({_FOLD.format('author')}, ' ')[-1] AS surname FROM documents_author WHERE author IS NOT NULL) GROUP BY 1")
def surname_frequency(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents_author").where("author is not null").select("author").distinct()
    return d.select(F.element_at(F.split(N.fold(F.col("author")), " "), -1).alias("surname")).groupBy("surname").agg(F.count("*").alias("n"))


# --- entities: authors as typed, resolved to stored normal forms

_MENTIONS = f"m AS (SELECT author, {_FOLD.format('author')} AS f, count(*) AS rows FROM documents_author WHERE author IS NOT NULL GROUP BY 1, 2), e AS (SELECT DISTINCT {_FOLD.format('author_norm')} AS f, string_split({_FOLD.format('author_norm')}, ' ')[-1] AS last, {_FOLD.format('author_norm')}[1:1] AS i FROM documents_author WHERE author_norm IS NOT NULL)"
_CANDIDATES = f"""{_MENTIONS}, c AS (SELECT author, e.f AS entity, 0.6 AS score FROM m JOIN e USING (f) UNION ALL SELECT author, e.f, 0.15 FROM m JOIN e ON string_split(m.f, ' ')[-1] = e.last AND m.f[1:1] = e.i WHERE m.f <> e.f)"""


def _resolution(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents_author")
    m = a.where("author is not null").select("author").distinct().withColumn("f", N.fold(F.col("author")))
    m = m.withColumn("last", F.element_at(F.split("f", " "), -1)).withColumn("i", F.substring("f", 1, 1))
    e = a.where("author_norm is not null").select(N.fold(F.col("author_norm")).alias("entity")).distinct().withColumn("last", F.element_at(F.split("entity", " "), -1)).withColumn("i", F.substring("entity", 1, 1))
    exact = m.join(e.select(F.col("entity").alias("f"), "entity"), "f").select("author", "entity", F.lit(0.6).alias("score"))
    blocked = m.join(e, ["last", "i"]).where("f <> entity").select("author", "entity", F.lit(0.15).alias("score"))
    return exact.unionByName(blocked)


@R.query("candidates_union", f"WITH {_CANDIDATES} SELECT author, entity, CAST(score AS DOUBLE) AS score FROM c")
def candidates_union(spark: SparkSession, sf: str) -> DataFrame:
    return _resolution(spark, sf)


@R.query("resolution_tiers", f"""WITH {_CANDIDATES}, r AS (SELECT author, max(score) AS best, count(*) AS n, count(*) FILTER (score = 0.6) AS exact FROM c GROUP BY 1)
SELECT m.author, CASE WHEN r.exact = 1 THEN 'auto' WHEN r.n > 0 THEN 'ambiguous' ELSE 'unresolved' END AS tier, CAST(coalesce(r.n, 0) AS BIGINT) AS candidates FROM m LEFT JOIN r USING (author)""")
def resolution_tiers(spark: SparkSession, sf: str) -> DataFrame:
    r = _resolution(spark, sf).groupBy("author").agg(F.count("*").alias("n"), F.count(F.when(F.col("score") == 0.6, 1)).alias("exact"))
    d = table(spark, sf, "documents_author").where("author is not null").select("author").distinct().join(r, "author", "left")
    return d.select("author", F.when(F.col("exact") == 1, "auto").when(F.col("n") > 0, "ambiguous").otherwise("unresolved").alias("tier"), F.coalesce("n", F.lit(0)).alias("candidates"))


@R.query("resolution_margin", f"""WITH {_CANDIDATES} SELECT author, round(max(score) - coalesce(max(score) FILTER (rn = 2), 0), 6)::DOUBLE AS margin FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC) AS rn FROM c) GROUP BY 1""")
def resolution_margin(spark: SparkSession, sf: str) -> DataFrame:
    # the best and the runner-up from how often each score comes; no candidates of a mention are gathered
    d = _resolution(spark, sf).groupBy("author").agg(F.max("score").alias("best"), F.count(F.when(F.col("score") == 0.6, 1)).alias("hi"), F.count(F.when(F.col("score") == 0.15, 1)).alias("lo"))
    second = F.when(F.col("hi") >= 2, 0.6).when((F.col("hi") == 1) & (F.col("lo") >= 1), 0.15).when(F.col("lo") >= 2, 0.15).otherwise(0.0)
    return d.select("author", F.round(F.col("best") - second, 6).alias("margin"))


# --- claims: what priority a customer's orders had, from the order's date for 60 days

_CLAIMS = """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS subject, 'PRIORITY' AS predicate, o_orderpriority AS object, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 60 AS valid_until,
 CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS basis FROM orders)"""
_VERDICTS = f"""{_CLAIMS}, v AS (SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, CASE WHEN a.basis <> b.basis THEN 'basis' WHEN a.valid_from <> b.valid_from THEN 'later_start' ELSE 'contradiction' END AS verdict,
 CASE WHEN a.basis < b.basis THEN a.claim_id WHEN a.basis > b.basis THEN b.claim_id WHEN a.valid_from < b.valid_from THEN a.claim_id WHEN a.valid_from > b.valid_from THEN b.claim_id END AS loser
 FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND a.object <> b.object AND a.valid_from < b.valid_until AND b.valid_from < a.valid_until)"""
_STATUS = f"""{_VERDICTS}, st AS (SELECT c.claim_id, CASE WHEN EXISTS (SELECT 1 FROM v WHERE loser IS NULL AND c.claim_id IN (claim_a, claim_b)) THEN 'disputed' WHEN EXISTS (SELECT 1 FROM v WHERE loser = c.claim_id) THEN 'superseded' ELSE 'active' END AS status FROM claims c)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("subject"), F.lit("PRIORITY").alias("predicate"), F.col("o_orderpriority").alias("object"), start.alias("valid_from"), F.date_add(start, 60).alias("valid_until"),
                    F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("basis"))


@R.query("claim_conflicts", f"WITH {_VERDICTS} SELECT * FROM v")
def claim_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return Cl.conflicts(_claims(spark, sf))


@R.query("claim_status", f"WITH {_STATUS} SELECT status, count(*) AS n FROM st GROUP BY 1")
def claim_status(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf)
    return Cl.statuses(c, Cl.conflicts(c)).groupBy("status").agg(F.count("*").alias("n"))


@R.query("current_state", f"WITH {_STATUS} SELECT c.claim_id, c.subject, c.object FROM claims c JOIN st USING (claim_id) WHERE status = 'active' AND valid_from <= DATE '1997-06-15' AND valid_until > DATE '1997-06-15'")
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf)
    return Cl.current_state(c, Cl.statuses(c, Cl.conflicts(c)), "1997-06-15").select("claim_id", "subject", "object")


@R.query("as_of_claims", f"WITH {_CLAIMS} SELECT claim_id, subject, object FROM claims WHERE valid_from <= DATE '1997-06-15' AND valid_until > DATE '1997-06-15'")
def as_of_claims(spark: SparkSession, sf: str) -> DataFrame:
    return Cl.as_of(_claims(spark, sf), "1997-06-15").select("claim_id", "subject", "object")


@R.query("supersession_pairs", f"WITH {_VERDICTS} SELECT CASE WHEN loser = claim_a THEN claim_b ELSE claim_a END AS newer, loser AS older FROM v WHERE verdict = 'later_start'")
def supersession_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = Cl.conflicts(_claims(spark, sf)).where("verdict = 'later_start'")
    return v.select(F.when(F.col("loser") == F.col("claim_a"), F.col("claim_b")).otherwise(F.col("claim_a")).alias("newer"), F.col("loser").alias("older"))


# --- relationships: nation - customer - order - supplier

@R.query("one_hop", "SELECT n.n_name, c.c_custkey FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(n, "c_nationkey").select("n_name", "c_custkey")


@R.query("two_hop", """SELECT n.n_name, o.o_orderstatus, count(*) AS orders, count(DISTINCT c.c_custkey) AS customers FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    # orders are summed up per customer before anything else is joined
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.count("*").alias("k"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    d = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey").join(n, "c_nationkey")
    return d.groupBy("n_name", "o_orderstatus").agg(F.sum("k").alias("orders"), F.count("*").alias("customers"))


@R.query("two_hop_claims", f"""WITH {_CLAIMS}, ships AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS subject, l_suppkey AS object, CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) + 30 AS valid_until FROM lineitem)
SELECT c.subject AS customer, s.object AS supplier, count(*) AS paths FROM (SELECT claim_id, subject, claim_id AS object, valid_from, valid_until FROM claims) c JOIN ships s ON s.subject = c.object AND c.valid_from < s.valid_until AND s.valid_from < c.valid_until GROUP BY 1, 2""")
def two_hop_claims(spark: SparkSession, sf: str) -> DataFrame:
    first = _claims(spark, sf).withColumn("object", F.col("claim_id"))
    ship = F.col("l_shipdate").cast("date")
    second = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("subject"), F.col("l_suppkey").alias("object"), ship.alias("valid_from"), F.date_add(ship, 30).alias("valid_until"))
    return Cl.two_hop(first, second).groupBy(F.col("subject").alias("customer"), F.col("object").alias("supplier")).agg(F.count("*").alias("paths"))


@R.query("timeline", """SELECT o_custkey, CAST(d AS VARCHAR) AS day, kind, n FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, 'ordered' AS kind, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL
 SELECT o_custkey, CAST(l_shipdate AS DATE), 'shipped', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    made = o.select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.lit("ordered").alias("kind"))
    shipped = o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), "l_orderkey").select("o_custkey", F.col("l_shipdate").cast("date").alias("d"), F.lit("shipped").alias("kind"))
    return made.unionByName(shipped).groupBy("o_custkey", F.col("d").cast("string").alias("day"), "kind").agg(F.count("*").alias("n"))


@R.query("events_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events with less than six hours between, by session windows."""
    e = table(spark, sf, "events").where("user_id is not null and ts is not null")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    return s.select("user_id", "started", "n")
