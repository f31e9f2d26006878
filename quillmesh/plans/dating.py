"""Queries of dates: what titles and texts state, ranges, copyright statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import dates as D
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()
_lit = lambda p: "'" + p.replace("'", "''") + "'"
_MONTH_SQL = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN TRY_CAST({x} AS INTEGER) ELSE (strpos('jan feb mar apr may jun jul aug sep oct nov dec', {x}[1:3]) + 3) // 4 END"
_DAY_SQL = lambda y, m, d: f"TRY_CAST(concat_ws('-', CAST({y} AS VARCHAR), lpad(CAST({m} AS VARCHAR), 2, '0'), lpad(CAST({d} AS VARCHAR), 2, '0')) AS DATE)"


def _stated_sql(i: int) -> str:
    pattern, precision, y, m, d = D.STATED[i]
    part = lambda g: f"regexp_extract(t, {_lit(pattern)}, {g})"
    year = f"TRY_CAST({part(y)} AS INTEGER)"
    year = f"CASE WHEN {year} < 100 THEN CASE WHEN {year} <= 30 THEN 2000 + {year} WHEN {year} >= 89 THEN 1900 + {year} END ELSE {year} END"
    day = part(d) if d else "1"
    kind = "full_date" if precision == "day" else "month_year"
    value = _DAY_SQL(f"({year})", f"({_MONTH_SQL(part(m))})", day)
    return f"CASE WHEN regexp_matches(t, {_lit(pattern)}) AND {part(1)} = '' AND ({year}) BETWEEN 1989 AND 2030 AND {value} IS NOT NULL THEN {{'value': {value}, 'precision': '{precision}', 'kind': '{kind}'}} END"


_BARE_SQL = f"TRY_CAST(regexp_extract(regexp_replace(t, {_lit(f'{D._B}{D.HORIZON}{D._Y}')} || '([^a-z0-9]|$)', ' \\2', 'g'), {_lit(D.BARE)}, 1) AS INTEGER)"
_SPAN_SQL = lambda g: f"TRY_CAST(regexp_extract(t, {_lit(D.SPAN)}, {g}) AS INTEGER)"
_TITLE_SQL = "coalesce(" + ", ".join(_stated_sql(i) for i in range(len(D.STATED))) + f""",
 CASE WHEN (CASE WHEN length(regexp_extract(t, {_lit(D.SPAN)}, 2)) = 2 THEN {_SPAN_SQL(2)} = ({_SPAN_SQL(1)} + 1) % 100 ELSE {_SPAN_SQL(2)} = {_SPAN_SQL(1)} + 1 END) AND {_SPAN_SQL(1)} + 1 BETWEEN 1989 AND 2030 THEN {{'value': make_date({_SPAN_SQL(1)} + 1, 1, 1), 'precision': 'year', 'kind': 'edition'}} END,
 CASE WHEN {_BARE_SQL} BETWEEN 1989 AND 2030 THEN {{'value': make_date({_BARE_SQL}, 1, 1), 'precision': 'year', 'kind': 'bare_year'}} END)"""


@R.query("stated_dates", rf"""WITH x AS (SELECT DISTINCT source, text FROM (SELECT 'filename' AS source, filename AS text FROM pdf_evidence UNION ALL SELECT 'pdf_title', pdf_title FROM pdf_evidence UNION ALL SELECT 'anchor', anchor FROM pdf_evidence UNION ALL SELECT 'title', title FROM documents) WHERE text IS NOT NULL),
t AS (SELECT source, text, regexp_replace(lower(text), '\.(?:pdf|docx?|xlsx?|pptx?|zip)$', ' ') AS t FROM x), d AS (SELECT source, text, {_TITLE_SQL} AS d FROM t)
SELECT source, text, CAST(d.value AS VARCHAR) AS day, d.precision AS precision, d.kind AS kind FROM d WHERE d IS NOT NULL""")
def stated_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The dates that file names, titles and link texts state."""
    pdf = table(spark, sf, "pdf_evidence")
    x = pdf.select(F.inline(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in ("filename", "pdf_title", "anchor")))))
    x = x.unionByName(table(spark, sf, "documents").select(F.lit("title").alias("source"), F.col("title").alias("text"))).where("text is not null").distinct()
    return x.withColumn("d", D.title_date(F.col("text"))).where("d is not null").select("source", "text", F.col("d.value").cast("string").alias("day"), "d.precision", "d.kind")


@R.query("file_dates", rf"""WITH p AS (SELECT DISTINCT document_id, url, filename, pdf_title, anchor FROM pdf_evidence), x AS (SELECT document_id, url, unnest([{{'rank': 1, 'text': filename, 'source': 'filename'}}, {{'rank': 2, 'text': pdf_title, 'source': 'pdf_title'}}, {{'rank': 3, 'text': anchor, 'source': 'anchor'}}], recursive := true) FROM p),
t AS (SELECT *, regexp_replace(lower(coalesce(text, '')), '\.(?:pdf|docx?|xlsx?|pptx?|zip)$', ' ') AS t FROM x), d AS (SELECT *, {_TITLE_SQL} AS d FROM t)
SELECT document_id, url, min(CASE rank WHEN 1 THEN '1 filename' WHEN 2 THEN '2 pdf_title' ELSE '3 anchor' END) AS source, CAST(arg_min(d.value, (rank, d.value)) AS VARCHAR) AS day FROM d WHERE d IS NOT NULL GROUP BY 1, 2""")
def file_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The date of each PDF from the first of its names that states one: file name, title inside, link text."""
    p = table(spark, sf, "pdf_evidence").select("document_id", "url", "filename", "pdf_title", "anchor").distinct()
    x = p.select("document_id", "url", F.inline(F.array(*(F.struct(F.lit(f"{i} {c}").alias("source"), D.title_date(F.col(c)).alias("d")) for i, c in enumerate(("filename", "pdf_title", "anchor"), 1))))).where("d is not null")
    best = x.groupBy("document_id", "url").agg(F.min(F.struct("source", F.col("d.value").alias("value"))).alias("b"))
    return best.select("document_id", "url", "b.source", F.col("b.value").cast("string").alias("day"))


@R.query("checked_ranges", r"""WITH p AS (SELECT DISTINCT document_id, TRY_CAST(regexp_extract(current_start_date, '^\s*(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS s, pdf_modified AS e FROM pdf_evidence), q AS (SELECT *, TRY_CAST(regexp_extract(e, '^\s*(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS d FROM p),
i AS (SELECT *, CASE WHEN trim(coalesce(e, '')) <> '' AND d IS NULL THEN 'end_invalid' WHEN d < s THEN 'inverted' END AS issue FROM q) SELECT DISTINCT document_id, CAST(s AS VARCHAR) AS start_day, CAST(CASE WHEN issue IS NULL THEN d END AS VARCHAR) AS end_day, issue FROM i""")
def checked_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """From the stated start of each PDF to its last change, with what is wrong with the end."""
    p = table(spark, sf, "pdf_evidence").select("document_id", D.iso_date(F.col("current_start_date")).alias("s"), "pdf_modified")
    r = p.withColumn("r", D.checked_range(F.col("s"), F.col("pdf_modified")))
    return r.select("document_id", F.col("s").cast("string").alias("start_day"), F.col("r.end").cast("string").alias("end_day"), "r.issue").distinct()


@R.query("copyright_years", rf"SELECT DISTINCT document_id, year FROM (SELECT document_id, TRY_CAST(regexp_extract(lower(front_text), {_lit(D.COPYRIGHT)}, 1) AS INTEGER) AS year FROM pdf_evidence UNION ALL SELECT document_id, TRY_CAST(regexp_extract(lower(text), {_lit(D.COPYRIGHT)}, 1) AS INTEGER) FROM documents) WHERE year IS NOT NULL")
def copyright_years(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pdf_evidence").select("document_id", F.col("front_text").alias("text")).unionByName(table(spark, sf, "documents").select("document_id", "text"))
    return t.select("document_id", D.copyright_year(F.col("text")).alias("year")).where("year is not null").distinct()


_IN_TEXT_SQL = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(t, {_lit(p)}), lambda x: " + _DAY_SQL(f"regexp_extract(x, {_lit(p)}, {y})", f"({_MONTH_SQL(f'regexp_extract(x, {_lit(p)}, {m})')})", f"regexp_extract(x, {_lit(p)}, {d})") + ")" for p, y, m, d in D.IN_TEXT) + ")"


@R.query("dates_in_texts", f"WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, unnest({_IN_TEXT_SQL}) AS d FROM t) SELECT DISTINCT doc_id, CAST(d AS VARCHAR) AS day FROM d WHERE d IS NOT NULL")
def dates_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every date that a document's text names, in any of five writings."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(D.dates_in(F.col("text"))).alias("d")).select("doc_id", F.col("d").cast("string").alias("day"))


@R.query("date_claims", f"WITH p AS (SELECT DISTINCT document_id, TRY_CAST(regexp_extract(current_start_date, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) AS s, lower(head_text) AS t FROM pdf_evidence), d AS (SELECT document_id, s, list_filter({_IN_TEXT_SQL}, lambda x: x IS NOT NULL) AS d FROM p WHERE s IS NOT NULL AND t IS NOT NULL) SELECT DISTINCT document_id, CAST(s AS VARCHAR) AS day, list_contains(d, s) AS in_text FROM d")
def date_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the date that is stated of a PDF stands in its text."""
    p = table(spark, sf, "pdf_evidence").select("document_id", D.iso_date(F.col("current_start_date")).alias("s"), "head_text").where("s is not null and head_text is not null")
    return p.select("document_id", F.col("s").cast("string").alias("day"), F.array_contains(D.dates_in(F.col("head_text")), F.col("s")).alias("in_text")).distinct()


@R.query("iso_starts", r"""WITH v AS (SELECT DISTINCT v FROM (SELECT unnest([pdf_created, pdf_modified, file_created, current_start_date]) AS v FROM pdf_evidence) WHERE v IS NOT NULL), p AS (SELECT v, regexp_extract(v, '^\s*(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?\s*$', ['y', 'm', 'd']) AS p FROM v WHERE regexp_matches(v, '^\s*(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?\s*$')),
s AS (SELECT v, TRY_CAST(p.y || '-' || CASE WHEN p.m <> '' THEN p.m ELSE '01' END || '-' || CASE WHEN p.d <> '' THEN p.d ELSE '01' END AS DATE) AS s FROM p) SELECT v AS value, CAST(s AS VARCHAR) AS day, year(s) BETWEEN 1990 AND 2026 AS plausible FROM s WHERE s IS NOT NULL""")
def iso_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The first day of every value that is a year, month or day in ISO form, and whether it is plausible."""
    v = table(spark, sf, "pdf_evidence").select(F.explode(F.array("pdf_created", "pdf_modified", "file_created", "current_start_date")).alias("value")).where("value is not null").distinct()
    return v.withColumn("s", D.iso_start(F.col("value"))).where("s is not null").select("value", F.col("s").cast("string").alias("day"), D.is_plausible(F.col("s"), 2025).alias("plausible"))


@R.query("found_dates", r"""WITH x AS (SELECT document_id, unnest([{'field': 'current_start_date', 'role': 'stated', 'v': current_start_date}, {'field': 'pdf_created', 'role': 'created', 'v': pdf_created}, {'field': 'pdf_modified', 'role': 'modified', 'v': pdf_modified}, {'field': 'file_created', 'role': 'created', 'v': file_created}], recursive := true) FROM pdf_evidence)
SELECT DISTINCT document_id, field, role, CAST(TRY_CAST(regexp_extract(v, '^\s*(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS VARCHAR) AS day FROM x WHERE TRY_CAST(regexp_extract(v, '^\s*(\d{4}-\d{2}-\d{2})', 1) AS DATE) IS NOT NULL""")
def found_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of a PDF's metadata that begins with an ISO date, with its role."""
    roles = {"current_start_date": "stated", "pdf_created": "created", "pdf_modified": "modified", "file_created": "created"}
    x = table(spark, sf, "pdf_evidence").select("document_id", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(r).alias("role"), D.iso_date(F.col(c)).alias("d")) for c, r in roles.items())))).where("d is not null")
    return x.select("document_id", "field", "role", F.col("d").cast("string").alias("day")).distinct()


@R.query("subject_periods", """WITH l AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first_ship FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS s, first_ship AS e FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT o_orderkey, CAST(CASE WHEN coalesce(e < s, false) THEN NULL ELSE s END AS VARCHAR) AS start_day, CAST(CASE WHEN coalesce(e < s, false) THEN NULL ELSE e END AS VARCHAR) AS end_day FROM p""")
def subject_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The period of each order from a month after its date to its first shipment; one that is turned round is unknown."""
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("e"))
    p = table(spark, sf, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 30).alias("s")).join(e, "o_orderkey", "left")
    start, end = D.known_period(F.col("s"), F.col("e"))
    return p.select("o_orderkey", start.cast("string").alias("start_day"), end.cast("string").alias("end_day"))
