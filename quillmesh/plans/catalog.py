"""Queries of the catalog: counts, listings, breakdowns, vocabularies, facets, change detection and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import catalog as C
from quillmesh.operators import changes as K
from quillmesh.operators.differences import uuid_key
from quillmesh.operators.ranking import nearest_rank
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()


def _catalog(spark: SparkSession, sf: str) -> C.Catalog:
    docs = table(spark, sf, "documents").withColumnRenamed("source", "bundle")
    return C.Catalog(docs, table(spark, sf, "documents_author"), table(spark, sf, "documents_theme"))


# a scope for the queries below: website documents of some years, by theme group
_SCOPE = C.Scope(source_type="website", effective_from="2015-01-01", effective_to="2022-01-01", theme_group="main")
_SCOPED = """SELECT d.* FROM documents d WHERE d.source_type = 'website' AND d.effective_start_date >= DATE '2015-01-01' AND d.effective_start_date < DATE '2022-01-01'
  AND EXISTS (SELECT 1 FROM documents_theme t WHERE t.document_id = d.document_id AND t.theme_group = 'main')"""
_AUTHOR = "coalesce(a.author_norm, a.author)"


@R.query("count_docs_scope", f"SELECT count(*) AS documents FROM ({_SCOPED})")
def count_docs_scope(spark: SparkSession, sf: str) -> DataFrame:
    return C.count_documents(_catalog(spark, sf), _SCOPE)


@R.query("count_docs_by_author", "SELECT count(*) AS documents FROM documents d WHERE EXISTS (SELECT 1 FROM documents_author a WHERE a.document_id = d.document_id AND lower(coalesce(a.author_norm, a.author)) = 'institute editorial desk')")
def count_docs_by_author(spark: SparkSession, sf: str) -> DataFrame:
    return C.count_documents(_catalog(spark, sf), C.Scope(author="Institute Editorial Desk"))


@R.query("list_docs_paged", """SELECT document_id, title, source AS bundle, CAST(effective_start_date AS VARCHAR) AS effective_start_date, 0 AS matched FROM documents
WHERE source_type = 'website' AND lower(title) LIKE '%report%' ORDER BY documents.effective_start_date DESC NULLS LAST, document_id LIMIT 20 OFFSET 20""")
def list_docs_paged(spark: SparkSession, sf: str) -> DataFrame:
    return C.list_documents(_catalog(spark, sf), C.Scope(source_type="website", title_contains="Report"), limit=20, offset=20).withColumn("effective_start_date", F.col("effective_start_date").cast("string"))


@R.query("list_docs_topic_order", """SELECT document_id, title, source AS bundle, CAST(effective_start_date AS VARCHAR) AS effective_start_date, matched FROM (
  SELECT *, CAST(coalesce(title ILIKE '%water%', false) AS INT) + CAST(coalesce(title ILIKE '%energy%', false) AS INT) + CAST(coalesce(title ILIKE '%pilot%', false) AS INT) AS matched FROM documents) x
WHERE matched > 0 ORDER BY matched DESC, x.effective_start_date DESC NULLS LAST, document_id LIMIT 50""")
def list_docs_topic_order(spark: SparkSession, sf: str) -> DataFrame:
    return C.list_documents(_catalog(spark, sf), C.Scope(topic_terms=("water", "energy", "pilot")), limit=50).withColumn("effective_start_date", F.col("effective_start_date").cast("string"))


@R.query("distribution_by_bundle", f"SELECT source AS key, count(*) AS documents FROM ({_SCOPED}) WHERE source IS NOT NULL GROUP BY 1")
def distribution_by_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution(_catalog(spark, sf), _SCOPE, "bundle")


@R.query("distribution_by_year", "SELECT CAST(year(effective_start_date) AS VARCHAR) AS key, count(DISTINCT document_id) AS documents FROM documents WHERE effective_start_date IS NOT NULL GROUP BY 1")
def distribution_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution(_catalog(spark, sf), C.Scope(), "year")


@R.query("distribution_by_author_key", f"""SELECT key, documents FROM (SELECT {_AUTHOR} AS key, count(DISTINCT a.document_id) AS documents
FROM documents_author a JOIN ({_SCOPED}) d USING (document_id) GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20) WHERE key IS NOT NULL""")
def distribution_by_author_key(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution(_catalog(spark, sf), _SCOPE, "author", limit=20)


@R.query("distribution_by_theme", f"SELECT t.theme AS key, count(DISTINCT t.document_id) AS documents FROM documents_theme t JOIN ({_SCOPED}) d USING (document_id) WHERE t.theme IS NOT NULL GROUP BY 1")
def distribution_by_theme(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution(_catalog(spark, sf), _SCOPE, "theme")


@R.query("cross_distribution", """SELECT d.source AS key_a, t.theme AS key_b, count(DISTINCT d.document_id) AS documents FROM documents d JOIN documents_theme t USING (document_id)
WHERE d.source IS NOT NULL AND t.theme IS NOT NULL GROUP BY 1, 2""")
def cross_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return C.cross_distribution(_catalog(spark, sf), C.Scope(), "bundle", "theme")


@R.query("cross_distribution_top", """SELECT * FROM (SELECT d.source AS key_a, CAST(year(d.effective_start_date) AS VARCHAR) AS key_b, count(DISTINCT d.document_id) AS documents FROM documents d
GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 50) WHERE key_a IS NOT NULL AND key_b IS NOT NULL""")
def cross_distribution_top(spark: SparkSession, sf: str) -> DataFrame:
    return C.cross_distribution(_catalog(spark, sf), C.Scope(), "bundle", "year", limit=50)


@R.query("count_distinct_values", f"SELECT count(DISTINCT {_AUTHOR}) AS n_values FROM documents_author a JOIN ({_SCOPED}) d USING (document_id)")
def count_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.count_distinct_values(_catalog(spark, sf), _SCOPE, "author")


@R.query("vocabulary_best_variant", """SELECT theme, theme_group, theme_type, parent, theme_path, depth, documents FROM (
  SELECT *, row_number() OVER (PARTITION BY theme ORDER BY documents DESC, theme_group DESC NULLS LAST, theme_type DESC NULLS LAST, parent DESC NULLS LAST, theme_path DESC NULLS LAST, depth DESC NULLS LAST) AS r
  FROM (SELECT theme, theme_group, theme_type, parent, theme_path, depth, count(DISTINCT document_id) AS documents FROM documents_theme WHERE theme IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def vocabulary_best_variant(spark: SparkSession, sf: str) -> DataFrame:
    return C.best_variants(table(spark, sf, "documents_theme"))


@R.query("corpus_revision", "SELECT max(indexed_at) AS last_indexed, count(*) AS documents FROM documents")
def corpus_revision(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.max("indexed_at").alias("last_indexed"), F.count("*").alias("documents"))


@R.query("effective_date_range", "SELECT CAST(min(effective_start_date) AS VARCHAR) AS first_date, CAST(max(effective_start_date) AS VARCHAR) AS last_date FROM documents")
def effective_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.min("effective_start_date").cast("string").alias("first_date"), F.max("effective_start_date").cast("string").alias("last_date"))


@R.query("available_bundles", "SELECT DISTINCT source AS bundle FROM documents WHERE source_type = 'website' AND source IS NOT NULL ORDER BY 1")
def available_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source_type = 'website' and source is not null").select(F.col("source").alias("bundle")).distinct().orderBy("bundle")


@R.query("distinct_authors", "SELECT DISTINCT author FROM documents_author WHERE author IS NOT NULL ORDER BY 1 LIMIT 500")
def distinct_authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_author").where("author is not null").select("author").distinct().orderBy("author").limit(500)


@R.query("facets_for", """SELECT d.document_id, coalesce((SELECT list_sort(list(DISTINCT author)) FROM documents_author a WHERE a.document_id = d.document_id), []) AS authors,
 coalesce((SELECT list_sort(list(DISTINCT theme)) FROM documents_theme t WHERE t.document_id = d.document_id AND theme_type = 'primary'), []) AS themes FROM (SELECT DISTINCT document_id FROM documents) d""")
def facets_for(spark: SparkSession, sf: str) -> DataFrame:
    return C.facet_lists(_catalog(spark, sf), table(spark, sf, "documents"))


@R.query("attachments_for", "SELECT DISTINCT d.document_id, p.origin, p.url, p.filename FROM documents d JOIN pdf_evidence p USING (document_id)")
def attachments_for(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("document_id").join(table(spark, sf, "pdf_evidence").select("document_id", "origin", "url", "filename"), "document_id").distinct()


@R.query("theme_members_capped", """SELECT document_id, CAST(effective_start_date AS VARCHAR) AS effective_start_date FROM documents d WHERE EXISTS (SELECT 1 FROM documents_theme t WHERE t.document_id = d.document_id AND lower(t.theme) = 'clean power')
ORDER BY d.effective_start_date DESC NULLS LAST, document_id LIMIT 100""")
def theme_members_capped(spark: SparkSession, sf: str) -> DataFrame:
    d = C.in_scope(_catalog(spark, sf), C.Scope(theme="Clean Power"))
    return d.select("document_id", "effective_start_date").orderBy(F.col("effective_start_date").desc_nulls_last(), "document_id").limit(100).withColumn("effective_start_date", F.col("effective_start_date").cast("string"))


@R.query("orphaned", "SELECT DISTINCT c.document_id FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM documents_author a WHERE a.document_id = c.document_id)")
def orphaned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk").select("document_id").distinct().join(table(spark, sf, "documents_author").select("document_id"), "document_id", "left_anti")


@R.query("linked_articles", "SELECT d.document_id, p.document_id AS article_id, p.title AS article_title FROM documents d LEFT JOIN documents p ON p.document_id = d.linked_article_uuid WHERE d.linked_article_uuid IS NOT NULL")
def linked_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.where("linked_article_uuid is not null").select("document_id", F.col("linked_article_uuid").alias("to")).join(
        docs.select(F.col("document_id").alias("to"), F.col("document_id").alias("article_id"), F.col("title").alias("article_title")), "to", "left").drop("to")


@R.query("latest_event_per_user", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_by(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@R.query("stranded_users", """WITH l AS (SELECT user_id, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT l.user_id, l.last_error FROM l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.user_id AND e.event_type = 'purchase' AND e.ts > l.last_error)""")
def stranded_users(spark: SparkSession, sf: str) -> DataFrame:
    # both times in one aggregation instead of a join of the events with themselves
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    d = table(spark, sf, "events").groupBy("user_id").agg(at("error").alias("last_error"), at("purchase").alias("__purchase"))
    return d.where("last_error is not null and (__purchase is null or __purchase <= last_error)").select("user_id", "last_error")


@R.query("pending_runs", """SELECT o.o_orderkey, o.o_orderdate FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS st, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
WHERE l.l_orderkey IS NULL OR (l.st = 'O' AND l.n < 3)""")
def pending_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("st"), F.count("*").alias("n"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(runs, "o_orderkey", "left").where("st is null or (st = 'O' and n < 3)").select("o_orderkey", "o_orderdate")


@R.query("retry_floors", "SELECT event_type, min(ts) AS floor_ts, count(*) AS n_events FROM events GROUP BY 1")
def retry_floors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("floor_ts"), F.count("*").alias("n_events"))


@R.query("counts_by_type", "SELECT source_type, entity_type, count(*) AS n_rows FROM state_record GROUP BY 1, 2")
def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "state_record").groupBy("source_type", "entity_type").agg(F.count("*").alias("n_rows"))


@R.query("version_census", """SELECT bundle, count(*) AS stale_rows, min(changed_mark) AS first_mark, CAST(sum(CASE WHEN changed_mark IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmarked
FROM state_record WHERE pipeline_version IS NULL OR pipeline_version <> '5.0.0' GROUP BY 1""")
def version_census(spark: SparkSession, sf: str) -> DataFrame:
    stale = table(spark, sf, "state_record").where("pipeline_version is null or pipeline_version <> '5.0.0'")
    return stale.groupBy("bundle").agg(F.count("*").alias("stale_rows"), F.min("changed_mark").alias("first_mark"), F.sum(F.col("changed_mark").isNull().cast("long")).alias("unmarked"))


@R.query("ambiguous_aliases", """SELECT lower(theme) AS alias, count(DISTINCT parent) AS meanings FROM documents_theme WHERE parent IS NOT NULL GROUP BY 1 HAVING count(DISTINCT parent) > 1""")
def ambiguous_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_theme").where("parent is not null").groupBy(F.lower("theme").alias("alias")).agg(F.countDistinct("parent").alias("meanings")).where("meanings > 1")


_LATEST = """(SELECT document_id, arg_max({{'h': nullif(content_hash, ''), 'v': pipeline_version, 'b': bundle}}, (indexed_at, coalesce(content_hash, ''), coalesce(pipeline_version, ''), coalesce(bundle, ''))) AS r
 FROM (SELECT lower(CASE WHEN length(replace(trim(document_id), '-', '')) = 32 THEN regexp_replace(replace(trim(document_id), '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') ELSE document_id END) AS document_id, indexed_at, content_hash, pipeline_version, bundle FROM {0}) GROUP BY 1)"""
_DIFF = f"""SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.r.b, b.r.b) AS bundle,
 CASE WHEN a.document_id IS NULL THEN 'NEW' WHEN b.document_id IS NULL THEN 'DELETED' WHEN a.r.h IS NOT DISTINCT FROM b.r.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
 a.document_id IS NOT NULL AND a.r.v IS DISTINCT FROM '5.0.0' AS stale
 FROM {_LATEST.format('state_record')} a FULL JOIN {_LATEST.format('state_replica')} b ON a.document_id = b.document_id"""


def _snapshot(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = table(spark, sf, name).select(uuid_key(F.col("document_id")).alias("document_id"), "indexed_at", *(F.coalesce(c, F.lit("")).alias(f"o_{c}") for c in ("content_hash", "pipeline_version", "bundle")), "content_hash", "pipeline_version", "bundle")
    last = K.latest_by(rows, "document_id", ["indexed_at", "o_content_hash", "o_pipeline_version", "o_bundle"])
    return last.select("document_id", F.nullif("content_hash", F.lit("")).alias("content_hash"), "pipeline_version", "bundle")


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshot(spark, sf, "state_record"), _snapshot(spark, sf, "state_replica")
    d = K.snapshot_diff(a, b, "document_id", "content_hash", "pipeline_version", "5.0.0")
    named = a.select("document_id", F.col("bundle").alias("ba")).join(b.select("document_id", F.col("bundle").alias("bb")), "document_id", "full")
    return d.join(named, "document_id").select("document_id", F.coalesce("ba", "bb").alias("bundle"), "status", "stale")


@R.query("snapshot_diff", _DIFF)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@R.query("deletions_plausible", f"""SELECT bundle, count(*) FILTER (status <> 'NEW') AS known, count(*) FILTER (status = 'DELETED') AS missing,
 count(*) FILTER (status = 'DELETED') <= 5 OR count(*) FILTER (status = 'DELETED') <= count(*) FILTER (status <> 'NEW') * 0.1 AS plausible FROM ({_DIFF}) GROUP BY 1""")
def deletions_plausible(spark: SparkSession, sf: str) -> DataFrame:
    return K.plausible_deletions(_diff(spark, sf), "bundle", 0.1, 5)


@R.query("upsert_state", """WITH o AS (SELECT document_id, max(title) AS title, max(bundle) AS bundle, max(effective_start_date) AS effective_start_date FROM state_record GROUP BY 1),
 n AS (SELECT document_id, max(title) AS title, max(source) AS bundle, CAST(max(effective_start_date) AS VARCHAR) AS effective_start_date FROM documents GROUP BY 1)
SELECT coalesce(o.document_id, n.document_id) AS document_id, CASE WHEN o.document_id IS NULL THEN n.title WHEN n.document_id IS NULL THEN o.title ELSE coalesce(o.title, n.title) END AS title,
 CASE WHEN n.document_id IS NULL THEN o.bundle ELSE n.bundle END AS bundle,
 CASE WHEN o.document_id IS NULL THEN n.effective_start_date WHEN n.document_id IS NULL THEN o.effective_start_date ELSE coalesce(n.effective_start_date, o.effective_start_date) END AS effective_start_date
FROM o FULL JOIN n ON o.document_id = n.document_id""")
def upsert_state(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "state_record").groupBy("document_id").agg(*(F.max(c).alias(c) for c in ("title", "bundle", "effective_start_date")))
    new = table(spark, sf, "documents").groupBy("document_id").agg(F.max("title").alias("title"), F.max("source").alias("bundle"), F.max("effective_start_date").cast("string").alias("effective_start_date"))
    return K.merge_rows(old, new, "document_id", {"title": "keep", "bundle": "overwrite", "effective_start_date": "fill"})


@R.query("replace_authors", """SELECT document_id, author FROM documents_author WHERE document_id NOT IN (SELECT document_id FROM state_record)
UNION ALL SELECT DISTINCT document_id, source_type AS author FROM state_record WHERE source_type IS NOT NULL""")
def replace_authors(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "state_record").where("source_type is not null")
    return K.replace_facet(table(spark, sf, "documents_author").select("document_id", "author"), state.select("document_id", F.col("source_type").alias("author")), table(spark, sf, "state_record"), "document_id")


@R.query("rename_theme_facet", """SELECT DISTINCT document_id, CASE WHEN theme = 'Storage Systems' THEN 'Energy Storage' ELSE theme END AS theme FROM documents_theme""")
def rename_theme_facet(spark: SparkSession, sf: str) -> DataFrame:
    return K.rename_value(table(spark, sf, "documents_theme").select("document_id", "theme"), "theme", "Storage Systems", "Energy Storage")


@R.query("prune_log", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def prune_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts")
    return e.where(F.col("ts") >= e.agg(F.max("ts") - F.expr("interval 7 days")).scalar())


@R.query("failure_attempts", """WITH o AS (SELECT user_id, max(event_type) AS fp, count(*) AS attempts, min(ts) AS first_seen FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type IN ('error', 'view') GROUP BY 1),
 n AS (SELECT user_id, arg_max(event_type, ts) AS fp, count(*) AS k, min(ts) AS mn FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IN ('error', 'view') GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.k IS NULL THEN o.fp ELSE n.fp END AS fp,
 CASE WHEN n.k IS NULL THEN o.attempts WHEN o.fp IS NOT DISTINCT FROM n.fp THEN coalesce(o.attempts, 0) + n.k ELSE n.k END AS attempts,
 CASE WHEN n.k IS NULL OR o.fp IS NOT DISTINCT FROM n.fp THEN coalesce(o.first_seen, n.mn) ELSE n.mn END AS first_seen FROM o FULL JOIN n ON o.user_id = n.user_id""")
def failure_attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type in ('error', 'view')")
    old = e.where("ts < timestamp_ntz'2024-01-15 00:00:00'").groupBy("user_id").agg(F.max("event_type").alias("fp"), F.count("*").alias("attempts"), F.min("ts").alias("first_seen"))
    return K.attempts(old, e.where("ts >= timestamp_ntz'2024-01-15 00:00:00'").withColumnRenamed("event_type", "fp"), "user_id", "fp", "ts")


@R.query("reconcile_checks", """
SELECT 'chunks_without_document' AS check_name, count(*) AS offenders FROM (SELECT DISTINCT document_id FROM chunk WHERE document_id NOT IN (SELECT document_id FROM documents))
UNION ALL SELECT 'documents_without_chunks', count(*) FROM (SELECT DISTINCT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM chunk WHERE document_id IS NOT NULL))
UNION ALL SELECT 'themes_without_document', count(*) FROM (SELECT DISTINCT document_id FROM documents_theme WHERE document_id NOT IN (SELECT document_id FROM documents))
UNION ALL SELECT 'dangling_links', count(*) FROM (SELECT DISTINCT document_id FROM documents d WHERE linked_article_uuid IS NOT NULL AND linked_article_uuid NOT IN (SELECT document_id FROM documents))
UNION ALL SELECT 'state_without_document', count(*) FROM (SELECT DISTINCT document_id FROM state_record WHERE document_id NOT IN (SELECT document_id FROM documents))
UNION ALL SELECT 'reversed_pages', count(DISTINCT chunk_id) FROM chunk WHERE page_range.page_start > page_range.page_end""")
def reconcile_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    ids = t("documents").select("document_id")
    def missing(name: str, rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.join(other, list(set(rows.columns) & set(other.columns)), "left_anti").select("document_id").distinct().agg(F.count("*").alias("offenders")).select(F.lit(name).alias("check_name"), "offenders")
    links = t("documents").where("linked_article_uuid is not null").select("document_id", "linked_article_uuid")
    out = missing("chunks_without_document", t("chunk").select("document_id").where("document_id is not null"), ids)
    for name, rows, other in (
        ("documents_without_chunks", ids, t("chunk").select("document_id")), ("themes_without_document", t("documents_theme").select("document_id"), ids),
        ("dangling_links", links, ids.withColumnRenamed("document_id", "linked_article_uuid")), ("state_without_document", t("state_record").select("document_id"), ids)):
        out = out.unionByName(missing(name, rows, other))
    pages = t("chunk").where("page_range.page_start > page_range.page_end").agg(F.countDistinct("chunk_id").alias("offenders")).select(F.lit("reversed_pages").alias("check_name"), "offenders")
    return out.unionByName(pages)


@R.query("stage_latency", """SELECT event_type AS stage, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
 round(list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INT) + 1], 6) AS p50, round(list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1], 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY 1""")
def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles, found bucket by bucket."""
    e = table(spark, sf, "events").where("value is not null").withColumnRenamed("event_type", "stage")
    totals = e.groupBy("stage").agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
    ranks = nearest_rank(e, "stage", "value", [0.5, 0.95])
    return totals.join(ranks, "stage").select("stage", "n", "total", "mean", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"), "most")


@R.query("event_share", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY 1")
def event_share(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(100.0 * F.col("n") / e.agg(F.count("*")).scalar(), 4))


@R.query("props_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@R.query("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
