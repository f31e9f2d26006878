"""Queries of what processing keeps: mentions, links, decisions, reports, statuses, checks; and details of catalog answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import names as N
from quillmesh.functions import questions as Q
from quillmesh.operators import records as Rec
from quillmesh.operators import ranking as K
from quillmesh.plans.knowledge import _FOLD
from quillmesh.plans.questions import _content_sql
from quillmesh.plans.registry import Registry
from quillmesh.plans.retrieval import _CAND, _candidates
from quillmesh.session import table

R = Registry()


@R.query("clipped_log", "SELECT event_id, user_id, event_type[1:4] AS event_type, props[1:8] AS props FROM events")
def clipped_log(spark: SparkSession, sf: str) -> DataFrame:
    return Rec.clipped(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props"), {"event_type": 4, "props": 8})


@R.query("saved_mentions", """WITH s AS (SELECT document_id, theme AS surface, min(depth) AS place FROM documents_theme WHERE theme_type = 'primary' GROUP BY 1, 2), b AS (SELECT document_id, theme AS surface, min(depth) AS place FROM documents_theme GROUP BY 1, 2)
SELECT * FROM s UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_id IS NOT DISTINCT FROM b.document_id AND s.surface IS NOT DISTINCT FROM b.surface)""")
def saved_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of themes: the primary ones are stored, then all come as a batch."""
    t = table(spark, sf, "documents_theme")
    stored = t.where("theme_type = 'primary'").groupBy("document_id", F.col("theme").alias("surface")).agg(F.min("depth").alias("place"))
    return Rec.insert_new(stored, t.select("document_id", F.col("theme").alias("surface"), F.col("depth").alias("place")), ["document_id", "surface"])


@R.query("saved_links", """SELECT DISTINCT document_id AS from_id, linked_article_uuid AS to_id, 'attached' AS kind FROM documents WHERE linked_article_uuid IS NOT NULL""")
def saved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of documents, written twice and kept once."""
    rows = table(spark, sf, "documents").where("linked_article_uuid is not null").select(F.col("document_id").alias("from_id"), F.col("linked_article_uuid").alias("to_id"), F.lit("attached").alias("kind"))
    once = Rec.insert_new(rows.limit(0), rows, ["from_id", "to_id", "kind"])
    return Rec.insert_new(once, rows, ["from_id", "to_id", "kind"])


@R.query("saved_decisions", f"""WITH a AS (SELECT author, {_FOLD.format('author_norm')} AS entity, count(*) AS n FROM documents_author WHERE author IS NOT NULL AND author_norm IS NOT NULL GROUP BY 1, 2)
SELECT author, array_to_string(list_sort(list(entity || ':' || n)), ',') AS candidates, count(*) AS options FROM a GROUP BY 1""")
def saved_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """For each author as typed the stored forms that were considered, with how often each was taken."""
    a = table(spark, sf, "documents_author").where("author is not null and author_norm is not null").groupBy("author", N.fold(F.col("author_norm")).alias("entity")).agg(F.count("*").alias("n"))
    # an author as typed has few stored forms
    return a.groupBy("author").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "entity", F.col("n").cast("string")))), ",").alias("candidates"), F.count("*").alias("options"))


@R.query("earliest_marks", "SELECT document_id, min(changed_mark) AS changed_mark FROM state_record GROUP BY 1")
def earliest_marks(spark: SparkSession, sf: str) -> DataFrame:
    return Rec.first_marks(table(spark, sf, "state_record"), "document_id", "changed_mark")


@R.query("capped_run", """WITH t AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events WHERE event_type = 'error') SELECT event_id, user_id, CAST(turn AS INTEGER) AS turn FROM t WHERE turn <= 3 ORDER BY ts, event_id, user_id LIMIT 200""")
def capped_run(spark: SparkSession, sf: str) -> DataFrame:
    """What one run may take up: three errors of each user, 200 in all, the earliest."""
    return Rec.within_caps(table(spark, sf, "events").where("event_type = 'error'"), "user_id", ["ts", "event_id"], 3, 200).select("event_id", "user_id", "turn")


@R.query("spread_ranking", "WITH t AS (SELECT item_id, category, row_number() OVER (PARTITION BY category ORDER BY item_id) AS round FROM eval_items) SELECT item_id, category, CAST(round AS INTEGER) AS round, row_number() OVER (ORDER BY round, item_id) AS position FROM t")
def spread_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Items in an order in which every category comes before any comes again; as many items as an evaluation has."""
    d = Rec.spread(table(spark, sf, "eval_items").select("item_id", "category"), "category", ["item_id"])
    return d.withColumn("position", F.row_number().over(Window.orderBy("round", "item_id")).cast("long"))


@R.query("run_statuses", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 95) THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' WHEN bool_and(event_type = 'view') THEN 'skipped' ELSE 'ok' END AS status FROM events GROUP BY 1")
def run_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as the stages of a run."""
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("outcome"), ((F.col("event_type") == "error") & (F.col("value") > 95)).alias("fatal"))
    return Rec.run_status(e, "user_id")


@R.query("run_reports", "SELECT user_id, count(*) AS events, min(ts) AS started, max(ts) AS ended, count(*) FILTER (event_type = 'error') AS errors, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1")
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One report a run, with its counters."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


_LATEST = lambda t: f"SELECT document_id, arg_max(content_hash, (indexed_at, coalesce(content_hash, ''))) AS h FROM {t} WHERE document_id IS NOT NULL GROUP BY 1"


@R.query("change_statuses", """WITH a AS (SELECT document_id, max(struct_pack(t := indexed_at, h := nullif(content_hash, ''))).h AS h FROM state_replica WHERE document_id IS NOT NULL GROUP BY 1), b AS (SELECT document_id, max(struct_pack(t := indexed_at, h := nullif(content_hash, ''))).h AS h FROM state_record WHERE document_id IS NOT NULL GROUP BY 1)
SELECT document_id, CASE WHEN a.h IS NULL AND b.h IS NULL THEN NULL WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (document_id)""")
def change_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """What the catalog's copy has changed against the replica, by the latest fingerprints as stored."""
    last = lambda t, name: table(spark, sf, t).where("document_id is not null").groupBy("document_id").agg(F.max(F.struct("indexed_at", F.nullif("content_hash", F.lit("")).alias("h"))).alias("m")).select("document_id", F.col("m.h").alias(name))
    return last("state_replica", "a").join(last("state_record", "b"), "document_id", "full").select("document_id", Rec.change_status(F.col("a"), F.col("b")).alias("status"))


@R.query("context_conflicts", f"""WITH {_CAND}, d AS (SELECT doc_id, document_id, source_type, linked_article_uuid AS linked FROM documents), b AS (SELECT query_id, rank AS n, d.* FROM cand JOIN d ON d.doc_id = cand.id WHERE rank <= 20)
SELECT x.query_id, x.n AS a, y.n AS b FROM b x JOIN b y ON x.query_id = y.query_id AND x.n < y.n WHERE coalesce(x.linked = y.document_id OR y.linked = x.document_id OR x.linked = y.linked, false) AND x.document_id <> y.document_id
 AND NOT coalesce((x.source_type = 'pdf_attachment' AND x.linked = y.document_id) OR (y.source_type = 'pdf_attachment' AND y.linked = x.document_id), false)""")
def context_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a context that speak for linked documents."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "document_id", "source_type", F.col("linked_article_uuid").alias("linked"))
    b = _candidates(spark, sf).where("rank <= 20").select("query_id", "id", F.col("rank").cast("long").alias("n")).join(d, "id")
    return Rec.flag_conflicts(b.drop("id"), "query_id")


@R.query("supplements", """WITH d AS (SELECT DISTINCT document_id, source_type, linked_article_uuid AS linked FROM documents), p AS (SELECT document_id FROM d WHERE source_type = 'website'), r AS (SELECT DISTINCT linked FROM d WHERE source_type = 'manual')
SELECT p.document_id AS page, a.document_id AS attachment FROM p JOIN d a ON a.linked = p.document_id AND a.source_type = 'pdf_attachment' WHERE p.document_id NOT IN (SELECT linked FROM r WHERE linked IS NOT NULL)""")
def supplements(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments of pages that no other document stands for yet."""
    d = table(spark, sf, "documents").select("document_id", "source_type", F.col("linked_article_uuid").alias("linked")).distinct()
    pages = d.where("source_type = 'website'").select(F.col("document_id").alias("page")).distinct()
    there = d.where("source_type = 'manual' and linked is not null").select(F.col("linked").alias("page")).distinct()
    return d.where("source_type = 'pdf_attachment'").select(F.col("linked").alias("page"), F.col("document_id").alias("attachment")).join(pages.join(there, "page", "left_anti"), "page")


@R.query("merged_evidence", f"""WITH {_CAND}, g AS (SELECT query_id, id, CASE WHEN id % 3 = 0 THEN 'fact' ELSE 'passage' END AS kind, rank FROM cand), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS k FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'fact' AND k <= 6 THEN 0 WHEN kind = 'passage' AND k <= 2 THEN 1 WHEN kind = 'fact' THEN 2 ELSE 3 END, k) AS position FROM n) SELECT query_id, id, kind, CAST(position AS INTEGER) AS position FROM o WHERE position <= 8""")
def merged_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Facts first, with two places kept for passages; what is left goes to more facts, then more passages."""
    g = _candidates(spark, sf).select("query_id", "id", F.when(F.col("id") % 3 == 0, "fact").otherwise("passage").alias("kind"), "rank")
    return K.merge_kinds(g, "query_id", "kind", {"fact": 6, "passage": 2}, 8).select("query_id", "id", "kind", "position")


@R.query("screened_questions", f"""WITH q AS (SELECT item_id, question, list_sort(list_distinct({_content_sql('question')})) AS w, string_split({_FOLD.format('passage')}, ' ') AS p FROM eval_items),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY item_id) AS same FROM q), r AS (SELECT CASE WHEN question IS NULL OR length(question) < 20 THEN 'shape' WHEN p IS NULL THEN 'no_passage' WHEN len(list_filter(w, lambda x: list_contains(p, x))) = 0 THEN 'ungrounded' WHEN same > 1 THEN 'repeat' ELSE 'kept' END AS reason FROM f) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def screened_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Why proposed questions are left out, by how many."""
    q = table(spark, sf, "eval_items").select("item_id", "question", "passage", F.array_sort(Q.content_words(F.col("question"))).alias("w"))
    q = q.withColumn("same", F.row_number().over(Window.partitionBy("w").orderBy("item_id")))
    share = Q.covered_share(F.col("w"), F.col("passage"))
    reason = F.when(F.col("question").isNull() | (F.length("question") < 20), "shape").when(F.col("passage").isNull(), "no_passage").when(F.coalesce(share, F.lit(0.0)) == 0, "ungrounded").when(F.col("same") > 1, "repeat").otherwise("kept")
    return q.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.query("metadata_checks", """WITH p AS (SELECT DISTINCT * FROM pdf_evidence) SELECT 'no_url' AS check, count(*) FILTER (url IS NULL OR trim(url) = '') AS rows FROM p UNION ALL SELECT 'no_title', count(*) FILTER (pdf_title IS NULL OR trim(pdf_title) = '') FROM p UNION ALL SELECT 'no_document', count(*) FILTER (document_id NOT IN (SELECT document_id FROM documents)) FROM p
UNION ALL SELECT 'no_text', count(*) FILTER (coalesce(trim(head_text), '') = '' AND coalesce(trim(front_text), '') = '') FROM p""")
def metadata_checks(spark: SparkSession, sf: str) -> DataFrame:
    """How many PDFs lack what their metadata should have."""
    p = table(spark, sf, "pdf_evidence").distinct()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    known = table(spark, sf, "documents").select("document_id").distinct().withColumn("known", F.lit(True))
    n = lambda cond: F.count(F.when(cond, 1))
    counts = p.join(known, "document_id", "left").agg(n(blank("url")).alias("no_url"), n(blank("pdf_title")).alias("no_title"), n(F.col("known").isNull()).alias("no_document"), n(blank("head_text") & blank("front_text")).alias("no_text"))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("rows")) for c in counts.columns))))


@R.query("abstracts_for", """WITH a AS (SELECT content_hash, max(title) AS abstract FROM state_record WHERE content_hash <> '' AND trim(title) <> '' GROUP BY 1), s AS (SELECT document_id, max(struct_pack(t := indexed_at, h := content_hash)).h AS content_hash FROM state_record GROUP BY 1) SELECT document_id, abstract FROM s JOIN a USING (content_hash)""")
def abstracts_for(spark: SparkSession, sf: str) -> DataFrame:
    """The text that is kept under the content hash of each document; blank ones count as absent."""
    s = table(spark, sf, "state_record")
    kept = s.where("content_hash <> '' and trim(title) <> ''").groupBy("content_hash").agg(F.max("title").alias("abstract"))
    last = s.groupBy("document_id").agg(F.max(F.struct("indexed_at", "content_hash")).alias("m")).select("document_id", "m.content_hash")
    return last.join(kept, "content_hash").select("document_id", "abstract")


@R.query("collected_texts", """WITH a AS (SELECT document_id, min(title) AS title FROM state_record WHERE trim(title) <> '' GROUP BY 1), l AS (SELECT document_id, min(struct_pack(i := chunk_index, t := text)).t AS lead FROM chunk WHERE text IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT document_id FROM documents) SELECT document_id, md5(coalesce(a.title, l.lead)) AS text, a.title IS NOT NULL AS abstract FROM d LEFT JOIN a USING (document_id) LEFT JOIN l USING (document_id)""")
def collected_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a summary reads of each document: its abstract, else its first chunk."""
    a = table(spark, sf, "state_record").where("trim(title) <> ''").groupBy("document_id").agg(F.min("title").alias("title"))
    lead = table(spark, sf, "chunk").where("text is not null").groupBy("document_id").agg(F.min(F.struct("chunk_index", "text")).alias("m")).select("document_id", F.col("m.text").alias("lead"))
    d = table(spark, sf, "documents").select("document_id").distinct().join(a, "document_id", "left").join(lead, "document_id", "left")
    return d.select("document_id", F.md5(F.coalesce("title", "lead")).alias("text"), F.col("title").isNotNull().alias("abstract"))


@R.query("gazetteer_names", f"""WITH n AS (SELECT 'author' AS kind, author AS name FROM documents_author UNION ALL SELECT 'title', title FROM documents UNION ALL SELECT 'heading', section_heading FROM chunk UNION ALL SELECT 'theme', theme FROM documents_theme), f AS (SELECT kind, {_FOLD.format('name')} AS name FROM n WHERE name IS NOT NULL) SELECT name, min(kind) AS kind, count(*) AS n FROM f WHERE strpos(name, ' ') > 0 GROUP BY 1""")
def gazetteer_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of two words or more from all places that give them, folded."""
    parts = [table(spark, sf, t).select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, t, c in (("author", "documents_author", "author"), ("title", "documents", "title"), ("heading", "chunk", "section_heading"), ("theme", "documents_theme", "theme"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("name is not null").select("kind", N.fold(F.col("name")).alias("name"))
    return u.where(F.instr("name", " ") > 0).groupBy("name").agg(F.min("kind").alias("kind"), F.count("*").alias("n"))


@R.query("document_contexts", f"SELECT document_id, array_to_string(list_sort(list(DISTINCT {_FOLD.format('coalesce(author_norm, author)')})), '|') AS names FROM documents_author WHERE coalesce(author_norm, author) IS NOT NULL GROUP BY 1")
def document_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The names that each document's own metadata asserts."""
    a = table(spark, sf, "documents_author").select("document_id", N.fold(F.coalesce("author_norm", "author")).alias("n")).where("n is not null")
    return a.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("n")), "|").alias("names"))


@R.query("theme_assignments", """WITH x AS (SELECT document_id, unnest(string_split(theme_path, '>')) AS p, generate_subscripts(string_split(theme_path, '>'), 1) AS i FROM documents_theme WHERE theme_path IS NOT NULL), n AS (SELECT document_id, lower(trim(p)) AS theme, min(i) AS place FROM x GROUP BY 1, 2),
v AS (SELECT lower(trim(theme)) AS theme, min(theme_group) AS theme_group, min(lower(trim(parent))) AS parent FROM documents_theme WHERE theme IS NOT NULL GROUP BY 1) SELECT document_id, n.theme, CAST(place - 1 AS INTEGER) AS place, coalesce(theme_group, 'unclassified') AS theme_group, parent FROM n LEFT JOIN v USING (theme) WHERE n.theme <> ''""")
def theme_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each document's paths as themes of the vocabulary; unknown ones are kept, the first place of a name holds."""
    t = table(spark, sf, "documents_theme")
    plain = lambda c: F.lower(F.trim(c))
    n = t.where("theme_path is not null").select("document_id", F.posexplode(F.split("theme_path", ">", -1)).alias("i", "p")).groupBy("document_id", plain(F.col("p")).alias("theme")).agg(F.min("i").alias("place")).where("theme <> ''")
    v = t.where("theme is not null").groupBy(plain(F.col("theme")).alias("theme")).agg(F.min("theme_group").alias("theme_group"), F.min(plain(F.col("parent"))).alias("parent"))
    return n.join(v, "theme", "left").select("document_id", "theme", "place", F.coalesce("theme_group", F.lit("unclassified")).alias("theme_group"), "parent")


_SCOPED = "s AS (SELECT * FROM documents WHERE source_type = 'website' AND effective_start_date >= DATE '2015-01-01')"


@R.query("count_details", f"""WITH {_SCOPED}, y AS (SELECT 'year' AS kind, CAST(year(effective_start_date) AS VARCHAR) AS key, count(*) AS n FROM s GROUP BY 2), b AS (SELECT 'bundle', source, count(*) FROM s GROUP BY 2), r AS (SELECT 'recent', document_id, 1 FROM (SELECT document_id FROM s ORDER BY effective_start_date DESC, document_id LIMIT 5)) SELECT * FROM y UNION ALL SELECT * FROM b UNION ALL SELECT * FROM r UNION ALL SELECT 'total', NULL, count(*) FROM s""")
def count_details(spark: SparkSession, sf: str) -> DataFrame:
    """What stands beside a count: its years, its mix of bundles and its five most recent documents."""
    s = table(spark, sf, "documents").where("source_type = 'website' and effective_start_date >= date'2015-01-01'")
    by = lambda kind, c: s.groupBy(c.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    recent = s.orderBy(F.desc("effective_start_date"), "document_id").limit(5).select(F.lit("recent").alias("kind"), F.col("document_id").alias("key"), F.lit(1).cast("long").alias("n"))
    total = s.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key"), "n")
    return by("year", F.year("effective_start_date").cast("string")).unionByName(by("bundle", F.col("source"))).unionByName(recent).unionByName(total)


@R.query("breakdown_details", f"""WITH {_SCOPED}, g AS (SELECT theme AS key, count(DISTINCT document_id) AS n FROM documents_theme WHERE document_id IN (SELECT document_id FROM s) AND theme IS NOT NULL GROUP BY 1)
SELECT max(struct_pack(n := n, k := key)).k AS leader, max(n) AS leads_with, CAST(sum(n) AS BIGINT) AS in_groups, count(*) AS groups, sum(n) > (SELECT count(*) FROM s) AS overlap FROM g""")
def breakdown_details(spark: SparkSession, sf: str) -> DataFrame:
    """What stands beside a breakdown: its leading group, and whether groups overlap."""
    s = table(spark, sf, "documents").where("source_type = 'website' and effective_start_date >= date'2015-01-01'")
    g = table(spark, sf, "documents_theme").where("theme is not null").join(s.select("document_id"), "document_id", "left_semi").groupBy("theme").agg(F.countDistinct("document_id").alias("n"))
    d = g.agg(F.max(F.struct("n", "theme")).alias("m"), F.sum("n").alias("in_groups"), F.count("*").alias("groups")).crossJoin(s.agg(F.count("*").alias("total")))  # one row each
    return d.select(F.col("m.theme").alias("leader"), F.col("m.n").alias("leads_with"), "in_groups", "groups", (F.col("in_groups") > F.col("total")).alias("overlap"))


@R.query("author_mix", "SELECT lower(coalesce(a.author_norm, a.author)) AS author, d.source AS bundle, count(DISTINCT d.document_id) AS documents FROM documents_author a JOIN documents d USING (document_id) WHERE coalesce(a.author_norm, a.author) IS NOT NULL GROUP BY 1, 2")
def author_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The bundles behind each author's list."""
    a = table(spark, sf, "documents_author").select("document_id", F.lower(F.coalesce("author_norm", "author")).alias("author")).where("author is not null").distinct()
    return a.join(table(spark, sf, "documents").select("document_id", F.col("source").alias("bundle")), "document_id").groupBy("author", "bundle").agg(F.countDistinct("document_id").alias("documents"))


@R.query("fresh_rows", """SELECT document_id, max(indexed_at) AS indexed_at FROM chunk WHERE indexed_at > TIMESTAMP '2024-01-01' - INTERVAL 365 DAY GROUP BY 1""")
def fresh_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery of each document that is within its time to live."""
    c = table(spark, sf, "chunk").select("document_id", "indexed_at")
    return Rec.fresh(c, "document_id", "indexed_at", F.lit("2024-01-01").cast("timestamp_ntz"), "365 DAY")


@R.query("refreshed_titles", "WITH t AS (SELECT document_id, max(title) AS title FROM state_record WHERE trim(title) <> '' GROUP BY 1) SELECT d.doc_id, coalesce(t.title, d.title) AS title FROM documents d LEFT JOIN t USING (document_id)")
def refreshed_titles(spark: SparkSession, sf: str) -> DataFrame:
    """One field brought up to date on all rows of a document."""
    t = table(spark, sf, "state_record").where("trim(title) <> ''").groupBy("document_id").agg(F.max("title").alias("new"))
    return table(spark, sf, "documents").select("doc_id", "document_id", "title").join(t, "document_id", "left").select("doc_id", F.coalesce("new", "title").alias("title"))


@R.query("dropped_copies", r"""WITH k AS (SELECT DISTINCT document_id, origin, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '[?#].*$', ''), '^www\.', ''), '/+$', '') AS u FROM pdf_evidence WHERE url IS NOT NULL) SELECT DISTINCT document_id, u AS url_key FROM k WHERE origin = 'attachment' AND u NOT IN (SELECT u FROM k WHERE origin = 'inbody')""")
def dropped_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments whose address is not also that of a PDF in a page's body."""
    k = table(spark, sf, "pdf_evidence").where("url is not null").select("document_id", "origin", N.url_key(F.col("url")).alias("url_key")).distinct()
    return k.where("origin = 'attachment'").join(k.where("origin = 'inbody'").select("url_key").distinct(), "url_key", "left_anti").select("document_id", "url_key").distinct()
