"""Queries on passages: lines that repeat, blocks and sections, quotations, cached answers; and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import passages as P
from quillmesh.functions import phrases as Ph
from quillmesh.operators import mentions as M
from quillmesh.operators import ranking as K
from quillmesh.plans.registry import Registry
from quillmesh.session import table
from quillmesh.streaming import feed

R = Registry()


@R.query("running_lines", r"""WITH l AS (SELECT document_id, chunk_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z]+', '', 'g') AS key FROM (SELECT DISTINCT document_id, chunk_id, text FROM chunk WHERE text IS NOT NULL)),
g AS (SELECT document_id, key, count(DISTINCT chunk_id) AS pages FROM l WHERE length(key) BETWEEN 5 AND 80 GROUP BY 1, 2), t AS (SELECT document_id, count(DISTINCT chunk_id) AS n FROM chunk WHERE text IS NOT NULL GROUP BY 1)
SELECT document_id, key, pages FROM g JOIN t USING (document_id) WHERE pages >= 3 AND pages >= 0.3 * n""")
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that repeat on a share of a document's pages, by their letters; a page is a chunk."""
    c = table(spark, sf, "chunk").where("text is not null").select("document_id", "chunk_id", "text").distinct()
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), P.running_key), lambda k: F.length(k).between(5, 80)))
    lines = c.select("document_id", "chunk_id", F.explode(keys).alias("key")).distinct().groupBy("document_id", "key").agg(F.count("*").alias("pages")).where("pages >= 3")
    total = c.select("document_id", "chunk_id").distinct().groupBy("document_id").agg(F.count("*").alias("n"))
    return lines.join(total, "document_id").where("pages >= 0.3 * n").select("document_id", "key", "pages")


@R.query("number_soup", r"""WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT chunk_id, text FROM chunk WHERE text IS NOT NULL)), w AS (SELECT chunk_id, list_filter(string_split_regex(trim(line), '\s+'), lambda x: x <> '') AS w FROM l)
SELECT chunk_id, count(*) AS soup_lines FROM w WHERE len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[-+(]?[\d][\d.,:/%)]*$'))) >= 0.7 * len(w) GROUP BY 1""")
def number_soup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.size(F.filter(F.split("text", "\n", -1), P.is_number_soup)).alias("k")).groupBy("chunk_id").agg(F.sum("k").alias("soup_lines")).where("soup_lines > 0")


@R.query("doc_blocks", r"""WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(b, '^\s*\|') THEN 'table' WHEN regexp_matches(b, '^\s*([-*•–]|\d{1,3}[.)])\s') THEN 'list' WHEN length(trim(b, ' ' || chr(9) || chr(10) || chr(13))) <= 80 AND NOT regexp_matches(b, '[.!?:;,।]\s*$') THEN 'heading' ELSE 'text' END AS kind, count(*) AS blocks
FROM b WHERE regexp_matches(b, '\S') GROUP BY 1, 2""")
def doc_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each document by kind."""
    b = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n", -1)).alias("b")).where(F.col("b").rlike(r"\S"))
    kind = (F.when(F.col("b").rlike(r"^\s*\|"), "table").when(F.col("b").rlike(r"^\s*([-*•–]|\d{1,3}[.)])\s"), "list")
            .when((F.length(F.regexp_replace("b", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) <= 80) & ~F.col("b").rlike(r"[.!?:;,।]\s*$"), "heading").otherwise("text"))
    return b.select("doc_id", kind.alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


@R.query("grounded_quotes", r"""WITH q AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM eval_items WHERE question IS NOT NULL),
qs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM q WHERE len(w) >= 8), n AS (SELECT item_id, count(*) AS n FROM qs GROUP BY 1),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d WHERE len(w) >= 3)
SELECT item_id, doc_id, round(count(*) / max(n), 6) AS share FROM qs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.6 * max(n)""")
def grounded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of which most runs of three words stand in a document; runs are joined, so only pairs that share one meet."""
    w = lambda c: F.size(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda x: x != ""))
    q = table(spark, sf, "eval_items").where("question is not null").where(w("question") >= 8).select("item_id", P.word_runs(F.col("question")).alias("r"))
    q = q.select("item_id", F.size("r").alias("n"), F.explode("r").alias("run"))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(P.word_runs(F.col("text"))).alias("run"))
    j = d.join(q, "run").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return j.where("k >= 0.6 * n").select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("share"))


_NORM = "array_to_string(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ')"
_SPANS = f"""n AS (SELECT DISTINCT section_heading AS name, {_NORM.format('section_heading')} AS run FROM chunk WHERE section_heading IS NOT NULL), k AS (SELECT name, run, len(string_split(run, ' ')) AS length FROM n WHERE run <> ''),
d AS (SELECT doc_id, string_split({_NORM.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT DISTINCT r.doc_id, r.i - 1 AS start, k.length, k.name FROM r JOIN k ON k.length <= 6 AND array_to_string(r.w[r.i:r.i + k.length - 1], ' ') = k.run)"""


@R.query("gazetteer_mentions", f"""WITH {_SPANS.replace("FROM r JOIN k ON k.length <= 6 AND array_to_string(r.w[r.i:r.i + k.length - 1], ' ') = k.run", "FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS run FROM r, (VALUES (1), (2), (3), (4), (5), (6)) t(l) WHERE i + l - 1 <= len(w)) r JOIN k ON k.length = r.l AND k.run = r.run")}
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, name FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.length > f.length AND g.start <= f.start AND f.start + f.length <= g.start + g.length)""")
def gazetteer_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Where section headings of the corpus stand in documents, the longest ones."""
    names = table(spark, sf, "chunk").select(F.col("section_heading").alias("name"), F.lit("heading").alias("kind")).distinct()
    found = M.spans(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", names)
    return M.outermost(found, "doc_id").select("doc_id", "start", "length", "name")


@R.query("disjoint_mentions")
def disjoint_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """As gazetteer_mentions, but no two share a word. Greedy over the spans of a text, which SQL can't express."""
    names = table(spark, sf, "chunk").select(F.col("section_heading").alias("name"), F.lit("heading").alias("kind")).distinct()
    return M.disjoint(M.spans(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", names), "doc_id").select("doc_id", "start", "length", "name")


_CACHE_COS = "round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 0), 6)"


@R.query("cache_lookup", f"""SELECT q.vec_id AS query_id, arg_max(c.vec_id, ({_CACHE_COS}, -c.vec_id)) AS cached_id, max({_CACHE_COS}) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND c.vec_id <> q.vec_id
WHERE q.vec_id % 50 = 0 GROUP BY 1 HAVING max({_CACHE_COS}) >= 0.2""")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest cached question of the same scope, if near enough; the cache is all rows but the question's own, the scope their label."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    near = K.vector_topk(q, e, 2, scope="label").where("query_id <> id").withColumn("score", F.round("score", 6))
    best = near.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    return best.select("query_id", (-F.col("b.m")).alias("cached_id"), F.col("b.score").alias("score")).where("score >= 0.2")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return feed.file_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("tumbling_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per day and type, from a stream that is merged batch by batch into a keyed table."""
    t = feed.KeyedTable(spark, ["window_start", "event_type"], [])
    feed.run_available(feed.tumbling_counts(_events(spark, sf), "ts", ["event_type"], "1 day", "2 days"), t.merge)
    return t.rows()


@R.query("stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user, from a stream."""
    t = feed.KeyedTable(spark, ["user_id"], ["ts", "event_id"])
    feed.run_available(_events(spark, sf).select("user_id", "ts", "event_id"), t.merge, "append")
    return t.rows().select("user_id", "event_id", "ts")


@R.query("approx_distinct")
def approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Users per type by a sketch with a relative error of 0.02."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@R.query("doc_sections", r"""WITH b0 AS (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS b, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, trim(b, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM b0), k AS (SELECT doc_id, i, b, length(b) <= 80 AND NOT regexp_matches(b, '[.!?:;,।]\s*$') AND NOT regexp_matches(b, '^\s*\|') AND NOT regexp_matches(b, '^\s*([-*•–]|\d{1,3}[.)])\s') AS h FROM b WHERE b <> ''),
s AS (SELECT *, row_number() OVER w = 1 OR h AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM s)
SELECT doc_id, CAST(sec - 1 AS INTEGER) AS section_index, max(CASE WHEN h THEN b END) AS heading, CAST(sum(CASE WHEN h THEN 0 ELSE 1 END) AS INTEGER) AS blocks, CAST(sum(CASE WHEN h THEN 0 ELSE length(b) END) AS INTEGER) AS chars FROM g GROUP BY doc_id, sec""")
def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The headed sections of every document, folded within its row."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(Ph.sections(F.col("text"))).alias("section_index", "s"))
    return d.select("doc_id", "section_index", "s.heading", "s.blocks", "s.chars")


@R.query("since_windows", r"""SELECT item_id, regexp_extract(passage, '(?i)\bsince\s+((?:19|20)\d{2})\b', 1) || '-01-01' AS start_day FROM eval_items
WHERE regexp_matches(passage, '(?i)\bsince\s+(19|20)\d{2}\b') AND NOT regexp_matches(passage, '(?i)\bbetween\s+(19|20)\d{2}\s+and\s+(19|20)\d{2}\b') AND NOT regexp_matches(passage, '(?i)\bfrom\s+(19|20)\d{2}\s+(to|until|till)\s+(19|20)\d{2}\b')""")
def since_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose passage names a period that began in a year and lasts."""
    w = table(spark, sf, "eval_items").where("passage is not null").select("item_id", Ph.window_of(F.col("passage")).alias("w"))
    return w.where("w.basis = 'since'").select("item_id", F.col("w.start").cast("string").alias("start_day"))
