"""Queries of retrieval and ranking. Query vectors are all rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import names as N
from quillmesh.functions import dates as D
from quillmesh.operators import ranking as K
from quillmesh.operators import vector_index as V
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()

_COS = "round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 0), 6)"


def _top(k: int, where: str = "true") -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}) WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.query("vector_topk", _top(10))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    return _ranked(K.vector_topk(q, e, 10))


@R.query("scoped_topk", _top(10, "v.label IN (1, 3, 5)"))
def scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    return _ranked(K.vector_topk(q, e.where("label in (1, 3, 5)"), 10))


@R.query("dual_topk", f"SELECT query_id, id, score, rank, 'first' AS pull FROM ({_top(4, 'v.label < 5')}) UNION ALL SELECT query_id, id, score, rank, 'second' FROM ({_top(8, 'v.label >= 5')})")
def dual_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    pull = lambda where, k, name: _ranked(K.vector_topk(q, e.where(where), k)).withColumn("pull", F.lit(name))
    return pull("label < 5", 4, "first").unionByName(pull("label >= 5", 8, "second"))


@R.query("threshold_topk", f"SELECT * FROM ({_top(20)}) WHERE score >= 0.3")
def threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    return _ranked(K.vector_topk(q, e, 20)).where("score >= 0.3")


_CAND = f"""cand AS ({_top(40)}), base AS (SELECT c.query_id, c.id, c.score, c.rank, DATE '2015-01-01' + CAST((c.id * 37) % 3000 AS INTEGER) AS date,
  CASE (c.id % 4) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS authority, (c.id * 131) % 2000 + 50 AS chars FROM cand c)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    d = _ranked(K.vector_topk(q, e, 40))
    return d.select("query_id", "id", "score", "rank", F.date_add(F.lit("2015-01-01").cast("date"), ((F.col("id") * 37) % 3000).cast("int")).alias("date"),
                    F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 1, 0.8).when(F.col("id") % 4 == 2, 0.6).otherwise(0.35).alias("authority"), ((F.col("id") * 131) % 2000 + 50).alias("chars"))


def _bands_sql(source: str, keys: str, value: str, tolerance: str, out: str, name: str) -> str:
    on = " AND ".join(f"r.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value} DESC, id) AS __n FROM {source}),
{name} AS (SELECT *, {value} AS __leader, 0 AS {out} FROM {name}_o WHERE __n = 1 UNION ALL
  SELECT r.*, CASE WHEN round(b.__leader - r.{value}, 9) > {tolerance} THEN r.{value} ELSE b.__leader END, CASE WHEN round(b.__leader - r.{value}, 9) > {tolerance} THEN b.{out} + 1 ELSE b.{out} END
  FROM {name} b JOIN {name}_o r ON {on} AND r.__n = b.__n + 1)"""


@R.query("greedy_bands", f"WITH RECURSIVE {_CAND}, {_bands_sql('base', 'query_id', 'score', '0.03', 'band', 'b1')} SELECT query_id, id, score, band FROM b1")
def greedy_bands(spark: SparkSession, sf: str) -> DataFrame:
    return K.greedy_bands(_candidates(spark, sf), ["query_id"], "score", 0.03, "band").select("query_id", "id", "score", "band")


@R.query("nested_bands", f"WITH RECURSIVE {_CAND}, {_bands_sql('base', 'query_id', 'score', '0.03', 'outer_band', 'b1')}, b1x AS (SELECT query_id, id, score, authority, outer_band FROM b1), {_bands_sql('b1x', 'query_id, outer_band', 'authority', '0.05', 'inner_band', 'b2')} SELECT query_id, id, outer_band, inner_band FROM b2")
def nested_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = K.greedy_bands(_candidates(spark, sf), ["query_id"], "score", 0.03, "outer_band")
    return K.greedy_bands(d, ["query_id", "outer_band"], "authority", 0.05, "inner_band").select("query_id", "id", "outer_band", "inner_band")


@R.query("banded_rerank")
def banded_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Checked against a plain re-ranking in the tests; four nested recursions are too slow as SQL."""
    d = K.rerank(_candidates(spark, sf), 10, threshold=-1.0)
    return d.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "relevance_band", "recency_band", "authority_band", "substance_band")


_TIMED = """timed AS (SELECT *, CASE (query_id // 50) % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'date_range' WHEN 2 THEN 'past' ELSE 'none' END AS mode, CASE WHEN query_id % 100 = 0 THEN 0.06 ELSE 0.03 END::DOUBLE AS tolerance, CASE WHEN id % 9 = 0 THEN NULL ELSE date END AS start, date + 200 AS finish, id % 5 = 0 AS open_ended FROM base),
fitted AS (SELECT *, CASE mode WHEN 'current' THEN CASE WHEN start IS NULL THEN 0.5 WHEN start > DATE '2020-01-01' THEN 0.25 WHEN open_ended OR finish >= DATE '2020-01-01' THEN 1.0 ELSE 0.25 END WHEN 'past' THEN CASE WHEN start IS NULL THEN 0.5 WHEN open_ended OR finish >= DATE '2020-01-01' THEN 0.25 ELSE 1.0 END
 WHEN 'date_range' THEN CASE WHEN start IS NULL THEN 0.5 WHEN start >= DATE '2020-01-01' OR CASE WHEN open_ended THEN DATE '2020-01-01' ELSE finish END < DATE '2018-01-01' THEN 0.25 WHEN start >= DATE '2018-01-01' AND CASE WHEN open_ended THEN DATE '2020-01-01' ELSE finish END < DATE '2020-01-01' THEN 1.0 ELSE 0.75 END ELSE 0.5 END::DOUBLE AS fit FROM timed),
spans AS (SELECT query_id, min(start) AS lo, max(start) AS hi, date_diff('day', min(start), max(start)) AS span FROM fitted GROUP BY 1),
r0 AS (SELECT f.query_id, f.id, round(f.score, 6) AS score, f.tolerance, f.fit, f.authority, round(ln(1 + f.chars), 6) AS substance, round(CASE WHEN f.start IS NULL OR s.span = 0 THEN 0.5 ELSE date_diff('day', s.lo, f.start) / s.span::DOUBLE END, 6) AS recency,
 CASE WHEN f.mode = 'current' AND s.span > 365 THEN round(365.0::DOUBLE / s.span, 9) ELSE 2.0 END AS step FROM fitted f JOIN spans s USING (query_id))"""


def _chain_sql() -> str:
    """Five bands, each within those before it."""
    columns, keys, out, source = "query_id, id, score, tolerance, fit, authority, substance, recency, step", "query_id", [], "r0"
    for i, (value, limit, name) in enumerate((("score", "r.tolerance", "relevance_band"), ("fit", "0.1", "temporal_band"), ("recency", "r.step", "recency_band"), ("authority", "0.1", "authority_band"), ("substance", repr(math.log(1.5)), "substance_band")), 1):
        out.append(_bands_sql(source, keys, value, limit, name, f"k{i}"))
        columns, keys, source = f"{columns}, {name}", f"{keys}, {name}", f"k{i}x"
        out.append(f"k{i}x AS MATERIALIZED (SELECT {columns} FROM k{i})")
    return ", ".join(out)


@R.query("timed_rerank", f"""WITH RECURSIVE {_CAND}, {_TIMED}, {_chain_sql()}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_band, temporal_band, recency_band, authority_band, substance_band, recency DESC, score DESC, id) AS rank FROM k5x)
SELECT query_id, id, rank, relevance_band, temporal_band, recency_band, authority_band, substance_band FROM z WHERE rank <= 10""")
def timed_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates re-ranked for questions about the present, a period, the past and no time."""
    c = _candidates(spark, sf)
    mode = F.element_at(F.array(*map(F.lit, ("current", "date_range", "past", "none"))), (F.floor(F.col("query_id") / 50) % 4 + 1).cast("int"))
    c = c.select("*", mode.alias("mode"), F.when(F.col("query_id") % 100 == 0, 0.06).otherwise(0.03).alias("tolerance"), F.when(F.col("id") % 9 != 0, F.col("date")).alias("start"))
    day = lambda x: F.lit(x).cast("date")
    fit = D.fit_of_mode(F.col("mode"), F.col("start"), F.date_add("date", 200), F.col("id") % 5 == 0, day("2020-01-01"), day("2018-01-01"), day("2020-01-01"))
    d = K.rerank_timed(c.withColumn("fit", fit).drop("date").withColumnRenamed("start", "date"), 10, threshold=-1.0)
    return d.withColumn("rank", F.col("rank").cast("long"))


@R.query("rrf_fusion", f"""WITH {_CAND}, legs AS (SELECT query_id, id, rank FROM cand UNION ALL
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY authority DESC, chars DESC, id) FROM base),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM legs GROUP BY 1, 2)
SELECT query_id, id, round(s, 9) AS fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM f""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    other = c.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("authority"), F.desc("chars"), "id")).alias("rank"))
    return K.rrf(c.select("query_id", "id", "rank").unionByName(other)).select("query_id", "id", F.round("fusion_score", 9).alias("fusion_score"), F.col("rank").cast("long").alias("rank"))


@R.query("recency_scaled", f"""WITH {_CAND} SELECT query_id, id, round(CASE WHEN max(date) OVER w = min(date) OVER w THEN 0.5 ELSE (date - min(date) OVER w) / (max(date) OVER w - min(date) OVER w)::DOUBLE END, 6) AS recency
FROM base WINDOW w AS (PARTITION BY query_id)""")
def recency_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return K.recency_scores(_candidates(spark, sf), ["query_id"], "date").select("query_id", "id", F.round("recency", 6).alias("recency"))


@R.query("authority_case", """SELECT document_id, CASE WHEN source_type = 'manual' THEN 1.0 WHEN source IN ('report', 'research_papers') THEN 0.9 WHEN source_type = 'website' THEN 0.7 WHEN source_type = 'pdf_attachment' THEN 0.5 ELSE 0.35 END::DOUBLE AS authority FROM documents""")
def authority_case(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source_type")
    return table(spark, sf, "documents").select("document_id", F.when(s == "manual", 1.0).when(F.col("source").isin("report", "research_papers"), 0.9).when(s == "website", 0.7).when(s == "pdf_attachment", 0.5).otherwise(0.35).alias("authority"))


@R.query("substance_log", "SELECT doc_id, round(ln(1 + n_chars), 6) AS substance FROM documents")
def substance_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(K.substance(F.col("n_chars")), 6).alias("substance"))


@R.query("keyword_topk", """SELECT doc_id, hits FROM (SELECT doc_id, CAST(contains(lower(text), 'reservoir') AS INT) + CAST(contains(lower(text), 'harbour') AS INT) + CAST(contains(lower(text), 'audit') AS INT) AS hits FROM documents WHERE text IS NOT NULL)
WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 100""")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in ("reservoir", "harbour", "audit")), F.lit(0))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(100)


@R.query("context_admission", f"""WITH RECURSIVE {_CAND}, o AS (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, id % 12 AS parent, chars // 4 AS tokens FROM base),
a AS (SELECT query_id, rank, id, parent, tokens, true AS take, tokens AS spent, [parent] AS parents, 1 AS n FROM o WHERE rank = 1 UNION ALL
 SELECT r.query_id, r.rank, r.id, r.parent, r.tokens, (a.spent + r.tokens <= 1500 AND NOT list_contains(a.parents, r.parent) AND a.n < 8),
  CASE WHEN a.spent + r.tokens <= 1500 AND NOT list_contains(a.parents, r.parent) AND a.n < 8 THEN a.spent + r.tokens ELSE a.spent END,
  CASE WHEN a.spent + r.tokens <= 1500 AND NOT list_contains(a.parents, r.parent) AND a.n < 8 THEN list_append(a.parents, r.parent) ELSE a.parents END,
  CASE WHEN a.spent + r.tokens <= 1500 AND NOT list_contains(a.parents, r.parent) AND a.n < 8 THEN a.n + 1 ELSE a.n END
 FROM a JOIN o r ON r.query_id = a.query_id AND r.rank = a.rank + 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position, rank, id, parent, tokens FROM a WHERE take""")
def context_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = _candidates(spark, sf).select("query_id", "id", F.col("rank").cast("int").alias("rank"), (F.col("id") % 12).alias("parent"), F.floor(F.col("chars") / 4).alias("tokens"))
    return K.admit(d, 1500, 8)


@R.query("distinct_perspectives")
def distinct_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates less alike than 0.6 among those kept; greedy, so compared with a plain loop in the tests."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    d = _candidates(spark, sf).select("query_id", "id", F.col("rank").cast("int").alias("rank")).join(e, "id")
    return K.distinct_vectors(d, 0.6)


@R.query("next_fit_batches", """WITH RECURSIVE c AS (SELECT document_id, chunk_id, max(length(text)) // 4 + 50 AS size FROM chunk WHERE text IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS n FROM c),
f AS (SELECT document_id, chunk_id, size, n, size AS spent, 0 AS batch FROM o WHERE n = 1 UNION ALL
 SELECT o.document_id, o.chunk_id, o.size, o.n, CASE WHEN f.spent + o.size > 800 THEN o.size ELSE f.spent + o.size END, CASE WHEN f.spent + o.size > 800 THEN f.batch + 1 ELSE f.batch END
 FROM f JOIN o ON o.document_id = f.document_id AND o.n = f.n + 1) SELECT document_id, chunk_id, size, batch FROM f""")
def next_fit_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document packed into batches of at most 800 tokens by estimate."""
    d = table(spark, sf, "chunk").where("text is not null").groupBy("document_id", "chunk_id").agg((F.floor(F.max(F.length("text")) / 4) + 50).alias("size"))
    return K.next_fit(d, "document_id", ["chunk_id"], "size", 800)


_REL = """rel AS (SELECT q.vec_id AS query_id, v.vec_id AS id, CASE WHEN v.vec_id % 3 = 0 THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)"""


@R.query("recall_mrr_ndcg", f"""WITH {_CAND}, {_REL}, g AS (SELECT c.query_id, count(r.grade) AS hits, min(c.rank) FILTER (r.grade IS NOT NULL) AS first, sum(coalesce(r.grade, 0) / log2(c.rank + 1)) AS dcg
  FROM cand c LEFT JOIN rel r USING (query_id, id) WHERE c.rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(grade / log2(p + 1)) FILTER (p <= 10) AS ideal, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS p FROM rel) GROUP BY 1)
SELECT query_id, round(hits / n, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(dcg / ideal, 6) AS ndcg FROM g LEFT JOIN i USING (query_id)""")
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    grade = F.when(F.col("id") % 3 == 0, 2).otherwise(1)
    own = e.select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    graded = _candidates(spark, sf).join(own, "id").join(q.select("query_id", "label"), "query_id")
    graded = graded.select("query_id", "id", "rank", F.when((F.col("own") == F.col("label")) & (F.col("id") != F.col("query_id")), grade).alias("grade"))
    # how many rows of each grade a label has is enough: no pairs of a label are made
    counts = own.groupBy(F.col("own").alias("label"), grade.alias("grade")).agg(F.count("*").alias("n"))
    self_grade = F.when(F.col("query_id") % 3 == 0, 2).otherwise(1)
    totals = q.select("query_id", "label").join(counts, "label").select("query_id", "grade", (F.col("n") - (F.col("grade") == self_grade).cast("long")).alias("n"))
    return K.measures_of_grades(graded, totals, 10)


@R.query("vector_reuse", """SELECT d.doc_id, coalesce(e.vec_id, -1) AS vec_id, e.vec_id IS NOT NULL AS reused FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.embedding IS NOT NULL""")
def vector_reuse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), "vec_id")
    d = table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left")
    return d.select("doc_id", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.col("vec_id").isNotNull().alias("reused"))


@R.query("majority_vote", """SELECT document_id, bundle FROM (SELECT document_id, bundle, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, bundle) AS r FROM chunk WHERE bundle IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "chunk").where("bundle is not null").groupBy("document_id", "bundle").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "bundle")).alias("b")).select("document_id", "b.bundle")


@R.query("ann_topk")
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate top ten from an inverted-file index over all rows; its recall against the exact ones is tested (0.9 or more)."""
    q, e = _vectors(spark, sf)
    lists = max(1, min(4_096, round(4 * e.count() ** 0.5 / 10) * 10))
    centers = V.fit_centers(e, lists)
    return V.search(q, V.assign(e, centers, "vec_id", "embedding"), centers, 10, max(1, lists * 2 // 5)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FOLD = "trim(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžłø', 'aaaaaaceeeeiiiinooooouuuuyyszlo'), '[^a-z0-9]+', ' ', 'g'))"
_HYBRID = f"""w AS (SELECT DISTINCT doc_id, unnest(string_split({_FOLD}, ' ')) AS word FROM documents WHERE title IS NOT NULL),
s AS (SELECT word FROM w WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) <= greatest(25, 0.01 * (SELECT count(*) FROM documents WHERE title IS NOT NULL))),
k AS (SELECT q.doc_id AS query_id, d.doc_id AS id, count(*) AS hits FROM w q JOIN s USING (word) JOIN w d USING (word) WHERE q.doc_id % 50 = 0 AND q.doc_id IN (SELECT vec_id FROM embeddings) AND d.doc_id <> q.doc_id GROUP BY 1, 2),
legs AS (SELECT query_id, id, rank FROM cand UNION ALL SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM k) WHERE rank <= 40),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM legs GROUP BY 1, 2)"""


@R.query("hybrid_topk", f"WITH {_CAND}, {_HYBRID} SELECT query_id, id, fusion_score, rank FROM (SELECT query_id, id, round(s, 9) AS fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM f) WHERE rank <= 10")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the vectors and by the selective title words of a query document, fused."""
    words = F.explode(F.array_distinct(F.split(N.fold(F.col("title")), " "))).alias("word")
    titled = table(spark, sf, "documents").where("title is not null")
    w = titled.select("doc_id", words).where("length(word) >= 4")
    n = titled.agg(F.count("*")).scalar()
    rare = w.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= F.greatest(F.lit(25.0), n * 0.01)).select("word")
    w = w.join(rare, "word")
    asked = w.where("doc_id % 50 = 0").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    hits = asked.join(w.withColumnRenamed("doc_id", "id"), "word").where("id <> query_id").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    words_leg = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "id"))).where("rank <= 40").select("query_id", "id", "rank")
    fused = K.rrf(_candidates(spark, sf).select("query_id", "id", "rank").unionByName(words_leg)).where("rank <= 10")
    return fused.select("query_id", "id", F.round("fusion_score", 9).alias("fusion_score"), F.col("rank").cast("long").alias("rank"))


@R.query("relaxed_scope", f"""WITH {_CAND}, x AS (SELECT *, date >= DATE '2022-06-01' AND authority >= 0.8 AND score >= 0.25 AS fits FROM base)
SELECT query_id, id, score, NOT bool_or(fits) OVER (PARTITION BY query_id) AS relaxed FROM x QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY query_id)""")
def relaxed_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates within the facets of a question; where none is, the facets are let go rather than the question left empty."""
    x = _candidates(spark, sf).withColumn("fits", (F.col("date") >= F.lit("2022-06-01").cast("date")) & (F.col("authority") >= 0.8) & (F.col("score") >= 0.25))
    some = x.groupBy("query_id").agg(F.max("fits").alias("some"))
    return x.join(some, "query_id").where("fits or not some").select("query_id", "id", "score", (~F.col("some")).alias("relaxed"))
