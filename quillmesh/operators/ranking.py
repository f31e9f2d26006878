"""Retrieval and ranking over many questions at once: top-k, fusion, bands, re-ranking, admission, measures."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are multiplied with every batch of rows at once; more are taken in blocks, a pass over the rows each.
QUERIES_PER_BLOCK = 4_096
#: Candidates of one question that folds and admissions take; a rank beyond it is an error, never dropped.
MOST_CANDIDATES = 1_000


def _bounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.when(F.col("rank") <= MOST_CANDIDATES, F.col("rank")).otherwise(F.raise_error(F.lit(f"more than {MOST_CANDIDATES} candidates of one question")).cast(df.schema["rank"].dataType)))


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "vec_id", vector: str = "embedding", least: float | None = None, scope: str | None = None) -> DataFrame:
    """The k rows most like each query vector by cosine: ``query_id, id, score, rank`` (from 1; ties by id).

    Exact, whatever the sizes: queries are read in blocks, and each task keeps k rows per query, so that tasks times
    queries times k rows are shuffled. Zero and null vectors score 0. ``least`` drops lower scores. Ids are longs.
    With ``scope``, a column of both, a query meets rows of its own scope alone; rows are not shuffled by it, so that a
    scope may hold any share of them.
    """
    spark = queries.sparkSession
    bound = F.col(scope).cast("string") if scope else F.lit("")
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("__v"), bound.alias("__s"))
    blocks = max(1, -(-q.count() // QUERIES_PER_BLOCK))
    schema = "query_id long, id long, score double"
    out = None
    for b in range(blocks):
        block = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((block.column(0).to_pylist(), _unit(block.column(1).to_pylist()), np.array(block.column(2).to_pylist(), object)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, scopes = shared.value
            best_score = np.full((len(ids), 0), -np.inf)
            best_id = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                own = np.array(batch.column("id").to_pylist(), np.int64)
                if not len(own) or not len(ids):
                    continue
                v = _unit(batch.column("v").to_pylist(), matrix.shape[1])
                near = np.round(matrix @ v.T, 12)
                if scope:
                    near[scopes[:, None] != np.array(batch.column("s").to_pylist(), object)[None, :]] = -np.inf
                score = np.concatenate([best_score, near], 1)
                known = np.concatenate([best_id, np.broadcast_to(own, (len(ids), len(own)))], 1)
                if score.shape[1] > k:  # by id first, so that ties go to the least
                    order = np.lexsort((known, -score), axis=1)[:, :k]
                    score, known = np.take_along_axis(score, order, 1), np.take_along_axis(known, order, 1)
                best_score, best_id = score, known
            n = best_score.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(best_id.ravel(), pa.int64()), pa.array(best_score.ravel(), pa.float64())], names=["query_id", "id", "score"])

        found = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), bound.alias("s")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if scope:
        out = out.where(F.col("score") > -2.0)
    if least is not None:
        out = out.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(vectors: list, size: int | None = None) -> np.ndarray:
    """Vectors of length 1; null ones and ones of another size as zeros."""
    size = size or next((len(v) for v in vectors if v is not None), 0)
    m = np.array([v if v is not None and len(v) == size else [0.0] * size for v in vectors], np.float64).reshape(len(vectors), size)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def rrf(legs: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion. legs: query_id, id, rank of every ranking. Result: query_id, id, fusion_score, rank (ties by id)."""
    fused = legs.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fusion_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion_score", 12)), "id")
    return fused.withColumn("rank", F.row_number().over(w))


def greedy_bands(df: DataFrame, keys: Sequence[str], value: str, tolerance: float | Column, band: str, tie: str = "id") -> DataFrame:
    """Adds leader bands: going down the values of a key, a new band begins where leader - value is above the tolerance.

    Band 0 is the best. Groups are the candidates of a question, at most MOST_CANDIDATES. Values should be rounded, as
    a band hangs on single differences. A null value is below all others, in a last band of its own.
    """
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    rest = [c for c in df.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("__down"), F.col(tie).alias("__tie"), *rest)))
    start = F.struct(F.lit(None).cast("double").alias("leader"), F.lit(-1).alias("band"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        v = -x["__down"]
        # exactly at the tolerance is the same band; rounding removes the noise of the subtraction
        new = acc["leader"].isNull() | v.isNull() | (F.round(acc["leader"] - v, 9) > limit)
        band_ = F.when(new, acc["band"] + 1).otherwise(acc["band"])
        return F.struct(F.when(new, v).otherwise(acc["leader"]).alias("leader"), band_.alias("band"), F.concat(acc["out"], F.array(band_)).alias("out"))

    g = df.groupBy(*keys).agg(ordered.alias("__rows")).select(*keys, "__rows", F.aggregate("__rows", start, step, lambda a: a["out"]).alias("__bands"))
    g = g.select(*keys, F.inline(F.arrays_zip("__rows", "__bands")))
    return g.select(*keys, *(F.col(f"__rows.{c}").alias(c) for c in rest), F.col("__bands").alias(band))


def recency_scores(df: DataFrame, keys: Sequence[str], date: str, score: str = "recency") -> DataFrame:
    """Adds the age of a date among its group, from 0 (oldest) to 1; undated rows and groups of one date have 0.5.

    The bounds of a group come from an aggregation that is joined back, so no group is gathered in one task.
    """
    d = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double")
    bounds = df.groupBy(*keys).agg(F.min(d).alias("__lo"), F.max(d).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(bounds, list(keys)).withColumn(score, F.when(F.col(date).isNull() | F.col("__lo").isNull() | (span == 0), 0.5).otherwise((d - F.col("__lo")) / span)).drop("__lo", "__hi")


def substance(text_length: Column) -> Column:
    return F.log1p(text_length)


def rerank(df: DataFrame, top_n: int, tolerance: float = 0.03, ratio: float = 1.5, threshold: float = 0.0) -> DataFrame:
    """Re-ranked candidates: query_id, id and the bands; df: query_id, id, score, date, authority, chars.

    Candidates above the threshold are banded by relevance; inside each band by recency (in steps of a third), then by
    authority, then by length within a ratio. They are sorted by all bands, then the newest, then the most relevant.
    """
    d = recency_scores(df.where(F.col("score") >= threshold).withColumn("score", F.round("score", 6)), ["query_id"], "date")
    d = d.withColumn("substance", F.round(substance(F.col("chars")), 6)).withColumn("recency", F.round("recency", 6))
    keys = ["query_id"]
    for value, limit, name in (("score", tolerance, "relevance_band"), ("recency", 1 / 3, "recency_band"), ("authority", 0.05, "authority_band"), ("substance", float(np.log(max(ratio, 1.0))), "substance_band")):
        d = greedy_bands(d, keys, value, limit, name)
        keys = [*keys, name]
    w = Window.partitionBy("query_id").orderBy(*keys[1:], F.desc("recency"), F.desc("score"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


# Steps of temporal fit and of authority, and the days by which a document is newer for questions about the present.
FIT_STEP, AUTHORITY_STEP, NEWER_DAYS = 0.10, 0.10, 365.0


def rerank_timed(df: DataFrame, top_n: int, ratio: float = 1.5, threshold: float = 0.0) -> DataFrame:
    """Re-ranked candidates of questions that each ask about a time: query_id, id, five bands and rank.

    df: query_id, id, score, date, authority, chars, fit (of the time asked about), mode and tolerance (of the question).
    Candidates at or above the threshold are banded by relevance within the question's tolerance; inside each band by
    fit; inside that, for questions of the present alone, by a year's difference in date; then by authority, then by
    length within a ratio. They are sorted by all bands, then the newest, then the most relevant, then by id.
    """
    d = recency_scores(df.where(F.col("score") >= threshold).withColumn("score", F.round("score", 6)), ["query_id"], "date")
    d = d.withColumn("substance", F.round(substance(F.col("chars")), 6)).withColumn("recency", F.round("recency", 6))
    span = df.where(F.col("score") >= threshold).groupBy("query_id").agg(F.datediff(F.max("date"), F.min("date")).alias("span"))
    # scores of date lie within 0 and 1, so that a step of 2 makes one band
    step = F.when((F.col("mode") == "current") & (F.col("span") > NEWER_DAYS), F.round(NEWER_DAYS / F.col("span"), 9)).otherwise(2.0)
    d = d.join(span, "query_id").withColumn("newer_step", step)
    keys, bands = ["query_id", "tolerance", "newer_step"], []
    for value, limit, name in (("score", F.col("tolerance"), "relevance_band"), ("fit", FIT_STEP, "temporal_band"), ("recency", F.col("newer_step"), "recency_band"), ("authority", AUTHORITY_STEP, "authority_band"), ("substance", float(np.log(max(ratio, 1.0))), "substance_band")):
        d = greedy_bands(d, [*keys, *bands], value, limit, name)
        bands.append(name)
    w = Window.partitionBy("query_id").orderBy(*bands, F.desc("recency"), F.desc("score"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("query_id", "id", *bands, "rank")


def admit(df: DataFrame, budget: int, limit: int, key: str = "query_id") -> DataFrame:
    """Greedy admission to a context: df has key, rank, id, parent, tokens; the rows admitted get ``position`` (from 1).

    In order of rank, a candidate is passed over where its parent was admitted, or where its tokens don't fit any more;
    later ones that fit are still taken. The first candidate is always admitted.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "parent", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{df.schema['parent'].dataType.simpleString()}>").alias("parents"), F.array().cast(f"array<struct<rank:int,id:{df.schema['id'].dataType.simpleString()},parent:{df.schema['parent'].dataType.simpleString()},tokens:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["out"]) == 0) | (a["spent"] + x["tokens"] <= budget)
        seen = F.coalesce(F.array_contains(a["parents"], x["parent"]), F.lit(False))
        take = fits & ~seen & (F.size(a["out"]) < limit)
        row = F.struct(x["rank"].cast("int").alias("rank"), x["id"].alias("id"), x["parent"].alias("parent"), x["tokens"].cast("long").alias("tokens"))
        return F.struct(
            F.when(take, a["spent"] + x["tokens"]).otherwise(a["spent"]).cast("long").alias("spent"),
            F.when(take, F.concat(a["parents"], F.array(x["parent"]))).otherwise(a["parents"]).alias("parents"),
            F.when(take, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

    g = _bounded(df).groupBy(key).agg(ordered.alias("__r")).select(key, F.aggregate("__r", start, step, lambda a: a["out"]).alias("__out"))
    return g.select(key, F.posexplode("__out").alias("p", "x")).select(key, (F.col("p") + 1).alias("position"), "x.*")


def merge_kinds(df: DataFrame, key: str, kind: str, reserved: Mapping[str, int], limit: int) -> DataFrame:
    """Adds ``position``: kinds in the order given, each with its reserved places by rank, then what is left of each kind in the same order.

    The first ``limit`` of each key come out: the length of a context, as asked for.
    """
    d = df.withColumn("__k", F.row_number().over(Window.partitionBy(key, kind).orderBy("rank")))
    turn = F.lit(2 * len(reserved))
    for i, (name, places) in enumerate(reserved.items()):
        turn = F.when(F.col(kind) == name, F.when(F.col("__k") <= places, i).otherwise(len(reserved) + i)).otherwise(turn)
    w = Window.partitionBy(key).orderBy(turn, "__k")
    return d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("__k")


def distinct_vectors(df: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """Rows of each key, by rank, whose vector is less like every kept one than the threshold; df: key, rank, id, vector."""
    kept = T.StructType([df.schema[key], T.StructField("rank", T.IntegerType()), df.schema["id"]])

    def one(pdf):
        pdf = pdf.sort_values("rank")
        m = _unit(pdf["vector"].tolist())
        chosen: list[int] = []
        for i in range(len(m)):
            if not chosen or (m[chosen] @ m[i]).max() < threshold:
                chosen.append(i)
        return pdf.iloc[chosen][[key, "rank", "id"]]

    return _bounded(df).groupBy(key).applyInPandas(one, kept)


def next_fit(df: DataFrame, key: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Adds ``batch`` (from 0): rows of a key in order, a new batch where the next row would exceed the budget; a row over it is alone.

    Rows are sorted by key and order within partitions and read once with the state of one batch, so that a key with
    very many rows needs no more memory than others. A null size counts as 0.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "batch"), T.StructField("batch", T.IntegerType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spent, n = None, 0, 0
        for b in batches:
            out = []
            for k, s in zip(b.column(key).to_pylist(), b.column(size).to_pylist()):
                s = s or 0
                if (k,) != at:
                    at, spent, n = (k,), s, 0
                elif spent + s > budget:
                    spent, n = s, n + 1
                else:
                    spent += s
                out.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "batch"])

    return df.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def nearest_rank(df: DataFrame, key: str, value: str, shares: Sequence[float], buckets: int = 2_000) -> DataFrame:
    """Exact percentiles per key: ``key, n`` and ``p0, p1, ...``, the values at rank round((n - 1) * share), half to even.

    Values are first counted in buckets between a key's least and greatest; only the bucket that holds a rank is
    sorted, with equal values counted once, so that a key with very many rows is never sorted as a whole. Nulls are left out.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    ends = d.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    spread = F.col("hi") - F.col("lo")
    binned = d.join(ends, "k").withColumn("b", F.when(spread > 0, F.least(F.floor((F.col("v") - F.col("lo")) / spread * buckets), F.lit(buckets - 1))).otherwise(0))
    counts = binned.groupBy("k", "b").agg(F.count("*").alias("c"))
    # at most `buckets` rows a key
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("b"))).join(ends.select("k", "n"), "k")
    wanted = [F.bround((F.col("n") - 1) * q).cast("long") for q in shares]
    holds = upto.select("k", "b", "n", (F.col("upto") - F.col("c")).alias("before"), F.inline(F.array(*(F.struct(F.lit(i).alias("i"), w.alias("rank")) for i, w in enumerate(wanted))))).where(F.col("rank") >= F.col("before"))
    last = holds.groupBy("k", "i", "n", "rank").agg(F.max(F.struct("before", "b")).alias("m")).select("k", "i", "n", "rank", "m.before", "m.b")
    inside = binned.select("k", "b", "v").join(last.select("k", "b").distinct(), ["k", "b"], "left_semi").groupBy("k", "b", "v").agg(F.count("*").alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "b").orderBy("v")))
    found = last.join(inside, ["k", "b"]).where(F.col("before") + F.col("upto") > F.col("rank")).groupBy("k", "n", "i").agg(F.min("v").alias("p"))
    return found.groupBy(F.col("k").alias(key), "n").agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"p{i}") for i in range(len(shares))))


def measures(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall, reciprocal rank and nDCG at k per query; ranked: query_id, id, rank; relevant: query_id, id, grade (above 0).

    Queries without a relevant row are null in all three, not zero.
    """
    graded = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left")
    return measures_of_grades(graded, relevant.groupBy("query_id", "grade").agg(F.count("*").alias("n")), k)


def measures_of_grades(graded: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """As ``measures``, where the relevant rows of a query are known by their numbers; graded: query_id, id, rank, grade (null for none); totals: query_id, grade, n."""
    got = graded.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.count("grade").alias("hits"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"), F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"))
    # the ideal needs the best k grades, so how often each grade comes is enough
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    places_of = totals.where("n > 0").withColumn("upto", F.sum("n").over(w))
    places = F.filter(F.sequence(F.col("upto") - F.col("n") + 1, F.least(F.col("upto"), F.lit(k).cast("long"))), lambda i: i <= k)
    gain = F.aggregate(F.when(F.col("upto") - F.col("n") < k, places), F.lit(0.0), lambda a, i: a + F.col("grade") / F.log2(i + 1))
    ideal = places_of.groupBy("query_id").agg(F.sum(F.coalesce(gain, F.lit(0.0))).alias("ideal"), F.sum("n").alias("n_relevant"))
    return got.join(ideal, "query_id", "left").select(
        "query_id", F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.when(F.col("n_relevant").isNotNull(), F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("reciprocal_rank"), F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"))
