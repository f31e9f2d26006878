import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillmesh.operators import ranking as K


def plain_bands(values, tol):
    out, leader, band = [], None, -1
    for v in sorted(values, reverse=True):
        if leader is None or round(leader - v, 9) > tol:
            leader, band = v, band + 1
        out.append((v, band))
    return out


def test_topk_against_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERIES_PER_BLOCK", 3)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(200, 8)), 3).tolist()
    v[5] = [0.0] * 8
    v[17] = v[18]
    rows = [(i, x) for i, x in enumerate(v)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 20 = 0 or vec_id = 5").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in K.vector_topk(q, df, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if a and b else 0
        return round(float(np.dot(a, b) / n), 12) if n else 0.0

    for i in [*range(0, 200, 20), 5]:
        want = sorted(((-cos(v[i], x), j) for j, x in rows))[:7]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in want]
    assert K.vector_topk(q.limit(0), df, 3).count() == 0 and K.vector_topk(q, df.limit(0), 3).count() == 0


def test_bands_at_the_edge_long_chain_equal_and_empty(spark):
    cases = {"edge": [1.0, 0.98, 0.96, 0.955, 0.5], "chain": [1 - i * 0.01 for i in range(30)], "equal": [0.5] * 4, "one": [0.1]}
    rows = [(k, i, round(x, 6)) for k, xs in cases.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "q string, id int, v double")
    got = K.greedy_bands(df, ["q"], "v", 0.03, "band").collect()
    for k, xs in cases.items():
        assert sorted(((r.v, r.band) for r in got if r.q == k), key=lambda x: (-x[0], x[1])) == plain_bands([round(x, 6) for x in xs], 0.03)
    assert [b for _, b in plain_bands(cases["edge"], 0.03)] == [0, 0, 1, 1, 2]
    assert K.greedy_bands(df.limit(0), ["q"], "v", 0.03, "band").count() == 0


def test_rerank_against_plain(spark):
    r = random.Random(2)
    rows = [(1, i, round(r.random(), 2), f"20{r.randint(10, 24)}-0{r.randint(1, 9)}-11" if r.random() < 0.8 else None, r.choice([0.35, 0.7, 1.0]), r.choice([50, 60, 400, 3000])) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, id int, score double, d string, authority double, chars int").withColumn("date", F.col("d").cast("date")).drop("d")
    got = [x.id for x in K.rerank(df, 40, threshold=0.1).orderBy("rank").collect()]
    import datetime as dt
    live = [x for x in rows if x[2] >= 0.1]
    days = {x[1]: (dt.date.fromisoformat(x[3]) - dt.date(1970, 1, 1)).days for x in live if x[3]}
    lo, hi = min(days.values()), max(days.values())
    rec = {x[1]: round((days[x[1]] - lo) / (hi - lo), 6) if x[3] else 0.5 for x in live}
    key = {x[1]: [] for x in live}
    groups = {(): [x for x in live]}
    for value, tol in ((lambda x: x[2], 0.03), (lambda x: rec[x[1]], 1 / 3), (lambda x: x[4], 0.05), (lambda x: round(math.log1p(x[5]), 6), math.log(1.5))):
        new = {}
        for g, members in groups.items():
            band_of = dict(plain_bands(sorted({value(m) for m in members}), tol))
            for m in members:
                new.setdefault((*g, band_of[value(m)]), []).append(m)
        groups = new
    order = [m[1] for g in sorted(groups) for m in sorted(groups[g], key=lambda m: (-rec[m[1]], -m[2], m[1]))]
    assert got == order


def test_admission_skips_but_does_not_stop(spark):
    rows = [(1, 1, 10, 100, 50), (1, 2, 11, 100, 5), (1, 3, 12, 101, 60), (1, 4, 13, 102, 30), (2, 1, 20, 1, 500), (2, 2, 21, 2, 10), (3, 1, 30, None, 10), (3, 2, 31, None, 10)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id long, parent long, tokens long")
    got = {(r.query_id, r.position): r.id for r in K.admit(df, 90, 8).collect()}
    assert got == {(1, 1): 10, (1, 2): 13, (2, 1): 20, (3, 1): 30, (3, 2): 31}
    assert K.admit(df, 90, 1).count() == 3 and K.admit(df.limit(0), 90, 8).count() == 0


def test_distinct_vectors_and_next_fit(spark):
    rows = [(1, 1, 1, [1.0, 0.0]), (1, 2, 2, [0.99, 0.1]), (1, 3, 3, [0.0, 1.0]), (2, 1, 4, [0.0, 0.0]), (2, 2, 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id int, rank int, id int, vector array<double>")
    assert sorted(r.id for r in K.distinct_vectors(df, 0.92).collect()) == [1, 3, 4, 5]
    r = random.Random(7)
    rows = [(k, i, r.randint(1, 60)) for k in ("a", "b") for i in range(50)] + [("c", 0, 1000), ("c", 1, 1)]
    got = {(x.k, x.i): x.batch for x in K.next_fit(spark.createDataFrame(rows, "k string, i int, s long"), "k", ["i"], "s", 100).collect()}
    for k in "abc":
        spent, b = 0, -1
        for kk, i, s in rows:
            if kk == k:
                if b < 0 or spent + s > 100:
                    spent, b = s, b + 1
                else:
                    spent += s
                assert got[k, i] == b


def test_rrf_and_measures(spark):
    legs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    got = {r.id: (round(r.fusion_score, 9), r.rank) for r in K.rrf(legs).collect()}
    assert got == {"b": (round(1 / 61 + 1 / 62, 9), 1), "a": (round(1 / 61, 9), 2), "c": (round(1 / 62, 9), 3)}
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (3, "a", 1)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "x", 2), (3, "z", 1)], "query_id int, id string, grade int")
    m = {r.query_id: (r.recall, r.reciprocal_rank, r.ndcg) for r in K.measures(ranked, rel, 3).collect()}
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    ideal = 2 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert m[1] == (round(2 / 3, 6), 0.5, round(dcg / ideal, 6)) and m[2] == (None, None, None) and m[3] == (0.0, 0.0, 0.0)


def test_nearest_rank_percentiles(spark):
    r = random.Random(3)
    rows = [("a", r.choice([r.random(), 0.5, 7.0])) for _ in range(501)] + [("b", 1.0)] * 3 + [("c", 5.0), ("d", None)] + [("e", float(i)) for i in range(10)]
    got = {x.k: (x.n, x.p0, x.p1, x.p2) for x in K.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.5, 0.95], buckets=7).collect()}
    for k in "abce":
        v = sorted(x for kk, x in rows if kk == k)
        assert got[k] == (len(v), *(v[round((len(v) - 1) * q)] for q in (0.0, 0.5, 0.95)))
    assert "d" not in got


def test_index_holds_every_row_and_recalls(spark):
    from quillmesh.operators import vector_index as V

    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    centers = V.fit_centers(e, 180)
    index = V.assign(e, centers, "vec_id", "embedding")
    assert index.select("id").distinct().count() == index.count() == e.count()
    exact = {(r.query_id, r.id) for r in K.vector_topk(q, e, 10).collect()}
    near = {(r.query_id, r.id) for r in V.search(q, index, centers, 10, 72).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    assert {r.list for r in V.assign(odd, centers, "vec_id", "embedding").collect()} == {0}
