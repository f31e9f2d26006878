import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import catalog as C
from quillmesh.operators import mentions as M
from quillmesh.operators import ranking as K
from quillmesh.operators import tools as T


def test_disjoint_spans_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = sorted({(k, rng.randrange(30), rng.randrange(1, 6)) for k in range(5) for _ in range(40)})
    df = spark.createDataFrame([(k, s, n, f"n{n}", "x") for k, s, n in rows], "k int, start int, length int, name string, kind string")
    want = set()
    for k, group in itertools.groupby(rows, lambda r: r[0]):
        taken = set()
        for _, s, n in sorted(group, key=lambda r: (-r[2], r[1])):
            if taken.isdisjoint(range(s, s + n)):
                taken |= set(range(s, s + n))
                want.add((k, s, n))
    assert {(r.k, r.start, r.length) for r in M.disjoint(df, "k").collect()} == want
    assert M.disjoint(df.limit(0), "k").count() == 0


def test_search_within_a_scope(spark):
    rng = np.random.default_rng(1)
    e = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int")
    q = e.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    vectors = {r.vec_id: (np.array(r.embedding) / np.linalg.norm(r.embedding), r.label) for r in e.collect()}
    got = {}
    for r in K.vector_topk(q, e, 5, scope="label").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(6):
        v, label = vectors[i]
        near = sorted((j for j in vectors if vectors[j][1] == label), key=lambda j: (-round(float(v @ vectors[j][0]), 12), j))
        assert got[i] == near[:5]


def test_too_many_candidates_are_an_error(spark):
    df = spark.createDataFrame([(1, 2_000, 1, "p", 5)], "query_id int, rank int, id int, parent string, tokens int")
    with pytest.raises(Exception, match="candidates"):
        K.admit(df, 100, 5).collect()


def test_lookup_and_pages(spark):
    docs = spark.createDataFrame([(f"d{i}", f"Report {i:03}", "a", "website") for i in range(120)] + [("x", "Dry Well", "b", "manual"), ("y", "dry well", "b", "manual")], "document_id string, title string, bundle string, source_type string")
    docs = docs.withColumn("effective_start_date", F.lit("2020-01-01").cast("date"))
    facet = spark.createDataFrame([("d1", "Ann", None), ("d2", "Bo", "bo")], "document_id string, author string, author_norm string")
    themes = spark.createDataFrame([("d1", "Water", None, "main"), ("d2", "Trade", "Water", None), ("d3", "Coal", None, None)], "document_id string, theme string, parent string, theme_group string").selectExpr("*", "'primary' AS theme_type", "null AS theme_path", "1 AS depth")
    tags = spark.createDataFrame([("d1", "Dam"), ("d2", "mill")], "document_id string, tag string")
    catalog = C.Catalog(docs, facet, themes, tags)
    page = T.list_records(catalog, C.Scope(bundle="a"), 100)
    assert page.cut and page.rows.count() == 100
    assert T.lookup_record(catalog, "report 007")[1] == "d7" and T.lookup_record(catalog, "report")[1] is None and T.lookup_record(catalog, "dry well")[1] is None
    assert [r.document_id for r in C.in_scope(catalog, C.Scope(tags_any=("DAM", "x"))).collect()] == ["d1"]
    assert {r.document_id for r in C.in_scope(catalog, C.Scope(authors_any=("ann", "BO"))).collect()} == {"d1", "d2"}
    assert C.in_scope(catalog, C.Scope(title_like="report 00%")).count() == 10
    with pytest.raises(ValueError):
        C.in_scope(C.Catalog(docs, facet, themes), C.Scope(tags_any=("a",)))
    assert {r.title: r.document_id for r in C.unique_titles(docs).collect()}["dry well"] is None
    assert T.applied(C.Scope(bundle="a")) == {"bundle": "a"} and T.is_guess(C.Scope(title_contains="q"), 0) and not T.is_guess(C.Scope(bundle="a"), 0)
    assert {(r.theme_group, r.theme) for r in T.themes_by_group(catalog).collect()} == {("main", "Water"), ("unclassified", "Coal")}
    assert T.project_fields(docs, ["title", "nope"]).columns == ["title"]
