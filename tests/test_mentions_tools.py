import datetime as dt

import pytest

from quillmesh.operators import catalog as C
from quillmesh.operators import mentions as M
from quillmesh.operators import tools as T


def test_spans_and_the_longest(spark):
    docs = spark.createDataFrame([(1, "The Old Water-Mill and the water mill; OLD water."), (2, None), (3, ""), (4, "x " * 20_000 + "old water mill")], "id int, text string")
    names = spark.createDataFrame([("water mill", "a"), ("Old water mill", "b"), ("old", "c"), ("water", "d"), ("Water!", "e"), (None, "f"), (" ", "g"), ("one two three four five six seven", "h")], "name string, kind string")
    found = M.spans(docs, "id", "text", names)
    got = {(r.id, r.start, r.length, r.name) for r in M.outermost(found, "id").collect()}
    assert got == {(1, 1, 3, "Old water mill"), (1, 6, 2, "water mill"), (1, 8, 1, "old"), (1, 9, 1, "water"), (1, 9, 1, "Water!"), (4, 20_000, 3, "Old water mill")}
    assert M.outermost(M.spans(docs, "id", "text", names.limit(0)), "id").count() == 0 and M.spans(docs.limit(0), "id", "text", names).count() == 0


@pytest.fixture(scope="module")
def catalog(spark):
    docs = spark.createDataFrame([(f"{i:03d}", f"Title {i}", f"b{i % 30}", "website", dt.date(2000 + i % 5, 1, 1)) for i in range(120)], "document_id string, title string, bundle string, source_type string, effective_start_date date")
    authors = spark.createDataFrame([("001", "A", "a")], "document_id string, author string, author_norm string")
    themes = spark.createDataFrame([("001", "T", "main")], "document_id string, theme string, theme_group string")
    return C.Catalog(docs, authors, themes)


def test_tools(catalog):
    assert T.count_records(catalog, C.Scope()).rows.first()[0] == 120 and T.count_records(catalog, C.Scope(), "year").rows.first()[0] == 5
    assert T.count_records(catalog, C.Scope(), "colour").outcome == "refused"
    miss = T.count_records(catalog, C.Scope(author="nobody", theme="none"))
    assert miss.outcome == "miss" and miss.missed == ("author", "theme") and miss.rows is None
    page = T.list_records(catalog, C.Scope(bundle="b3"), limit=3)
    assert page.cut and page.rows.count() == 3 and not T.list_records(catalog, C.Scope(bundle="b3"), limit=4).cut
    zero = T.count_records(catalog, C.Scope(bundle="b3", effective_from="2020-01-01"))
    assert zero.outcome == "ok" and zero.rows.first()[0] == 0
    by = T.aggregate_records(catalog, C.Scope(), "bundle")
    assert by.cut and by.rows.count() == 20 and [r.key for r in T.aggregate_records(catalog, C.Scope(), "year").rows.collect()] == ["2000", "2001", "2002", "2003", "2004"]
    assert T.aggregate_records(catalog, C.Scope(), "bundle", "year").rows.count() == 30 and T.aggregate_records(catalog, C.Scope(), "bundle", "x").outcome == "refused"


def test_sketch_and_fuzzy_scores(spark):
    import difflib

    import pandas as pd
    from pyspark.sql import functions as F

    from quillmesh.plans.passages import approx_distinct
    from quillmesh.plans.upkeep import _ratio

    sf = "/root/testdata/sf0.01"
    exact = {r.event_type: r.n for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).collect()}
    got = {r.event_type: r.users for r in approx_distinct(spark, sf).collect()}
    assert set(got) == set(exact) and all(abs(got[k] - exact[k]) <= 0.06 * exact[k] for k in exact)
    s = _ratio(pd.Series(["water report", "b a", None]), pd.Series(["water reports", "a b", "x"]))
    assert s[0] == round(difflib.SequenceMatcher(None, "water report", "water reports").ratio(), 6) and s[1] == 1.0 and s[2] == 0.0
