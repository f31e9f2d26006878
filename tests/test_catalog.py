import datetime as dt

import pytest

from quillmesh.operators import catalog as C
from quillmesh.operators import changes as K

D = dt.date


@pytest.fixture(scope="module")
def catalog(spark):
    docs = spark.createDataFrame([
        ("1", "Water 100% pure_x", "news", "website", D(2020, 1, 1)), ("2", "Energy and water", "news", "website", D(2021, 1, 1)), ("3", None, None, "manual", None),
        ("4", "Pilot", "report", "website", D(2021, 12, 31))], "document_id string, title string, bundle string, source_type string, effective_start_date date")
    authors = spark.createDataFrame([("1", "A. B", "a b"), ("1", "A. B", "a b"), ("2", "A B", None), ("2", "C", "c"), ("9", "C", "c")], "document_id string, author string, author_norm string")
    themes = spark.createDataFrame([("1", "T", "primary", None, "main", None, 1), ("1", "T", "primary", None, "main", None, 1), ("1", "U", "sub", "T", "main", "T > U", 2), ("2", "T", "primary", "P", "other", None, 1), ("4", "T", "primary", "P", "other", None, 1)],
                                   "document_id string, theme string, theme_type string, parent string, theme_group string, theme_path string, depth int")
    return C.Catalog(docs, authors, themes)


def ids(df):
    return [r.document_id for r in df.collect()]


def test_scope(catalog):
    n = lambda **k: sorted(ids(C.in_scope(catalog, C.Scope(**k))))
    assert n() == ["1", "2", "3", "4"] and n(theme="t") == ["1", "2", "4"] and n(theme_group="main") == ["1"] and n(author="A B") == ["1", "2"]
    assert n(title_contains="100%") == ["1"] and n(title_contains="e_x") == ["1"] and n(title_contains="a_d") == []
    assert n(effective_from="2021-01-01", effective_to="2021-12-31") == ["2"] and n(topic_terms=("water", "pilot")) == ["1", "2", "4"]


def test_counts_agree_with_lists_and_breakdowns(catalog):
    s = C.Scope(source_type="website", theme="T")
    assert C.count_documents(catalog, s).first()[0] == len(ids(C.list_documents(catalog, s))) == 3
    assert {tuple(r) for r in C.distribution(catalog, s, "bundle").collect()} == {("news", 2), ("report", 1)}
    assert {tuple(r) for r in C.distribution(catalog, C.Scope(), "author").collect()} == {("a b", 1), ("A B", 1), ("c", 1)}
    assert {tuple(r) for r in C.cross_distribution(catalog, C.Scope(), "theme", "author").collect()} == {("T", "a b", 1), ("U", "a b", 1), ("T", "A B", 1), ("T", "c", 1)}
    assert C.count_distinct_values(catalog, C.Scope(), "year").first()[0] == 2
    with pytest.raises(ValueError):
        C.distribution(catalog, s, "colour")


def test_missing_keys_take_a_place_of_the_limit(catalog):
    assert C.distribution(catalog, C.Scope(source_type="manual"), "bundle", limit=1).count() == 0


def test_order_and_pages(catalog):
    assert ids(C.list_documents(catalog, C.Scope(topic_terms=("water", "energy")))) == ["2", "1"]
    assert ids(C.list_documents(catalog, C.Scope(), limit=2, offset=1)) == ["2", "1"] and ids(C.list_documents(catalog, C.Scope(), limit=0)) == ["4"]


def test_variants_and_facets(catalog, spark):
    best = {r.theme: (r.parent, r.documents) for r in C.best_variants(catalog.themes).collect()}
    assert best == {"T": ("P", 2), "U": ("T", 1)}
    got = {r.document_id: (r.authors, r.themes) for r in C.facet_lists(catalog, spark.createDataFrame([("1",), ("3",)], "document_id string")).collect()}
    assert got == {"1": (["A. B"], ["T"]), "3": ([], [])}


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("1", "x", "5"), ("2", "x", None), ("3", None, "5"), ("4", "x", "4")], "k string, f string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None), ("5", "x")], "k string, f string")
    got = {r.k: (r.status, r.stale) for r in K.snapshot_diff(a, b, "k", "f", "v", "5").collect()}
    assert got == {"1": ("UNCHANGED", False), "2": ("CHANGED", True), "3": ("UNCHANGED", False), "4": ("DELETED", True), "5": ("NEW", False)}
    assert K.snapshot_diff(a.limit(0), b.limit(0), "k", "f").count() == 0


def test_deletions_at_the_limit(spark):
    d = spark.createDataFrame([("g", "DELETED")] * 2 + [("g", "UNCHANGED")] * 8 + [("h", "DELETED")] * 3 + [("h", "UNCHANGED")] * 7 + [("i", "NEW")], "b string, status string")
    assert {r.b: r.plausible for r in K.plausible_deletions(d, "b", 0.2, 1).collect()} == {"g": True, "h": False, "i": True}


def test_merge_policies(spark):
    old = spark.createDataFrame([("1", "a", "a", "a", "a"), ("2", None, None, "a", "a"), ("3", "a", "a", "a", "a")], "k string, o string, p string, q string, r string")
    new = spark.createDataFrame([("1", "b", "b", None, "b"), ("2", None, "b", "b", "b"), ("4", "b", "b", "b", "b")], "k string, o string, p string, q string, r string")
    got = {r.k: tuple(r)[1:] for r in K.merge_rows(old, new, "k", {"o": "overwrite", "p": "keep", "q": "fill"}).collect()}
    assert got == {"1": ("b", "a", "a", "a"), "2": (None, "b", "b", "a"), "3": ("a",) * 4, "4": ("b",) * 4}


def test_facets_and_keys(spark):
    f = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "k string, v string")
    new = spark.createDataFrame([("1", "c"), ("1", "c")], "k string, v string")
    touched = spark.createDataFrame([("1",), ("3",)], "k string")
    assert {tuple(r) for r in K.replace_facet(f, new, touched, "k").collect()} == {("1", "c"), ("2", "a")}
    assert sorted(map(tuple, K.rename_value(f, "v", "a", "b").collect())) == [("1", "b"), ("2", "b")]
    assert [tuple(r) for r in K.delete_keys(f, touched, "k").collect()] == [("2", "a")]


def test_attempts(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "x", 2, t), ("2", "x", 5, t), ("3", "x", 1, t)], "k string, f string, attempts long, first_seen timestamp_ntz")
    new = spark.createDataFrame([("1", "x", t + dt.timedelta(1)), ("2", "y", t + dt.timedelta(2)), ("4", "z", t + dt.timedelta(3)), ("4", "z", t + dt.timedelta(4))], "k string, f string, ts timestamp_ntz")
    got = {r.k: (r.f, r.attempts, r.first_seen.day) for r in K.attempts(old, new, "k", "f", "ts").collect()}
    assert got == {"1": ("x", 3, 1), "2": ("y", 1, 3), "3": ("x", 1, 1), "4": ("z", 2, 4)}
