from pyspark.sql import functions as F

from quillmesh.operators import ranking as K
from quillmesh.operators import records as Rec


def test_new_rows_are_inserted_once(spark):
    stored = spark.createDataFrame([("a", None, 1)], "k string, j string, v int")
    rows = spark.createDataFrame([("a", None, 9), ("b", None, 3), ("b", None, 2), (None, "x", 4)], "k string, j string, v int")
    once = Rec.insert_new(stored, rows, ["k", "j"])
    assert {tuple(r) for r in once.collect()} == {("a", None, 1), ("b", None, 2), (None, "x", 4)} == {tuple(r) for r in Rec.insert_new(once, rows, ["k", "j"]).collect()}
    assert Rec.insert_new(stored.limit(0), rows.limit(0), ["k", "j"]).count() == 0


def test_statuses_marks_and_caps(spark):
    s = spark.createDataFrame([("a", "error", True), ("b", "error", None), ("b", "ok", False), ("c", "skipped", False), ("d", "skipped", False), ("d", None, None)], "k string, outcome string, fatal boolean")
    assert {r.k: r.status for r in Rec.run_status(s, "k").collect()} == {"a": "failed", "b": "partial", "c": "skipped", "d": "ok"}
    m = spark.createDataFrame([("a", 3), ("a", None), ("a", 2), ("b", None)], "k string, m int")
    assert {r.k: r.m for r in Rec.first_marks(m, "k", "m").collect()} == {"a": 2, "b": None}
    d = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i int")
    assert sorted((r.k, r.i) for r in Rec.within_caps(d, "k", ["i"], 2, 3).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert [r.i for r in Rec.spread(d, "k", ["i"]).orderBy("round", "k").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [r[0] for r in spark.createDataFrame([("a", "a"), (None, "a"), ("a", None), ("a", "b"), (None, None)], "x string, y string").select(Rec.change_status(F.col("x"), F.col("y"))).collect()] == ["unchanged", "new", "removed", "changed", None]


def test_conflicts_of_linked_blocks(spark):
    rows = [(1, 1, "p", "website", None), (1, 2, "f", "pdf_attachment", "p"), (1, 3, "g", "pdf_attachment", "p"), (1, 4, "m", "manual", "p"), (1, 5, "p", "website", None), (2, 1, "p", "website", None)]
    b = spark.createDataFrame(rows, "q int, n int, document_id string, source_type string, linked string")
    assert {(r.a, r.b) for r in Rec.flag_conflicts(b, "q").collect()} == {(1, 4), (2, 3), (2, 4), (3, 4), (4, 5)}


def test_kinds_are_merged_with_reserved_places(spark):
    d = spark.createDataFrame([(1, i, "fact" if i < 5 else "passage", i) for i in range(1, 9)], "q int, id int, kind string, rank int")
    got = [r.id for r in K.merge_kinds(d, "q", "kind", {"fact": 2, "passage": 1}, 5).orderBy("position").collect()]
    assert got == [1, 2, 5, 3, 4]
