import datetime as dt

from pyspark.sql import functions as F

from quillmesh.operators.differences import differences, latest, plain_number, plain_text, plain_version, uuid_key

F1, F2 = "f", "g"


def diff(spark, a, b):
    schema = "k string, f string, g string"
    d = differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", [F1, F2], "left", "right")
    return {(r.k, r.difference, r.left_value, r.right_value) for r in d.collect()}


def test_missing_and_differing(spark):
    a = [("1", "x", "y"), ("2", "x", None), ("3", "x", "y"), ("5", None, None)]
    b = [("1", "x", "y"), ("2", "x", "y"), ("4", "x", "y"), ("5", None, None)]
    assert diff(spark, a, b) == {("2", "g", None, "y"), ("3", "missing_in_right", None, None), ("4", "missing_in_left", None, None)}


def test_rows_of_nulls_differ_from_missing_rows(spark):
    assert diff(spark, [("1", None, None)], [("1", "x", None)]) == {("1", "f", None, "x")}


def test_empty_sides(spark):
    assert diff(spark, [], []) == set()
    assert diff(spark, [("1", "x", "y")], []) == {("1", "missing_in_right", None, None)}


def test_latest_ties_nulls_and_repeats(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "1", None), ("a", t, "2", None), ("a", None, "9", "9"), ("b", None, "1", "1"), ("b", None, "1", "1"), (None, t, "1", "1")]
    df = spark.createDataFrame(rows, "k string, v timestamp_ntz, f string, g string").withColumn("extra", F.lit(1))
    assert {tuple(r) for r in latest(df, "k", [F1, F2], "v").collect()} == {("a", "2", None), ("b", "1", "1")}


def test_plain_forms(spark):
    rows = [(" V4.12.0 ",), ("v2",), ("2.0",), ("",), (" ",), (None,), ("007",), ("abc",), ("1e3",), ("V",)]
    d = spark.createDataFrame(rows, "v string").select(plain_text(F.col("v")).alias("t"), plain_version(F.col("v")).alias("w"), plain_number(F.col("v")).alias("n"))
    got = [tuple(r) for r in d.collect()]
    assert got == [("v4.12.0", "4.12.0", "4.12.0"), ("v2", "2", "2"), ("2.0", "2.0", "2"), (None,) * 3, (None,) * 3, (None,) * 3, ("007", "007", "7"), ("abc",) * 3, ("1e3",) * 3, ("v", None, None)]


def test_uuid_key(spark):
    rows = [(" 0CC6EE4E569A0A705D5465F95F7586D7 ",), ("0cc6ee4e-569a-0a70-5d54-65f95f7586d7",), ("Ab-1",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(uuid_key(F.col("v"))).collect()]
    assert got == ["0cc6ee4e-569a-0a70-5d54-65f95f7586d7"] * 2 + ["ab1", None, None]


def test_long_values(spark):
    x = "a" * 200_000
    assert diff(spark, [("1", x, None)], [("1", x + "b", None)]) == {("1", "f", x, x + "b")}
