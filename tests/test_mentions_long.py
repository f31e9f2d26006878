from quillmesh.operators import mentions as M


def test_names_of_any_length_are_found(spark):
    long = " ".join(f"w{i}" for i in range(40))
    seven = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"so {seven}, and {long}."), (2, "one two")], "id int, text string")
    names = spark.createDataFrame([(seven, "a"), (long, "b"), ("two three", "c")], "name string, kind string")
    got = {(r.id, r.start, r.length) for r in M.spans(docs, "id", "text", names).collect()}
    assert got == {(1, 1, 7), (1, 2, 2), (1, 9, 40)}
