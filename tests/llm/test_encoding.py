import pytest
from pyspark.sql import functions as F

from quillmesh.llm.encoding import byte_table, decode, encode, encoder, vocabulary

TEXTS = [
    None, "", " ", "\n\n  x", "It's <|endoftext|> I'll  go\t 12,345 kWh…", "किसानों ने कहा 🙂🙃 नहर", "naïve café ﬁshers ​ zero", "a" * 3000, "\r\n | 1 | 2 |\n", "don’t 'S 'll",
    "\u0000� mixed space end  ", "x" + " " * 500 + "y",
]


@pytest.fixture(scope="module")
def encoded(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    return encode(df, offsets=True).orderBy("id").collect()


def test_same_as_the_library_on_whole_texts(encoded):
    t = encoder(vocabulary()).tokenizer
    for r in encoded:
        e = t.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids
        assert list(zip(r.starts, r.ends)) == e.offsets


def test_decoding_gives_the_text_back(spark, encoded):
    df = spark.createDataFrame([(r.id, r.ids) for r in encoded] + [(99, None)], "id int, ids array<int>")
    got = {r.id: r.decoded for r in decode(df).collect()}
    assert got.pop(99) is None
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_split_character_and_special_token(spark):
    ids = encoder(vocabulary()).tokenizer.encode("🙃", add_special_tokens=False).ids
    assert len(ids) > 1
    got = decode(spark.createDataFrame([(1, ids), (2, ids[:1]), (3, [50256])], "id int, ids array<int>")).orderBy("id").collect()
    assert got[0].decoded == "🙃" and set(got[1].decoded) == {"�"} and got[2].decoded == "<|endoftext|>"


def test_clashing_and_further_columns(spark):
    df = spark.createDataFrame([(7, "a b", "old")], "ids int, text string, starts string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert encode(df).columns == ["text", "starts", "m", "ids"]
    assert encode(df.limit(0)).count() == 0


def test_byte_table_covers_all_bytes():
    assert sorted(byte_table().values()) == list(range(256))
