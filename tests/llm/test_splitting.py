import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm.splitting import split_characters, split_chunks, split_texts

TOKEN = re.compile(r"[^ \t\r\n]+")


def pieces(spark, rows, schema="id int, text string, n int, lap int"):
    return split_texts(spark.createDataFrame(rows, schema), "text", "n", "lap").orderBy("id", "piece_index").collect()


def check(text, n, lap, got):
    tokens = TOKEN.findall(text)
    if len(tokens) <= n:
        assert [g.piece_text for g in got] == [text]
        return
    lap = min(lap, n - 1)
    seen = []
    for i, g in enumerate(got):
        t = TOKEN.findall(g.piece_text)
        assert len(t) == g.piece_tokens <= n and g.pieces == len(got) and g.piece_index == i
        assert g.piece_text in text
        back = min(lap, len(seen)) if i else 0
        assert t[:back] == (seen[-back:] if back else [])
        seen += t[back:]
    assert seen == tokens


def test_random_texts_keep_limit_overlap_and_all_tokens(spark):
    import random

    r = random.Random(5)
    rows = []
    for i in range(300):
        words = [r.choice(["a", "bb.", "ccc", "- d", "|", "e!", "fé", "गाँव।", "x" * 50]) + r.choice([" ", " ", "  ", "\n", "\n\n", "\t", " \r\n"]) for _ in range(r.randint(0, 120))]
        rows.append((i, r.choice(["", " ", "\n"]) + "".join(words), r.randint(1, 30), r.randint(0, 12)))
    got = {}
    for p in pieces(spark, rows):
        got.setdefault(p.id, []).append(p)
    for i, t, n, lap in rows:
        check(t, n, lap, got[i])


def test_cuts_at_the_strongest_boundary(spark):
    para = "one two three four. five six\n\nseven eight. nine ten eleven twelve"
    assert [p.piece_text for p in pieces(spark, [(1, para, 8, 0)])] == ["one two three four. five six", "seven eight. nine ten eleven twelve"]
    sentence = "one two three four. five six seven eight nine ten"
    assert [p.piece_text for p in pieces(spark, [(1, sentence, 6, 0)])] == ["one two three four.", "five six seven eight nine ten"]
    rows = "| a | b |\n| c | d |\n| e | f |"
    assert [p.piece_text for p in pieces(spark, [(1, rows, 11, 0)])] == ["| a | b |\n| c | d |", "| e | f |"]
    assert [p.piece_text for p in pieces(spark, [(1, "a b c d e", 2, 1)])] == ["a b", "b c", "c d", "d e"]


def test_nulls_empty_and_long(spark):
    got = pieces(spark, [(1, None, 5, 1), (2, "", 5, 1), (3, "a b", None, 1), (4, "a b c", 0, 0), (5, "w " * 20000, 2000, 100), (6, "a b c", 2, None)])
    by = {}
    for g in got:
        by.setdefault(g.id, []).append(g)
    assert by[1][0].piece_text is None and by[2][0].piece_text == "" and by[3][0].piece_text == "a b" and by[4][0].piece_text == "a b c"
    assert all(g.piece_tokens <= 2000 for g in by[5]) and len(by[5]) == 11
    assert [g.piece_text for g in by[6]] == ["a b", "c"]
    assert split_texts(spark.createDataFrame([], "text string, n int, lap int, pieces int"), "text", "n", "lap").count() == 0


@pytest.mark.parametrize("limit,lap", [(10, 0), (10, 3), (7, 20)])
def test_characters(spark, limit, lap):
    text = "Kurz. Ein Satz!\n\nNoch einer, länger als zehn. " + "x" * 25
    got = spark.range(1).select(F.lit(text).alias("t")).select(split_characters(F.col("t"), limit, lap)).first()[0]
    lap = min(lap, limit - 1)
    out = got[0]
    for g in got[1:]:
        k = min(lap, len(out))
        assert g[:k] == out[len(out) - k:]
        out += g[k:]
    assert out == text and all(len(g) <= limit for g in got)


def test_current_rows_presets_and_pages(spark):
    schema = "chunk_id string, bundle string, text string, page_number int, page_range struct<page_start:int,page_end:int>, indexed_at timestamp_ntz, token_count int"
    import datetime as dt

    d = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("a", "news", "1 2 3 4 5", 9, (7, 4), d(2), 1), ("a", "news", "1 2", 9, (7, 4), d(1), 1), ("a", "news", "1 2 3 4 5", 9, (7, 4), d(2), 1),
        ("b", "odd", "1 2 3", 3, None, d(1), None), ("c", None, "1 2 3", None, (None, 5), d(1), 900), ("d", "news", "1 2 3 4 5", 1, None, d(1), 1), ("d", "news", "1 2", 1, None, d(2), 1),
    ]
    presets = spark.createDataFrame([("default", 2, 1), ("news", 3, 1)], "preset string, child_max_tokens int, child_overlap_tokens int")
    got = split_chunks(spark.createDataFrame(rows, schema), presets).orderBy("chunk_id", "piece_index").collect()
    assert [(g.chunk_id, g.text, tuple(g.page_range)) for g in got] == [
        ("a", "1 2 3", (4, 7)), ("a", "3 4 5", (4, 7)), ("b", "1 2", (3, 3)), ("b", "2 3", (3, 3)), ("c", "1 2", (5, 5)), ("c", "2 3", (5, 5))]


@settings(max_examples=5, deadline=None)
@given(st.text(alphabet="ab. \n|-", max_size=200), st.integers(1, 9), st.integers(0, 4))
def test_any_text(spark, text, n, lap):
    check(text, n, lap, pieces(spark, [(1, text, n, lap)]))
