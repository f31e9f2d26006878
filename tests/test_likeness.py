import difflib
import random

import pytest

from quillmesh.operators import likeness as L


def _plain(x, y):
    return round(max(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in ((x, y), (L.ordered(x), L.ordered(y)))), 6)


def _pairs(texts, asked):
    return {(t, a): s for t in texts for a in asked if L._words(t) & L._words(a) and (s := _plain(a, t)) >= 0.6}


def _texts(rng, n):
    words = ["annual", "water", "waters", "report", "basin", "reporting", "in", "of", "2004", "2005", "aaaa", "aaab", "abab", "a"]
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))[:64].strip() for _ in range(n)})


ODD = ["", "water", "wat er", "aaaa" * 16, "aaaa " * 12 + "aaaa", "a" * 59 + " aaaa", "a" * 60 + " aaaa", "water " * 30 + "report", "water  report", "waterñ report", "Water report water", "नदी water"]


def test_blocks_are_those_of_difflib_and_folded_texts_need_no_call_of_it(monkeypatch):
    rng = random.Random(7)
    texts, asked = _texts(rng, 400), _texts(rng, 150)
    want = _pairs(texts, asked)
    monkeypatch.setattr(L.difflib, "SequenceMatcher", lambda *a, **k: pytest.fail("a pair was compared by itself"))
    got = [(texts[i], asked[k], s) for parts in L.Asked(asked, 0.6).like(texts) for i, k, s in zip(*parts)]
    assert len(got) == len(want) > 1000 and {(t, a): s for t, a, s in got} == want


def test_odd_and_long_texts_are_compared_too():
    rng = random.Random(8)
    texts = sorted({*_texts(rng, 40), *ODD})
    got = [(texts[i], texts[k], s) for parts in L.Asked(texts, 0.6).like(texts) for i, k, s in zip(*parts)]
    want = _pairs(texts, texts)
    assert len(got) == len(want) and {(t, a): s for t, a, s in got} == want and sum(len(t) > 64 for t, _ in want) > 2


def test_blocks_of_asked_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "ASKED_PER_BLOCK", 7)
    rng = random.Random(9)
    texts, asked = _texts(rng, 60) + ODD, sorted({*_texts(rng, 30), *ODD})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:5], None])], "id long, f string")
    got = [(r.id, r.asked, r.score) for r in L.like_texts(rows, spark.createDataFrame([(a,) for a in asked], "asked string"), "f").collect()]
    of = dict(enumerate([*texts, *texts[:5]]))
    want = _pairs(texts, asked)
    assert sorted(got) == sorted((i, a, s) for (t, a), s in want.items() for i, x in of.items() if x == t)
    none = spark.createDataFrame([], "asked string")
    assert L.like_texts(rows, none, "f").collect() == []


def test_fuzzy_titles_compares_no_pair_by_itself_and_on_all_cores(spark):
    from quillmesh.plans.upkeep import fuzzy_titles

    got = fuzzy_titles(spark, "/root/testdata/sf0.01")
    plan = got._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert got.count() == got.distinct().count() == 522
