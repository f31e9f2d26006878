import random

from quillmesh.llm.leakage import Index, leaks, myers, words

PASSAGE = "every heron counts the brass lanterns twice before any ferry leaves, while the harbour clerk from Tolm writes seven numbers into a green ledger and closes the shutters"


def plain(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        cur = [i]
        for j, y in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_equals_the_table():
    r = random.Random(1)
    for _ in range(2000):
        p = [r.randint(1, 4) for _ in range(r.randint(1, 20))]
        t = [r.randint(1, 4) for _ in range(r.randint(0, 40))]
        d, got = plain(p, t), myers(p, t, 5)
        assert got[0] == d if d <= 5 else got is None


def run(spark, texts, items=((1, None, PASSAGE), (2, "short question of few words", None))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks(docs, spark.createDataFrame(list(items), "item_id long, question string, passage string")).collect()}


def test_quotations_and_what_is_none(spark):
    w = words(PASSAGE)
    noise = "Costs of the sediment fell by half in May, which surprised nobody at all in this valley. "
    changed = w[:20].copy()
    changed[4], changed[9], changed[14] = "copper", "boat", "south"
    dense = w[:20].copy()
    for i in (1, 4, 7, 10, 13, 16):
        dense[i] = "zzz"
    texts = [
        noise + PASSAGE.upper().replace(" ", "\n", 6) + noise,  # 0 whole
        noise + " ".join(w[5:17]) + ". " + noise,  # 1 twelve words
        noise + " ".join(w[5:16]) + ". " + noise,  # 2 eleven
        noise + " ".join(changed) + " " + noise,  # 3 three of twenty
        noise + " ".join(dense) + " " + noise,  # 4 too many
        None, "", noise,  # 5-7
        noise * 300 + " ".join(w[3:18]) + noise * 300,  # 8 late in a long text
        noise + "every he​ron counts the brass lan­terns twice; before (any) ferry leaves - while the" + noise,  # 9 marks within words
        noise + "short question of few words" + noise,  # 10
    ]
    assert run(spark, texts) == {(0, 1), (1, 1), (3, 1), (8, 1), (9, 1)}


def test_sentence_built_alike_is_none(spark):
    item = (5, None, "only tanners holding a riparian velvet culvert token may touch whichever mirror busbar offsets tacitly past Arkeshi bridge")
    alike = "only wardens holding a riparian lattice culvert token may touch whichever mirror quadrat subsidises intermittently past Ashtirra bridge"
    assert run(spark, ["so it was. " + alike + " indeed"], [item]) == set()
    assert run(spark, ["so it was. " + item[2] + " indeed"], [item]) == {(0, 5)}


def test_random_edits_against_brute_force():
    r = random.Random(3)
    item = [f"w{i}" for i in range(60)]
    index = Index([(1, "passage", " ".join(item))])
    for _ in range(300):
        n = r.randint(8, 40)
        s = r.randint(0, 60 - n)
        q, k = item[s : s + n].copy(), r.randint(0, n // 3)
        for _ in range(k):
            i = r.randrange(len(q))
            q[i : i + 1] = r.choice([["x"], [], [q[i], "y"]])
        t = [f"n{i}" for i in range(30)] + q + [f"m{i}" for i in range(30)]
        held = any(plain(item[a : a + w], t) <= w // 5 for w in range(12, 24) for a in range(60 - w + 1))
        kept = [x for x in q if x in item]
        span = item.index(kept[-1]) - item.index(kept[0]) + 1
        whole = span >= 12 and plain(item[item.index(kept[0]) : item.index(kept[-1]) + 1], t) <= span // 5
        got = bool(index.leaks(__import__("numpy").array([index.ids.get(x, 0) for x in t])))
        if whole:
            assert got
        if not held:
            assert not got


def test_words_with_marks_inside():
    assert words("A sinking-fund, don’t\n- SINKINGFUND 3-4 x_y") == ["a", "sinkingfund", "dont", "sinkingfund", "34", "x", "y"]


def test_empty_tables_and_equal_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, question string, passage string")
    assert leaks(docs, items).count() == 0
    one = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert leaks(one, items).count() == 0
    assert leaks(one, spark.createDataFrame([(1, PASSAGE, None)], "item_id long, question string, passage string")).distinct().count() == 1
