from quillmesh.llm import leakage
from quillmesh.llm.leakage import Index, words

PASSAGE = "every heron counts the brass lanterns twice before any ferry leaves, while the harbour clerk from Tolm writes seven numbers into a green ledger and closes the shutters"


def found(items, text):
    index = Index(items)
    return {items[i][0] for i, *_ in index.leaks(__import__("numpy").array([index.ids.get(w, 0) for w in words(text)]))}


def test_twelve_unchanged_words_count_whatever_follows():
    w = words(PASSAGE)
    # goes on with two longer words of the item at their places, six others changed
    after = [x if n in (5, 7) else f"zz{n}" for n, x in enumerate(w[12:20])]
    assert len([x for x in (after[5], after[7]) if len(x) > 3]) == 2
    assert found([(1, "passage", PASSAGE)], "so it was " + " ".join(w[:12] + after) + " indeed") == {1}


def test_a_changed_quotation_of_repeated_items_is_found():
    w = words(PASSAGE)
    text = "so it was " + " ".join([*w[:5], "zzz", *w[6:12]]) + " indeed"
    assert found([(1, "passage", PASSAGE)], text) == {1}
    assert found([(1, "passage", PASSAGE), (2, "passage", PASSAGE)], text) == {1, 2}


def test_blocks_know_runs_of_other_blocks(spark, monkeypatch):
    w = words(PASSAGE)
    changed = " ".join([*w[:5], "zzz", *w[6:12]])
    other = " ".join(w[:12]) + " yet nobody answers from across the water"
    docs = spark.createDataFrame([(1, "so it was " + changed + " indeed")], "doc_id long, text string")
    items = spark.createDataFrame([(n, None, t) for n, t in enumerate([PASSAGE, other, PASSAGE, other])], "item_id long, question string, passage string")
    got = []
    for size in (2_000, 1):
        monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", size)
        got.append({(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()})
    assert got[0] == got[1]
