from quillmesh.llm.scans import Repair


def test_misread_words_do_not_depend_on_the_size_of_the_corpus(spark):
    empty = spark.createDataFrame([], "record_id string, field string, text string, hints array<string>")
    # word, times, times in running text, times in texts without a sign of a scan
    counts = [
        ("harbour", 900_000, 900_000, 500_000), ("reservoir", 60_000, 60_000, 30_000), ("of", 50_000, 50_000, 25_000),
        ("rescrvoir", 3, 3, 2), ("harbovr", 3, 3, 2), ("hcrbour", 3, 3, 2), ("barbour", 150, 150, 100), ("rcscrvoir", 40, 40, 0), ("0f", 20, 20, 10),
    ]
    got = []
    for times in (1, 100):
        r = Repair(empty, texts=False)
        r.words = spark.createDataFrame([(w, *(x * times for x in n)) for w, *n in counts], "word string, n long, n_running long, n_clean long")
        got.append({(x.word, x.meant) for x in r._misread(r.words).collect()})
    assert got[0] == got[1]
    assert {("rescrvoir", "reservoir"), ("barbour", "harbour"), ("rcscrvoir", "reservoir"), ("0f", "of")} <= got[1]
