import itertools
import random

from quillmesh.llm.names import SIMILARITY, collision, compare, edits, link_names, name_pairs, parse, tune

PEOPLE = {
    "anselm": ["Anselm M. Rapotubam", "Dr. Anselm Rapotubam", "RAPOTUBAM, Anselm", "Rapotubam, A. M.", "A. Rapotubam", "Anslem Rapotubam", "Anselm  Rapotubbam", "Rapotubam Anselm"],
    "beatriz": ["Beatriz Rapotubam"],
    "robert": ["Robert Ravoshushal", "Bob Ravoshushal", "Ravoshushal, R.", "Robert ravoshushal"],
    "jurgen": ["Jürgen Movosizeth", "Jurgen Movosizeth", "Juergen Movosizeth", "MOVOSIZETH, JÜRGEN"],
    "near": ["Ramón Trapinuduth"], "near2": ["Harsha Trapinudutr"],
    "org": ["Pazobilil Centre for Forest Management", "Centre for Forest Management, Pazobilil", "Pazobilil Ctr. Forest Mgmt.", "The Pazobilil Centre of Forest Management", "Pazobilil Centre for Forest Management (PCFM)", "Pazobilil Cenrte for Forest Management"],
    "org2": ["Pazobilil Foundation for Forest Management"], "org3": ["Pazobilil Centre for Energy Research"],
    "two": ["Theodore Lupush", "Ted Lupush"], "two2": ["Thomas Lupush", "Tom Lupush"],
    "unsure": ["T. Lupush"], "bare": ["Rapotubam"], "marks": ["---"], "marks2": ["?"],
}


def test_variants_are_linked_and_others_not(spark):
    rows = [(f"d{i}", v, "x") for i, v in enumerate(v for vs in PEOPLE.values() for j, v in enumerate(vs) for _ in range(5 if j == 0 else 2))] + [("d", None, "x"), ("d", " ", "x")]
    random.Random(2).shuffle(rows)
    got = {(r.author_a, r.author_b) for r in name_pairs(link_names(spark.createDataFrame(rows, "document_id string, author string, rows string"))).collect()}
    want = {tuple(sorted(p)) for vs in PEOPLE.values() for p in itertools.combinations(vs, 2)}
    assert got == want


def test_clusters_of_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("Ann Weller",)] * 3 + [("ann weller",), ("",)], "author string")
    got = {r.value: (r.cluster, r.rows) for r in link_names(df).collect()}
    assert got["Ann Weller"][1] == 3 and got["Ann Weller"][0] == got["ann weller"][0] != got[""][0]
    assert link_names(df.limit(0)).count() == 0


def test_edits_are_single_errors():
    assert [edits("abcd", x) for x in ("abcd", "abd", "abccd", "abdc", "abxd", "bacd", "dbca", "abcdxy")] == [0, 1, 1, 1, 1, 1, 2, 2]


def test_parse_and_compare():
    assert parse("Prof. Ørsted, H. C.") == (["orsted"], [], ["h", "c"])
    assert compare(parse("William Fovod"), parse("W.T. Fovod"))[0] > 0.9
    assert compare(parse("William K. Fovod"), parse("W.T. Fovod"))[0] == 0
    assert compare(parse("Fovod"), parse("W. Fovod"))[0] == 0
    assert compare(parse("Susan Fovod"), parse("Fovod"))[0] == 0


def test_banding_follows_the_collision_curve():
    rows, bands = tune()
    assert collision(SIMILARITY, rows, bands) >= 0.998 and collision(0.1, rows, bands) < 0.1


def test_long_names(spark):
    long = "Centre for " + " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300))
    got = link_names(spark.createDataFrame([(long,), (long.upper(),), (long.replace("Wordaax", "Wordaxa"),)], "author string")).collect()
    assert len({r.cluster for r in got}) == 1
