from pyspark.sql import functions as F

from quillmesh.functions import phrases as P


def one(spark, col, v):
    return spark.createDataFrame([(v,)], "v string").select(col).first()[0]


def test_editions(spark):
    c = P.editions(F.col("v"))
    assert one(spark, c, "Report 2024-25 and 2023–2024, 1999/2000, 2024-25") == ["2024-25", "2023-24", "1999-00"]
    assert one(spark, c, "2019-23, 2020-2019, 20245-26, P-2019-20-7, 12024-25") == [] and one(spark, c, "") == [] and one(spark, c, None) is None
    assert one(spark, P.edition_end(F.col("v")), "1999-00") == 2000


def test_windows(spark):
    cases = {"work between 2001 and 2003": ("between", "2001-01-01", "2004-01-01"), "from 2001 to 2001": ("range", "2001-01-01", "2002-01-01"), "Since 2009 it": ("since", "2009-01-01", "None"), "before 2010": ("before", "None", "2010-01-01"),
             "until 2010": ("until", "None", "2011-01-01"), "in May 2012": ("in", "2012-01-01", "2013-01-01"), "since 2009, between 2001 and 2003": ("between", "2001-01-01", "2004-01-01"), "between 2005 and 2001": None, "no year": None, "": None}
    for v, want in cases.items():
        r = one(spark, P.window_of(F.col("v")), v)
        assert (r and (r.basis, str(r.start), str(r.end))) == want, v


def test_people(spark):
    cases = {"By Ann Lee, Bo Ek and C. Du": ["Ann Lee", "Bo Ek", "C. Du"], "Lee, A. B., Ek, B.; Du C": ["Lee, A. B.", "Ek, B.", "Du C"], "Sandy Anders & Andy": ["Sandy Anders", "Andy"], "": [], " ; ": []}
    for v, want in cases.items():
        assert one(spark, P.people_of(F.col("v")), v) == want, v


def test_blocks_sections_pack(spark):
    text = "Intro text here.\n\nFirst heading\n\nA sentence.\n\n- one\n- two\n\n| a | b |\n\nTop\n\nSub\n\nMore. \n \n"
    assert [b.kind for b in one(spark, P.blocks(F.col("v")), text)] == ["text", "heading", "text", "list", "table", "heading", "heading", "text"]
    s = [(x.heading, x.blocks, x.chars) for x in one(spark, P.sections(F.col("v")), text)]
    assert s == [(None, 1, 16), ("First heading", 3, 11 + 11 + 9), ("Top", 0, 0), ("Sub", 1, 5)]
    assert one(spark, P.sections(F.col("v")), "") == [] and one(spark, P.sections(F.col("v")), None) is None
    assert spark.range(1).select(P.pack(F.array(*map(F.lit, [5, 4, 2, 50, 1])), 10)).first()[0] == [0, 0, 1, 2, 3]
