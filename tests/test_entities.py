from pyspark.sql import functions as F

from quillmesh.functions import names as N
from quillmesh.functions import questions as Q
from quillmesh.operators import entities as E


def _frames(spark):
    m = spark.createDataFrame([("1", "PERSON", "ann weller"), ("2", "PERSON", "a w"), ("3", "PROJECT", "steel"), ("4", "PROJECT", "clean river basins"), ("5", "PERSON", "anna weller"), ("6", "ORGANIZATION", "riv inst"), ("7", "PERSON", "bo nagy"), ("8", "ORGANIZATION", "none such")], "mention_id string, type string, name string")
    e = spark.createDataFrame([("e1", "PERSON", "ann weller", "authoritative"), ("e2", "PROJECT", "steel", "derived"), ("e3", "PROJECT", "clean river basins", "authoritative"), ("e4", "ORGANIZATION", "river institute", "authoritative"), ("e5", "PERSON", "bo nagy", "derived"), ("e6", "PERSON", "bo nagy", "derived"), ("e7", "PERSON", "a w", "derived")], "entity_id string, type string, name string, trust string")
    al = spark.createDataFrame([("e4", "riv inst", True), ("e4", "riv inst", True)], "entity_id string, alias string, autolink boolean")
    said = spark.createDataFrame([("1", "PERSON", "ann weller"), ("7", "PERSON", "bo nagy")], "mention_id string, type string, name string")
    near = spark.createDataFrame([], "mention_id string, type string, name string")
    return m, e, al, said, near


def test_evidence_and_vetoes_decide(spark):
    m, e, al, said, near = _frames(spark)
    s = E.score(E.candidates(m, e, al), said, near)
    rows = {(r.mention_id, r.entity_id): r for r in s.collect()}
    assert abs(rows["1", "e1"].score - 1.0) < 1e-9 and rows["1", "e1"].corroborated
    assert rows["2", "e7"].vetoes == ["initials_only"] and rows["3", "e2"].vetoes == ["project_name_not_specific"] and rows["3", "e2"].score == 0
    assert rows["5", "e1"].source == "blocked" and rows["6", "e4"].source == "alias" and abs(rows["6", "e4"].score - 0.7) < 1e-9
    got = {r.mention_id: (r.decision, r.entity_id, r.candidates) for r in E.decide(s, m).collect()}
    assert got == {"1": ("auto", "e1", 1), "2": ("unresolved", None, 1), "3": ("unresolved", None, 1), "4": ("ambiguous", None, 1), "5": ("unresolved", None, 1), "6": ("ambiguous", None, 1), "7": ("ambiguous", None, 2), "8": ("unresolved", None, 0)}
    assert E.decide(s.limit(0), m.limit(0)).count() == 0


def test_promotion_gives_the_first_reason(spark):
    names = spark.createDataFrame([("ann weller", "d1", 2000, "x"), ("ann weller", "d2", 2030, "x"), ("a b", "d1", 2001, "x"), ("smith", "d1", 2001, "x"), ("bo nagy", "d1", 2001, "x"), ("bo nagy", "d1", 2001, "y"), ("cy vance", "d1", None, None), ("", "d1", 1, "x"), (None, "d1", 1, "x")], "name string, document_id string, year int, division string")
    surnames = spark.createDataFrame([("vance", 7)], "surname string, n long")
    got = {r.name: r.refusal for r in E.promotion(E.evidence(names), surnames, 5, 20).collect()}
    assert got == {"ann weller": "career_span", "a b": "initials_only", "smith": "single_word", "bo nagy": "several_divisions", "cy vance": "shared_surname"}


def test_names_of_organisations(spark):
    df = spark.createDataFrame([("River & Dam Ctr. Ltd",)], "t string")
    assert df.select(N.organisation(F.col("t"))).first()[0] == "river and dam centre limited"
    one = lambda c: df.select(c).first()[0]
    assert one(N.significant_initials(F.lit("institute of river research"))) == "irr"
    assert [one(N.acronym_fits(F.lit(a), F.lit("irr"))) for a in ("irr", "ir", "irrx", "rr", "ix")] == [True, True, True, True, False]
    assert one(N.unjoined(F.lit("A Ltd,B Inc, Goa"))) == ["A Ltd", "B Inc, Goa"]


def test_questions(spark):
    asked = ["Who is the head?", "What is the future of coal?", "Trade since 2010", None, " ", "Who was the former head now?", "State as of May"]
    df = spark.createDataFrame([(a,) for a in asked], "q string")
    assert [r[0] for r in df.select(Q.temporal_mode(F.col("q"))).collect()] == ["current", "none", "date_range", "none", "none", "past", "point_in_time"]
    assert df.select(Q.is_volatile(F.lit("the latest tariff")), Q.is_volatile(F.lit("old stone walls"))).first()[:] == (True, False)
    assert df.select(Q.key_terms(F.lit('the "dry well" of New Delhi and IRR in 2019'))).first()[0] == ["dry well", "New Delhi", "IRR", "2019"]
    score = lambda q, *t: round(df.select(Q.prefix_score(F.lit(q), F.array(*map(F.lit, t)))).first()[0], 6)
    assert score("water", "water") == 1.0 and score("water", "water", "trade") == 0.75 and score("env", "environment") == round(0.6 + 0.4 * 3 / 11, 6) and score("wa", "water") == 0.0
