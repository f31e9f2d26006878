import pytest

from quillmesh.llm.scans import Repair, corrections, page_furniture, table_furniture

PAGE = """ANNUAL ENERGY REPORT 2O19
Neither the biomass nor the floodplain was seen in the wet sea-
son. The team from Oslo measured the boiler twice, and the bo-

- 22 -
Harrow Forestry Papers
iler had dried. About 30 MWh of cost-
effective gas were used by tbe harbour and its people in May.
- 23 -

ANNUAL ENERGY REPORT 2019
The harb­
our was measured by the team in 2o18. A well-
being plan is not there. Every harbour has a boiler
- 24 -
"""
CLEAN = "The harbour was cost-effective and the boiler of the season is not the harbour of the well-being team. " * 30
TABLE = """| Harbour | Boiler |
| --- | --- |
| The sea­<br>son | 7l3 |
| cost-<br>effective | 12 |
| Harbour | Boiler |
|  25  |
| Tbe team | 4 |"""


@pytest.fixture(scope="module")
def repair(spark):
    rows = [("a", "front_text", PAGE, []), ("a", "front_text", PAGE, []), ("b", "front_text", CLEAN, []), ("t", "markdown", TABLE, []), ("n", "head_text", None, []), ("e", "head_text", " ", None), ("h", "head_text", PAGE[:150], None)]
    return Repair(spark.createDataFrame(rows, "record_id string, field string, text string, hints array<string>"))


def test_kinds_by_line(repair):
    got = {(r.record_id, r.line_no, r.kind) for r in repair.found().collect() if r.record_id in "at"}
    assert repair.found().count() == repair.found().distinct().count()
    assert {n for r, n, k in got if r == "a" and k == "furniture"} == {1, 5, 6, 9, 11, 15}
    assert {n for r, n, k in got if r == "a" and k == "hyphen"} == {2, 3, 12}
    assert {n for r, n, k in got if r == "a" and k == "misread"} == {8, 13}
    assert {x for x in got if x[0] == "t"} == {("t", 3, "hyphen"), ("t", 3, "misread"), ("t", 5, "furniture"), ("t", 6, "furniture"), ("t", 7, "misread")}


def test_repaired_text(repair):
    got = {r.record_id: r.repaired for r in repair.repaired().collect()}
    assert got["a"] == ("Neither the biomass nor the floodplain was seen in the wet season. The team from Oslo measured the boiler twice, and the boiler had dried. "
                        "About 30 MWh of cost-effective gas were used by the harbour and its people in May.\n\n"
                        "The harbour was measured by the team in 2018. A well-being plan is not there. Every harbour has a boiler")
    assert got["t"] == "| Harbour | Boiler |\n| --- | --- |\n| The season | 713 |\n| cost-effective | 12 |\n| The team | 4 |"
    assert got["b"] == CLEAN.strip() and "n" not in got and "e" not in got


def test_cells_of_letters_only(spark):
    t = "| l | S | s |\n|---|---|---|\n| a | Z | l |\n| l | 5 | m |\n| b | lO | s |\n| b | 77 | s |\n| b | 78 | 9 |"
    r = Repair(spark.createDataFrame([("t", "markdown", t, [])], "record_id string, field string, text string, hints array<string>"))
    assert {(x.line_no, x.kind) for x in r.found().collect()} == {(3, "misread"), (5, "misread")}
    assert "| a | 2 |" in r.repaired().first().repaired and "| b | 10 |" in r.repaired().first().repaired


def test_empty_tables(spark):
    r = Repair(spark.createDataFrame([], "record_id string, field string, text string, hints array<string>"))
    assert r.found().count() == 0 and r.repaired().count() == 0


def test_furniture_of_pages_and_tables():
    body = ["The valve of the old pump was not seen by anyone in the town", "that year."]
    assert page_furniture(body, []) == set()
    more = ["Costs of dry wells in the north fell by half, which nobody", "had expected."]
    assert page_furniture([*body, "ix", *more, "x"], []) == {2, 5}
    assert page_furniture([*body, "Old pumps    7", *more, "8    Old pumps"], []) == {2, 5}
    assert page_furniture([*body, "2018.", *more], []) == set()
    assert page_furniture(["Old pumps of Oslo", *more], []) == {0} and page_furniture(["OLD PUMPS OF THE TOWN OF OSLO AND OF ITS NORTH, 2019 TO 2020", *more], []) == {0}
    assert page_furniture([*more, *body], []) == set()
    assert table_furniture(["| a | b |", "|---|---|", "| 3 | 4 |", "| 17 |"]) == {3}
    assert table_furniture([]) == set() and table_furniture(["no table"]) == set()


def test_corrections():
    assert "other" in corrections("otber") and "june" in corrections("jiine") and "modern" in corrections("rnodern") and "the" not in corrections("the")


def test_long_text(spark):
    import random
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubdgkmnprst") for _ in range(7))
    text = "\n".join(f"The {word()} {word()} was measured by the {word()} and the sea-\nson was dry in the {word()} of the {word()}.\n- {i} -\n\nHarbour Papers" for i in range(1, 3000))
    got = Repair(spark.createDataFrame([("x", "front_text", text, None)], "record_id string, field string, text string, hints array<string>")).found()
    kinds = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    assert kinds["hyphen"] == 2999 and kinds["furniture"] == 2 * 2999
