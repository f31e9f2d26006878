import uuid

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import structure as S
from quillmesh.operators import graph as G


def test_ids_are_those_of_the_standard_library(spark):
    names = ["", "a|b|c|0", "é › ü", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(S.NAMESPACE), n)) for n in names]


def test_heading_levels(spark):
    cases = [("## Scope", False, "x", 2), ("3.1 Field Work", False, "x", 2), ("4 way crossing", True, "", None), ("Chapter 4", False, "x", 2), ("SCOPE OF WORK", True, "the river was low again", 2), ("SCOPE OF WORK", False, "the river was low again", None),
             ("Scope of the Study", True, "the river was low again", 3), ("Water Supply", True, "12", None), ("The river was low.", True, "and so on it went", None), ("- Item", True, "and so on it went", None), ("", True, "a b", None), ("Scope of the Study", True, None, 3)]
    df = spark.createDataFrame([(c[0], c[1], c[2]) for c in cases], "line string, start boolean, next string")
    assert [r[0] for r in df.select(S.heading_level(F.col("line"), F.col("start"), F.col("next"))).collect()] == [c[3] for c in cases]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.trail(F.lit(" A title "), F.lit(None).cast("string"))) == "A title" and one(S.trail(F.lit("a b c"), F.lit("d"), 3)) == "a b c"
    assert one(S.tables_of(F.lit("SELECT * FROM a JOIN b_1 ON x from A"))) == ["a", "b_1"]
    assert one(S.redacted(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("q"), F.lit("long" * 9)), 5)) == {"api_key": "[hidden]", "q": "longl…"}
    assert one(S.sigmoid(F.lit(-800.0))) == 0 and one(S.sigmoid(F.lit(800.0))) == 1 and one(S.sigmoid(F.lit(0.0))) == 0.5
    assert one(S.singular_tokens(F.lit("Rivers & river's glass dams"))) == ["river", "and", "glass", "dam"]
    assert one(S.projection_version(F.lit("2024-05-06 07:08:09").cast("timestamp"), F.lit("a"))) == "20240506T070809-ca978112"


def test_questions_of_fixed_shape_are_checked_and_answered(spark):
    for bad in (("nope", {}), ("by_subject", {"x": 1}), ("by_subject", {"window_start": "1 May"}), ("works_at", {})):
        with pytest.raises(ValueError):
            G.checked_parameters(*bad)
    assert G.checked_parameters("by_subject", {"limit": 900})["limit"] == 100
    assert G.plan_for("WORKS_AT", "PERSON", True) == ["works_at"] and G.sides("PARENT_OF", "ORGANIZATION") == ("subject", "object")
    claims = spark.createDataFrame([
        ("1", "FUNDED_BY", "p", "o", "active", "explicit", "2000-01-01", None, "d"), ("2", "LED_BY", "p", "x", "active", "explicit", None, "2030-01-01", "d"), ("3", "LED_BY", "p", "y", "disputed", "explicit", None, "2030-01-01", "d"),
        ("4", "LED_BY", "p", "z", "active", "inferred", None, None, "d"), ("5", "PARENT_OF", "o", "o", "active", "explicit", "2001-01-01", "2002-01-01", "d")], "claim_id string, predicate string, subject_id string, object_id string, status string, basis string, valid_from string, valid_until string, document_id string")
    claims = claims.withColumn("valid_from", F.col("valid_from").cast("date")).withColumn("valid_until", F.col("valid_until").cast("date"))
    asked = spark.createDataFrame([("o",), ("o",), ("none",)], "entity_id string")
    assert [(r.claim_id, r.second_other_id) for r in G.ask("leaders_of_funded", claims, asked, as_of="2010-01-01").collect()] == [("1", "x")]
    assert {r.claim_id for r in G.ask("entity_timeline", claims, asked).collect()} == {"1", "5"}
    assert {r.claim_id for r in G.ask("entity_timeline", claims, asked, window_start="2003-01-01").collect()} == {"1"}
    assert G.ask("entity_timeline", claims, asked.limit(0)).count() == 0


def test_claims_are_refused_for_the_first_reason(spark):
    base = dict(claim_id="c", predicate="LED_BY", subject_id="p", object_id="x", object_text=None, document_id="d", chunk_id="k", quote="led by  Ann Weller", valid_from="2019", valid_until=None, basis="explicit", status="active", confidence=0.9)
    changes = {None: {}, "unknown_predicate": {"predicate": "LIKES"}, "unknown_subject": {"subject_id": "q"}, "missing_object_entity": {"object_id": None}, "type_violation": {"object_id": "p"}, "quote_not_in_chunk": {"quote": "led by somebody else"}, "quote_length": {"quote": "led"},
               "chunk_not_found": {"chunk_id": "z"}, "quote_without_chunk": {"chunk_id": None}, "bad_valid_from": {"valid_from": "May"}, "inverted_validity": {"valid_until": "2018-01"}, "bad_basis": {"basis": None}, "low_confidence": {"confidence": 0.1}, "confidence_out_of_range": {"confidence": None}}
    rows = [{**base, **c, "claim_id": str(k)} for k, c in changes.items()]
    schema = "claim_id string, predicate string, subject_id string, object_id string, object_text string, document_id string, chunk_id string, quote string, valid_from string, valid_until string, basis string, status string, confidence double"
    entities = spark.createDataFrame([("p", "PROJECT", True), ("x", "PERSON", True)], "entity_id string, type string, eligible boolean")
    passages = spark.createDataFrame([("k", "It was led\nby Ann Weller then")], "chunk_id string, text string")
    got = {r.claim_id: (r.code, r.quote_start) for r in G.validate(spark.createDataFrame(rows, schema), entities, passages, 0.5).collect()}
    assert {k: v[0] for k, v in got.items()} == {str(k): k for k in changes} and got["None"][1] == 7
