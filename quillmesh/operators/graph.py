"""Relationships between typed entities, each a claim with a period: vocabulary, validation, and questions of fixed shape.

A question of fixed shape is asked for any number of entities at once: the entities asked for are joined with the
claims, so that nothing is collected and no query text is made from values.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Predicates with the types of their subjects and objects, and whether a subject has one object at a time. Without object types the object is a text.
PREDICATES = {
    "FUNDED_BY": (("PROJECT",), ("ORGANIZATION",), False), "PARTNER_OF": (("PROJECT",), ("ORGANIZATION",), False), "LED_BY": (("PROJECT",), ("PERSON",), True), "WORKS_AT": (("PERSON",), ("ORGANIZATION",), True),
    "MEMBER_OF": (("PERSON",), ("ORGANIZATION",), False), "PARENT_OF": (("ORGANIZATION",), ("ORGANIZATION",), False), "AUTHORED": (("PERSON",), (), False),
}
# Lengths of quotations, and bases that speak for the present.
SHORTEST_QUOTE, LONGEST_QUOTE, LONGEST_TEXT = 12, 600, 255
CURRENT_BASES = ("explicit", "published")
BASES = (*CURRENT_BASES, "inferred", "unknown")
STATUSES = ("active", "superseded", "disputed", "retracted")


def predicates(spark) -> DataFrame:
    """The vocabulary as a frame of as many rows as it has predicates: predicate, subject_types, object_types, functional."""
    return spark.createDataFrame([(n, list(d), list(r), f) for n, (d, r, f) in PREDICATES.items()], "predicate string, subject_types array<string>, object_types array<string>, functional boolean")


def predicate_name(surface: Column) -> Column:
    """A predicate as it is stored: upper case, words joined by underscores."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(surface), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def sides(predicate: str, entity_type: str) -> tuple[str, ...]:
    """Which ends of a predicate an entity of a type may take."""
    subject, object_, _ = PREDICATES[predicate]
    return tuple(s for s, types in (("subject", subject), ("object", object_)) if entity_type in types)


def validate(claims: DataFrame, entities: DataFrame, passages: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Adds ``code``, the first reason against a claim or null, with ``quote_start`` of its quotation and the dates normalised.

    claims: claim_id, predicate, subject_id, object_id, object_text, document_id, chunk_id, quote, valid_from, valid_until
    (strings), basis, status, confidence. entities: entity_id, type, eligible. passages: chunk_id, text. Quotations are
    found with blanks of any length.
    """
    from quillmesh.functions.dates import iso_start

    entity = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("type").alias(f"{side}_type"), F.col("eligible").alias(f"{side}_eligible"))
    words = F.broadcast(predicates(claims.sparkSession).withColumn("known", F.lit(True)))  # as many rows as the vocabulary has
    d = claims.join(words, "predicate", "left").join(entity("subject"), "subject_id", "left").join(entity("object"), "object_id", "left")
    d = d.join(passages.select("chunk_id", "text"), "chunk_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    squeezed = lambda c: F.regexp_replace(F.trim(F.col(c)), r"\s+", " ")
    at = F.instr(squeezed("text"), squeezed("quote"))
    start, end = iso_start(F.col("valid_from")), iso_start(F.col("valid_until"))
    linked = F.size("object_types") > 0
    quoted = F.col("chunk_id").isNotNull()
    rules = {
        "unknown_predicate": F.col("known").isNull(), "unknown_subject": F.col("subject_type").isNull(), "subject_not_eligible": ~F.col("subject_eligible"),
        "missing_object_entity": linked & F.col("object_id").isNull(), "unknown_object": linked & F.col("object_type").isNull(), "object_not_eligible": linked & ~F.col("object_eligible"),
        "object_text_on_entity_predicate": linked & ~blank("object_text"), "object_entity_on_text_predicate": ~linked & F.col("object_id").isNotNull(), "missing_object_text": ~linked & blank("object_text"),
        "object_text_too_long": ~linked & (F.length(F.trim("object_text")) > LONGEST_TEXT),
        "type_violation": ~F.array_contains("subject_types", F.col("subject_type")) | linked & ~F.array_contains("object_types", F.col("object_type")),
        "self_reference": F.col("object_id") == F.col("subject_id"), "missing_document": blank("document_id"),
        "chunk_not_found": quoted & F.col("text").isNull(), "missing_quote": quoted & blank("quote"), "quote_length": quoted & ~F.length(F.trim("quote")).between(SHORTEST_QUOTE, LONGEST_QUOTE), "quote_not_in_chunk": quoted & (at == 0),
        "quote_without_chunk": ~quoted & ~blank("quote"),
        "bad_valid_from": ~blank("valid_from") & start.isNull(), "bad_valid_until": ~blank("valid_until") & end.isNull(), "inverted_validity": start > end,
        "bad_basis": ~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "bad_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "confidence_out_of_range": ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "low_confidence": F.col("confidence") < least_confidence,
    }
    code = F.coalesce(*(F.when(c, n) for n, c in rules.items()))
    basis = F.when(start.isNull() & end.isNull(), "unknown").otherwise(F.col("basis"))
    return d.select("claim_id", code.alias("code"), F.when(at > 0, at - 1).alias("quote_start"), start.alias("valid_from"), end.alias("valid_until"), basis.alias("basis"))


def most_confident(claims: DataFrame) -> DataFrame:
    """One row per claim_id, the most confident, ties by the other columns."""
    rest = [c for c in claims.columns if c not in ("claim_id", "confidence")]
    best = claims.groupBy("claim_id").agg(F.max(F.struct("confidence", *rest)).alias("b"))
    return best.select("claim_id", "b.*").select(claims.columns)


def overlaps_window(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether a half-open period meets a half-open window; null bounds are open. Without a window all do, with one an unknown period doesn't."""
    inside = (start.isNotNull() | end.isNotNull()) & (hi.isNull() | start.isNull() | (start < hi)) & (lo.isNull() | end.isNull() | (end > lo))
    return (lo.isNull() & hi.isNull()) | F.coalesce(inside, F.lit(False))


def is_current(status: Column, basis: Column) -> Column:
    """Whether a claim may be told as a present fact."""
    return F.coalesce((status == "active") & basis.isin(*CURRENT_BASES), F.lit(False))


def recency_order() -> list[Column]:
    """Open periods first, then the latest end, then the latest start, then the id."""
    return [F.coalesce(F.col("valid_until"), F.lit("9999-12-31").cast("date")).desc(), F.coalesce(F.col("valid_from"), F.lit("0001-01-01").cast("date")).desc(), F.col("claim_id")]


@dataclasses.dataclass(frozen=True)
class Template:
    """A question of fixed shape: which predicates, from which side, over which time. current: of the present only."""

    predicates: Sequence[str]
    side: str  # where the entity asked for stands: subject, object or either
    current: bool = False
    second: str | None = None


#: The questions that may be asked, by name.
TEMPLATES: Mapping[str, Template] = {
    "projects_funded_by": Template(("FUNDED_BY",), "object", True), "leaders_of_funded": Template(("FUNDED_BY",), "object", True, "LED_BY"), "projects_led_by": Template(("LED_BY",), "object", True),
    "works_at": Template(("WORKS_AT",), "subject", True), "member_of": Template(("MEMBER_OF",), "subject", True), "funders_of": Template(("FUNDED_BY",), "subject", True),
    "project_history": Template(tuple(PREDICATES), "subject"), "person_history": Template(tuple(PREDICATES), "either"), "funding_history": Template(("FUNDED_BY",), "object"),
    "by_subject": Template(("LED_BY", "PARTNER_OF"), "subject"), "by_object": Template(("LED_BY", "PARTNER_OF"), "object"), "entity_timeline": Template(tuple(PREDICATES), "either"),
}
_PARAMETERS = {"as_of": r"\d{4}-\d{2}-\d{2}", "window_start": r"\d{4}-\d{2}-\d{2}", "window_end": r"\d{4}-\d{2}-\d{2}", "limit": r"\d{1,3}"}


def checked_parameters(template: str, given: Mapping[str, object], most: int = 100) -> dict[str, object]:
    """The parameters of a question, checked: unknown templates and parameters and malformed values are refused, limits clipped."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template}")
    for name, value in given.items():
        if name not in _PARAMETERS:
            raise ValueError(f"unknown parameter {name}")
        if value is not None and not re.fullmatch(_PARAMETERS[name], str(value)):
            raise ValueError(f"bad value of {name}")
    if TEMPLATES[template].current and given.get("as_of") is None:
        raise ValueError("as_of is needed")
    return {**{n: None for n in _PARAMETERS}, **given, "limit": min(most, max(1, int(given.get("limit") or most)))}


def plan_for(predicate: str, entity_type: str, current: bool) -> list[str]:
    """Names of templates of one hop that answer a predicate for an entity of a type."""
    return [n for n, t in TEMPLATES.items() if tuple(t.predicates) == (predicate,) and t.second is None and t.current == current and (t.side == "either" or t.side in sides(predicate, entity_type))]


def ask(template: str, claims: DataFrame, asked: DataFrame, **given: object) -> DataFrame:
    """The answers of a question of fixed shape for every entity asked for, the most recent first, ``limit`` of each.

    claims: claim_id, predicate, subject_id, object_id, status, basis, valid_from, valid_until, document_id. asked: entity_id.
    Result: entity_id, position (from 1), claim_id, other_id, second_claim_id, second_other_id (null but for two hops), status,
    valid_from, valid_until, document_id. The limit is the report's length, as asked for.
    """
    p, t = checked_parameters(template, given), TEMPLATES[template]
    date = lambda n: F.lit(p[n]).cast("date")
    lo, hi = (date("as_of"), F.date_add(date("as_of"), 1)) if t.current else (date("window_start"), date("window_end"))

    def held(names: Sequence[str]) -> DataFrame:
        c = claims.where(F.col("predicate").isin(*names)).where(overlaps_window(F.col("valid_from"), F.col("valid_until"), lo, hi))
        return c.where(is_current(F.col("status"), F.col("basis"))) if t.current else c

    def side(c: DataFrame, own: str, other: str) -> DataFrame:
        return c.select(F.col(f"{own}_id").alias("entity_id"), F.col(f"{other}_id").alias("other_id"), "claim_id", "status", "valid_from", "valid_until", "document_id")

    c = held(t.predicates)
    rows = side(c, "subject", "object") if t.side == "subject" else side(c, "object", "subject")
    if t.side == "either":  # a claim on itself is told once
        rows = rows.unionByName(side(c.where("object_id is null or object_id <> subject_id"), "subject", "object")).where("entity_id is not null")
    rows = rows.join(asked.select("entity_id").distinct(), "entity_id")
    if t.second:
        last = held((t.second,)).select(F.col("subject_id").alias("other_id"), F.col("object_id").alias("second_other_id"), F.col("claim_id").alias("second_claim_id"))
        rows = rows.join(last, "other_id")
    else:
        rows = rows.select("*", F.lit(None).cast("string").alias("second_other_id"), F.lit(None).cast("string").alias("second_claim_id"))
    w = Window.partitionBy("entity_id").orderBy(*recency_order(), "second_claim_id")
    rows = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= p["limit"])
    return rows.select("entity_id", "position", "claim_id", "other_id", "second_claim_id", "second_other_id", "status", "valid_from", "valid_until", "document_id")


def explain(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each claim with how many claims contradict it, and the least and greatest of them. conflicts: claim_a, claim_b."""
    both = conflicts.select(F.col("claim_a").alias("claim_id"), F.col("claim_b").alias("against")).unionByName(conflicts.select(F.col("claim_b").alias("claim_id"), F.col("claim_a").alias("against")))
    n = both.groupBy("claim_id").agg(F.countDistinct("against").alias("contradicted_by"), F.min("against").alias("first_against"), F.max("against").alias("last_against"))
    return claims.join(n, "claim_id", "left").withColumn("contradicted_by", F.coalesce("contradicted_by", F.lit(0)))


def stale_claims(fresh: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged claims of a document and field that were read again, but not found again. Both: claim_id, document_id, field."""
    again = fresh.select("document_id", "field").distinct()
    return staged.join(again, ["document_id", "field"], "left_semi").join(fresh.select("claim_id"), "claim_id", "left_anti").select("claim_id")


def verify(claims: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``check, expected, actual``: counts of claims and edges by predicate, and invariants whose expected count is 0."""
    current = claims.where(is_current(F.col("status"), F.col("basis")))
    counts = current.groupBy(F.concat(F.lit("edges:"), "predicate").alias("check")).agg(F.count("*").alias("expected"))
    actual = edges.groupBy(F.concat(F.lit("edges:"), "predicate").alias("check")).agg(F.count("*").alias("actual"))
    by_predicate = counts.join(actual, "check", "full").select("check", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    invariant = lambda name, rows: rows.agg(F.count("*").alias("actual")).select(F.lit(name).alias("check"), F.lit(0).cast("long").alias("expected"), "actual")
    orphan = edges.join(entities.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_anti")
    dead = edges.join(current.select("claim_id"), "claim_id", "left_anti")
    return by_predicate.unionByName(invariant("orphan_edges", orphan)).unionByName(invariant("edges_without_current_claim", dead))
