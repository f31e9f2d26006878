"""Column functions that read periods, editions and people from phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import let

_DASH = "[-–—/]"


def editions(text: Column) -> Column:
    """Spans of two consecutive years in a text as ``2024-25``, in order, each once; other spans are none."""
    full = F.regexp_extract_all(text, F.lit(rf"(?<!\d)((?:19|20)\d{{2}}\s?{_DASH}\s?(?:(?:19|20)\d{{2}}|\d{{2}}))(?![\d-])"), F.lit(1))

    def one(x: Column) -> Column:
        a = F.substring(x, 1, 4).cast("int")
        b = F.regexp_extract_all(x, F.lit(r"(\d+)$"), F.lit(1))[0]
        end = F.when(F.length(b) == 4, b.cast("int")).otherwise(F.floor(a / 100).cast("int") * 100 + b.cast("int"))
        end = F.when((F.length(b) == 2) & (end < a), end + 100).otherwise(end)
        return F.when(end == a + 1, F.concat(a.cast("string"), F.lit("-"), F.lpad((end % 100).cast("string"), 2, "0")))

    return F.array_distinct(F.filter(F.transform(full, one), lambda e: e.isNotNull()))


def edition_end(edition: Column) -> Column:
    """The year in which an edition such as 2024-25 ends."""
    return F.substring(edition, 1, 4).cast("int") + 1


def window_of(text: Column) -> Column:
    """The half-open period a phrase names: ``basis, start, end`` (dates, null for open), null where it names none.

    In order: between A and B, from A to B (both years included), since A, before A, until A (included), in A. Of
    several, the first of the highest rule holds; a period that would end before it begins is none.
    """
    year = r"((?:19|20)\d{2})"
    day = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    g = lambda p, i: F.regexp_extract(text, p, i)
    none = F.lit(None).cast("date")
    rules = [("between", rf"(?i)\bbetween\s+{year}\s+and\s+{year}\b", True), ("range", rf"(?i)\bfrom\s+{year}\s+(?:to|until|till)\s+{year}\b", True), ("since", rf"(?i)\bsince\s+{year}\b", False), ("before", rf"(?i)\bbefore\s+{year}\b", False),
             ("until", rf"(?i)\b(?:until|till|by)\s+{year}\b", False), ("in", rf"(?i)\b(?:in|during)\s+(?:[A-Z][a-z]+\s+)?{year}\b", False)]
    out = None
    for name, p, two in rules:
        a, b = g(p, 1), g(p, 2) if two else None
        start = {"before": none, "until": none}.get(name, day(a))
        end = day(b.cast("int") + 1) if two else {"since": none, "before": day(a), "until": day(a.cast("int") + 1), "in": day(a.cast("int") + 1)}[name]
        s = F.struct(F.lit(name).alias("basis"), start.alias("start"), end.alias("end"))
        value = F.when((start < end) | start.isNull() | end.isNull(), s)
        out = F.when(text.rlike(p), value) if out is None else out.when(text.rlike(p), value)
    return out


def people_of(byline: Column) -> Column:
    """The people of a byline (array of string): parted by semicolons, ``and``, ``&`` or commas; ``Surname, I.`` stays together."""
    by = F.regexp_replace(F.trim(byline), r"(?i)^by\s+", "")
    kept = F.regexp_replace(by, r"([\p{Lu}][\p{L}'-]+),\s*((?:\p{Lu}\.[\s-]?)+)", "$1\u0001 $2")
    parts = F.split(kept, r"(?i)\s*(?:;|,|&|\band\b)\s*", -1)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\u0001", ","))), lambda p: p != "")


def blocks(text: Column) -> Column:
    """The blocks of a text parted by blank lines: array of (kind, text); kind is table, list, heading or text."""
    def kind(b: Column) -> Column:
        return (F.when(b.rlike(r"^\s*\|"), "table").when(b.rlike(r"^\s*([-*•–]|\d{1,3}[.)])\s"), "list")
                .when((F.length(b) <= 80) & ~b.rlike(r"[.!?:;,।]\s*$"), "heading").otherwise("text"))

    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n", -1), lambda b: F.regexp_replace(b, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda b: b != "")
    return let(parts, lambda p: F.transform(p, lambda b: F.struct(kind(b).alias("kind"), b.alias("text"))))


def sections(text: Column) -> Column:
    """The sections of a text: array of (heading, blocks, chars). A heading begins one; of consecutive headings each but the last is a block of its own section."""
    start = F.array().cast("array<struct<heading:string,blocks:int,chars:int>>")

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        new = (F.size(acc) == 0) | (b["kind"] == "heading")
        begun = F.struct(F.when(b["kind"] == "heading", b["text"]).alias("heading"), F.when(b["kind"] == "heading", 0).otherwise(1).alias("blocks"), F.when(b["kind"] == "heading", 0).otherwise(F.length(b["text"])).alias("chars"))
        more = F.struct(last["heading"].alias("heading"), (last["blocks"] + 1).alias("blocks"), (last["chars"] + F.length(b["text"])).alias("chars"))
        return F.when(new, F.concat(acc, F.array(begun))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more)))

    return F.aggregate(blocks(text), start, step)


def pack(sizes: Column, most: int) -> Column:
    """The batch (from 0) of each of an array of sizes: a new one where the next would exceed ``most``; one over it is alone."""
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] < 0) | (a["spent"] + x > most)
        n = F.when(new, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(new, x).otherwise(a["spent"] + x).cast("long").alias("spent"), n.alias("n"), F.concat(a["out"], F.array(n)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
