"""Column functions on the structure of texts: headings, identities of chunks, trails, surfaces of names, records as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace under which chunks get their ids, if no other is given.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
# Words that titles don't capitalise; what begins a labelled heading; keys whose values are not shown.
MINOR = "a an and as at by for from in into of on or per the to under via with within".split()
LABELLED = r"^(?i:chapter|section|part|annex|annexure|appendix|table|figure|box)\s+(?:\d+|[IVXL]+|[A-Z])\b"
SECRET = r"(?i)(?:secret|token|password|passwd|api_?key|authorization|credential)"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The UUID of version 5 of a name: SHA-1 of namespace and name, with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), part(17, 1)), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def trail(title: Column, heading: Column, words: int = 32) -> Column:
    """Title and heading as one line, its first words; empty without either."""
    parts = F.filter(F.array(F.trim(title), F.trim(heading)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.slice(F.split(F.array_join(parts, " › "), r"\s+"), 1, words), " ")


def heading_level(line: Column, block_start: Column, next_line: Column) -> Column:
    """The level of a heading, or null: marks (#), section numbers, labels, and, at a block's start before running text, capitals.

    next_line is the next line with text, empty where none follows, null where it isn't known.
    """
    s = F.trim(line)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    ended = s.rlike(r"[.!?:;,]$")
    number = F.regexp_extract(s, r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+[A-Z]", 1)
    letters = F.regexp_replace(s, r"[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(letters, "[a-z]", ""))
    content = F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"[.,;:()]", "").isin(*MINOR))
    introduces = next_line.isNull() | next_line.rlike(r"[a-z]{2,}.*\s")
    few = F.size(words) <= 8
    return (F.when(s == "", None).when(s.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(s, r"^(#{1,6})\s", 1)))
            .when(s.rlike(r"(?i)https?://|www\.") | s.rlike(r"^(?:[-*•–]|\(?[a-z]\))\s") | s.startswith("|") | (F.size(words) > 14), None)
            .when((number != "") & ~ended & few, F.size(F.split(number, r"\.")))
            .when(s.rlike(LABELLED) & ~ended, 2)
            .when(~block_start | ~introduces, None)
            .when((letters != "") & few & (capitals > 0.85 * F.length(letters)), 2)
            .when(few & ~ended & (F.size(content) > 0) & ~F.exists(content, lambda w: ~w.rlike("^[A-Z]")), 3)).cast("int")


def number_line(line: Column) -> Column:
    """Whether a line is a bare number."""
    return F.trim(line).rlike(r"^[\d.,%+\-–—()]+$") & line.rlike(r"\d")


def label_line(line: Column) -> Column:
    """Whether a line is as short as a label of a chart, and no sentence or row."""
    s = F.trim(line)
    return (s != "") & ~s.startswith("|") & ~s.rlike(r"[.:;!?]$") & (F.length(s) <= 28) & (F.size(F.split(s, r"\s+")) <= 4)


def plain_text(text: Column) -> Column:
    """Text for comparison: no possessives, & as and, punctuation as blanks, single blanks, lower case."""
    t = F.regexp_replace(F.lower(text), r"['’]s\b", "")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def file_slug(text: Column, most: int = 80) -> Column:
    """A text as part of a file name, cut at a word within the length."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, most + 1), r"-[^-]*$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.substring(cut, 1, most))


def singular_tokens(text: Column) -> Column:
    """The different folded words of three letters or more without the s of a plural."""
    words = F.filter(F.split(plain_text(text), " "), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(words, lambda w: F.when(w.rlike("[^s]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)))


def is_prose(surface: Column) -> Column:
    """Whether a surface is too long, or too much of a sentence, to be a name."""
    words = F.split(F.trim(surface), r"\s+")
    return (F.size(words) > 10) | surface.rlike(r"(?i)\b(?:is|are|was|were|has|have|will|which|that)\b") | ~surface.rlike("[A-Z]")


def redacted(values: Column, most: int = 200) -> Column:
    """A map of strings with the values of secret keys hidden and long ones cut."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET), "[hidden]").otherwise(F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v)))


def tables_of(sql: Column) -> Column:
    """The different names after FROM and JOIN of SQL texts, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(sql), F.lit(r"\b(?:from|join)\s+([a-z_][a-z0-9_.]*)"), F.lit(1)), lambda t: t)))


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(F.least(x, F.lit(0.0))) / (1 + F.exp(F.least(x, F.lit(0.0)))))


def projection_version(at: Column, salt: Column) -> Column:
    """A stamp that sorts by time, with a part of a hash."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(salt, 256), 1, 8))
