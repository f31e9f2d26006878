"""Differences between two copies of a table, by key and field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import strip_blanks


def plain_text(c: Column) -> Column:
    """Text for comparison: no outer blanks, lower case, empty as null."""
    t = F.lower(strip_blanks(c.cast("string")))
    return F.when(t != "", t)


def plain_version(c: Column) -> Column:
    """A version for comparison: as text, without a leading v."""
    t = F.regexp_replace(plain_text(c), f"^v\\s*", "")
    return F.when(t != "", t)


def plain_number(c: Column) -> Column:
    """A number for comparison, without a leading v, in one writing; what is no number is compared as text."""
    t = plain_version(c)
    n = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t).try_cast("decimal(38,10)")
    return F.when(n.isNotNull(), F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(t)


def uuid_key(c: Column) -> Column:
    """An identifier equal ignoring case, hyphens and outer blanks, in lower case; of 32 digits, with hyphens as a UUID has them."""
    bare = F.regexp_replace(plain_text(c), "-", "")
    parts = [F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(bare) == 32, F.concat_ws("-", *parts)).otherwise(bare)


def latest(df: DataFrame, key: str, fields: Sequence[str], version: str) -> DataFrame:
    """The row of each key with the latest version; of equal versions the greatest by the fields, nulls least.

    An aggregation with partial sums before the shuffle, so that a key with many rows is no burden to one task.
    Rows with a null key are left out; a null version is the oldest.
    """
    s = F.max(F.struct(F.col(version).alias("__v"), *(F.col(f) for f in fields)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(s.alias("__s")).select(key, *(F.col(f"__s.{f}").alias(f) for f in fields))


def differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """Keys missing on a side and fields that differ between two copies.

    Both frames have ``key`` and ``fields``, already normalised, with each key once (see ``latest``); other columns are
    ignored. EXCEPT ALL in both directions leaves the rows without an equal on the other side; the two residues are
    joined in full by key. Result: ``key, difference, left_value, right_value``; difference is ``missing_in_<name>`` or
    the field's name; null equals null and differs from any value. An empty side makes every key of the other missing.
    """
    cols = [key, *fields]
    a, b = left.select(cols), right.select(cols)
    only_a = a.exceptAll(b).select(F.col(key), F.struct(*fields).alias("__a"))
    only_b = b.exceptAll(a).select(F.col(key), F.struct(*fields).alias("__b"))
    both = only_a.join(only_b, key, "full")
    row = lambda what, when, x, y: F.when(when, F.struct(F.lit(what).alias("difference"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value")))
    none = F.lit(None).cast("string")
    one_sided = F.col("__a").isNull() | F.col("__b").isNull()
    found = [row(f"missing_in_{right_name}", F.col("__b").isNull(), none, none), row(f"missing_in_{left_name}", F.col("__a").isNull(), none, none)]
    found += [row(f, ~one_sided & ~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.col(f"__a.{f}"), F.col(f"__b.{f}")) for f in fields]
    return both.select(key, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
