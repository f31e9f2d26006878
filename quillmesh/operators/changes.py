"""Change detection between snapshots, and keyed writes with a policy per column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, fingerprint: str, version: str | None = None, wanted_version: str | None = None) -> DataFrame:
    """key and status: NEW, CHANGED, UNCHANGED or DELETED, with ``stale`` for rows made by another version.

    A row is CHANGED where its fingerprint differs, null equals null; a stored version that is null counts as stale, a
    missing row doesn't. Keys must be unique on each side.
    """
    a = previous.select(key, F.col(fingerprint).alias("__old"), (F.col(version) if version else F.lit(None)).alias("__version"), F.lit(True).alias("__was"))
    b = current.select(key, F.col(fingerprint).alias("__new"), F.lit(True).alias("__is"))
    d = a.join(b, key, "full")
    status = (F.when(F.col("__was").isNull(), "NEW").when(F.col("__is").isNull(), "DELETED")
              .when(F.col("__old").eqNullSafe(F.col("__new")), "UNCHANGED").otherwise("CHANGED"))
    stale = F.lit(False) if wanted_version is None else F.coalesce(F.col("__was"), F.lit(False)) & ~F.col("__version").eqNullSafe(F.lit(wanted_version))
    return d.select(key, status.alias("status"), stale.alias("stale"))


def plausible_deletions(diff: DataFrame, group: str, most_ratio: float, allowance: int) -> DataFrame:
    """Per group, whether so many deletions are believable: a share within the ratio, or few enough."""
    return diff.groupBy(group).agg(
        F.count(F.when(F.col("status") != "NEW", 1)).alias("known"), F.count(F.when(F.col("status") == "DELETED", 1)).alias("missing")
    ).withColumn("plausible", (F.col("missing") <= allowance) | (F.col("missing") <= F.col("known") * most_ratio))


def merge_rows(stored: DataFrame, incoming: DataFrame, key: str, policy: Mapping[str, str]) -> DataFrame:
    """The stored table after an upsert; policy by column: ``overwrite``, ``keep`` (an old value unless it is null), ``fill`` (a new value unless it is null).

    Columns not named keep stored values on rows that exist. Keys must be unique on each side.
    """
    columns = stored.columns
    a = stored.select(key, F.struct(*columns).alias("__a"))
    b = incoming.select(key, F.struct(*[c if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in columns]).alias("__b"))

    def value(c: str) -> Column:
        old, new = F.col(f"__a.{c}"), F.col(f"__b.{c}")
        how = policy.get(c, "stored")
        merged = {"overwrite": new, "keep": F.coalesce(old, new), "fill": F.coalesce(new, old), "stored": old}[how]
        return F.when(F.col("__a").isNull(), new).when(F.col("__b").isNull(), old).otherwise(merged).alias(c)

    return a.join(b, key, "full").select(*(F.col(key) if c == key else value(c) for c in columns))


def replace_facet(stored: DataFrame, incoming: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Facet rows after the ones of touched keys were replaced by the incoming ones, repeated rows once."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").unionByName(incoming.distinct())


def rename_value(facet: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A facet with a value renamed; rows that then are equal remain once."""
    return facet.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column))).distinct()


def delete_keys(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by the order columns, as an aggregation with partial sums."""
    rest = [c for c in df.columns if c != key and c not in order]
    s = F.max(F.struct(*order, *rest)).alias("__s")
    return df.groupBy(key).agg(s).select(key, "__s.*").select(df.columns)


def attempts(previous: DataFrame, failures: DataFrame, key: str, fingerprint: str, seen: str) -> DataFrame:
    """Failure markers after another run: attempts counted on, first_seen kept, both anew where the fingerprint changed."""
    a = previous.select(key, F.col(fingerprint).alias("__f"), F.col("attempts").alias("__n"), F.col("first_seen").alias("__first"))
    b = failures.groupBy(key).agg(F.max_by(fingerprint, seen).alias(fingerprint), F.count("*").alias("__k"), F.min(seen).alias("__min"))
    d = a.join(b, key, "full")
    same = F.col("__f").eqNullSafe(F.col(fingerprint))
    old_only = F.col("__k").isNull()
    return d.select(
        key, F.when(old_only, F.col("__f")).otherwise(F.col(fingerprint)).alias(fingerprint),
        F.when(old_only, F.col("__n")).when(same, F.coalesce("__n", F.lit(0)) + F.col("__k")).otherwise(F.col("__k")).cast("long").alias("attempts"),
        F.when(old_only | same, F.coalesce("__first", "__min")).otherwise(F.col("__min")).alias("first_seen"))
