"""Rows that processing leaves behind: logs, mentions, links, decisions, reports; and how much of a budget may be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Strings cut to the widths of the columns that they are stored in."""
    return df.select(*(F.substring(c, 1, widths[c]).alias(c) if c in widths else F.col(c) for c in df.columns))


def insert_new(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows and those of a batch whose key isn't stored, one for each key, the least by its other columns.

    Null keys are equal to each other; a repeated batch changes nothing.
    """
    rest = [c for c in stored.columns if c not in keys]
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)) if rest else rows.select(*keys).distinct()
    marked = fresh.join(stored.select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__known")), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return stored.unionByName(marked.select(stored.columns))


def first_marks(df: DataFrame, key: str, mark: str) -> DataFrame:
    """The least mark of each key; keys without any have null, and never come before one."""
    return df.groupBy(key).agg(F.min(mark).alias(mark))


def within_caps(df: DataFrame, key: str, order: Sequence[str], per_key: int, in_all: int) -> DataFrame:
    """Rows that may be processed in a run: the first of each key, then the first of all, by the order. Both are ceilings of the run's cost."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_key).orderBy(*order, key).limit(in_all)


def spread(df: DataFrame, group: str, order: Sequence[str], key: str | None = None) -> DataFrame:
    """Adds ``round``, the turn of a row within its group: sorted by it, groups take turns, so that one is not repeated before all have come."""
    keys = [k for k in (key, group) if k]
    return df.withColumn("round", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def run_status(stages: DataFrame, key: str) -> DataFrame:
    """``status`` of each run: failed if a stage was fatal, partial if any had errors, skipped if all were, else ok. stages: key, outcome, fatal."""
    is_ = lambda o: F.coalesce(F.col("outcome") == o, F.lit(False))
    g = stages.groupBy(key).agg(F.max(F.coalesce("fatal", F.lit(False))).alias("f"), F.max(is_("error")).alias("e"), F.min(is_("skipped")).alias("s"))
    return g.select(key, F.when(F.col("f"), "failed").when(F.col("e"), "partial").when(F.col("s"), "skipped").otherwise("ok").alias("status"))


def change_status(before: Column, after: Column) -> Column:
    """new, changed, unchanged or removed, by fingerprints of which null is none."""
    return F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "new").when(after.isNull(), "removed").when(before == after, "unchanged").otherwise("changed")


def conflicting(a: str, b: str) -> Column:
    """Whether two blocks (structs: document_id, source_type, linked) speak for linked documents that may differ: not the same, nor a page and its own PDF."""
    c = lambda s, f: F.col(f"{s}.{f}")
    linked = (c(a, "linked") == c(b, "document_id")) | (c(b, "linked") == c(a, "document_id")) | (c(a, "linked") == c(b, "linked"))
    own = ((c(a, "source_type") == "pdf_attachment") & (c(a, "linked") == c(b, "document_id"))) | ((c(b, "source_type") == "pdf_attachment") & (c(b, "linked") == c(a, "document_id")))
    return F.coalesce(linked, F.lit(False)) & (c(a, "document_id") != c(b, "document_id")) & ~F.coalesce(own, F.lit(False))


def flag_conflicts(blocks: DataFrame, key: str) -> DataFrame:
    """Pairs of blocks of one key that conflict: key, a, b by their numbers. blocks: key, n, document_id, source_type, linked; a context has few blocks."""
    row = F.struct("n", "document_id", "source_type", "linked")
    x, y = blocks.select(key, row.alias("x")), blocks.select(key, row.alias("y"))
    return x.join(y, key).where((F.col("x.n") < F.col("y.n")) & conflicting("x", "y")).select(key, F.col("x.n").alias("a"), F.col("y.n").alias("b"))


def fresh(df: DataFrame, key: str, at: str, now: Column, ttl: str) -> DataFrame:
    """The latest row of each key that is not older than the time to live; ties by the other columns."""
    rest = [c for c in df.columns if c not in (key, at)]
    best = df.where(F.col(at) > now - F.expr(f"INTERVAL {ttl}")).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r"))
    return best.select(key, "r.*").select(df.columns)
