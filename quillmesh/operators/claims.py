"""Claims with periods: overlap, precedence, conflicts, current state; and fixed-shape graph queries over them.

A claim is (claim_id, subject, predicate, object, valid_from, valid_until, basis). Periods are half open; a null end
is open, a period without both ends is unknown and overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of one bucket of the interval join; claims longer than MOST_BUCKETS of them are joined apart.
BUCKET_DAYS = 90
MOST_BUCKETS = 64


def overlaps(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Whether two half-open periods overlap; unknown ones don't, adjacent ones don't."""
    known = (a_from.isNotNull() | a_until.isNotNull()) & (b_from.isNotNull() | b_until.isNotNull())
    return known & (a_from.isNull() | b_until.isNull() | (a_from < b_until)) & (b_from.isNull() | a_until.isNull() | (b_from < a_until))


def precedes(a_until: Column, b_from: Column) -> Column:
    """Whether the first period ends no later than the second begins."""
    return F.coalesce(a_until <= b_from, F.lit(False))


def overlapping_pairs(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of claims (a.*, b.* as structs) of equal keys whose periods overlap, a.claim_id < b.claim_id.

    Each period is laid over buckets of time and joined by keys and bucket, so that a key with many claims is spread
    and only claims of the same time meet; a pair is kept in the first bucket that both cover. Open and very long
    periods meet every claim of their key, in a join of their own.
    """
    c = claims.where("valid_from is not null or valid_until is not null")
    day = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    first, last = F.floor(day(F.col("valid_from")) / BUCKET_DAYS), F.floor((day(F.col("valid_until")) - 1) / BUCKET_DAYS)
    c = c.withColumn("__b0", first).withColumn("__b1", F.greatest(last, first))
    long_ = F.col("valid_from").isNull() | F.col("valid_until").isNull() | (F.col("__b1") - F.col("__b0") >= MOST_BUCKETS)
    row = F.struct(*[x for x in c.columns if not x.startswith("__")])
    k = [F.col(x).alias(f"__k{i}") for i, x in enumerate(keys)]
    on = [f"__k{i}" for i in range(len(keys))]
    short = c.where(~long_).select(*k, "__b0", F.explode(F.sequence("__b0", "__b1")).alias("__b"), row.alias("r"))
    a, b = short.select(*on, "__b", F.col("__b0").alias("__a0"), F.col("r").alias("a")), short.select(*on, "__b", F.col("__b0").alias("__c0"), F.col("r").alias("b"))
    near = a.join(b, [*on, "__b"]).where((F.col("__b") == F.greatest("__a0", "__c0")) & (F.col("a.claim_id") < F.col("b.claim_id"))).select("a", "b")
    wide = c.where(long_).select(*k, row.alias("a"))
    every = c.select(*k, row.alias("b"), long_.alias("__long"))
    far = wide.join(every, on).where((F.col("a.claim_id") != F.col("b.claim_id")) & (~F.col("__long") | (F.col("a.claim_id") < F.col("b.claim_id"))))
    swap = F.col("a.claim_id") > F.col("b.claim_id")
    far = far.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return near.unionByName(far).where(overlaps(F.col("a.valid_from"), F.col("a.valid_until"), F.col("b.valid_from"), F.col("b.valid_until")))


def conflicts(claims: DataFrame) -> DataFrame:
    """Verdicts on pairs of claims of one subject and predicate with different objects at the same time.

    claim_a, claim_b, verdict, loser: the better basis wins; else the later start, the other is superseded; else both
    are disputed and loser is null. basis is a number, greater is better, null the least; a null start is the earliest.
    """
    p = overlapping_pairs(claims, ["subject", "predicate"]).where(~F.col("a.object").eqNullSafe(F.col("b.object")))
    ba, bb = F.coalesce("a.basis", F.lit(-1)), F.coalesce("b.basis", F.lit(-1))
    fa, fb = F.coalesce("a.valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("b.valid_from", F.lit("0001-01-01").cast("date"))
    rule = F.when(ba != bb, "basis").when(fa != fb, "later_start").otherwise("contradiction")
    loser = F.when(ba < bb, F.col("a.claim_id")).when(ba > bb, F.col("b.claim_id")).when(fa < fb, F.col("a.claim_id")).when(fa > fb, F.col("b.claim_id"))
    return p.select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), rule.alias("verdict"), loser.alias("loser"))


def statuses(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claim_id and status of every claim: disputed beats superseded beats active."""
    lost = verdicts.where("loser is not null").select(F.col("loser").alias("claim_id"), F.lit(1).alias("s"))
    both = verdicts.where("loser is null").select(F.explode(F.array("claim_a", "claim_b")).alias("claim_id"), F.lit(2).alias("s"))
    worst = lost.unionByName(both).groupBy("claim_id").agg(F.max("s").alias("s"))
    return claims.select("claim_id").join(worst, "claim_id", "left").select("claim_id", F.when(F.col("s") == 2, "disputed").when(F.col("s") == 1, "superseded").otherwise("active").alias("status"))


def as_of(claims: DataFrame, day: str) -> DataFrame:
    """Claims that hold on a day; null ends are open."""
    t = F.lit(day).cast("date")
    return claims.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))


def current_state(claims: DataFrame, status: DataFrame, day: str) -> DataFrame:
    """Active claims that hold on a day."""
    return as_of(claims, day).join(status.where("status = 'active'").select("claim_id"), "claim_id", "left_semi")


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths subject -> middle -> object over two sets of claims whose periods overlap where both are known."""
    a = first.select(F.col("claim_id").alias("first_claim"), "subject", F.col("object").alias("middle"), F.col("valid_from").alias("af"), F.col("valid_until").alias("au"))
    b = second.select(F.col("claim_id").alias("second_claim"), F.col("subject").alias("middle"), "object", F.col("valid_from").alias("bf"), F.col("valid_until").alias("bu"))
    unknown = F.col("af").isNull() & F.col("au").isNull() | F.col("bf").isNull() & F.col("bu").isNull()
    return a.join(b, "middle").where(unknown | overlaps(F.col("af"), F.col("au"), F.col("bf"), F.col("bu"))).select("first_claim", "second_claim", "subject", "middle", "object")
