import datetime as dt
import random

from quillmesh.operators import claims as C

SCHEMA = "claim_id long, subject string, predicate string, object string, valid_from date, valid_until date, basis int"


def D(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def over(a, b):
    if (a[4] is None and a[5] is None) or (b[4] is None and b[5] is None):
        return False
    lo, hi = dt.date.min, dt.date.max
    return (a[4] or lo) < (b[5] or hi) and (b[4] or lo) < (a[5] or hi)


def test_random_overlaps_against_all_pairs(spark):
    r = random.Random(8)
    rows = []
    for i in range(150):
        s = r.choice([None, D(r.randrange(0, 800))])
        e = None if r.random() < 0.2 else (s or D(0)) + dt.timedelta(r.choice([0, 1, 30, 90, 20_000]))
        rows.append((i, r.choice("ab"), "p", r.choice("xyz"), s, e, r.choice([None, 0, 1])))
    got = [tuple(sorted((x.a.claim_id, x.b.claim_id))) for x in C.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), ["subject"]).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and over(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_ladder_and_statuses(spark):
    rows = [
        (1, "s", "p", "x", D(0), D(10), 1), (2, "s", "p", "y", D(5), D(15), 2), (3, "t", "p", "x", D(0), D(10), 1), (4, "t", "p", "y", D(5), D(15), 1), (5, "u", "p", "x", D(0), D(10), None), (6, "u", "p", "y", D(0), D(9), None),
        (7, "v", "p", "x", D(0), D(10), 1), (8, "v", "p", "x", D(5), D(15), 1), (9, "w", "p", "x", D(0), D(10), 1), (10, "w", "p", "y", D(10), D(15), 1), (11, "z", "p", "x", None, None, 1), (12, "z", "p", "y", D(0), None, 1),
        (13, "q", "p", "a", D(0), D(10), 1), (14, "q", "p", "b", D(0), D(10), 1), (15, "q", "p", "c", D(1), D(10), 1)]
    c = spark.createDataFrame(rows, SCHEMA)
    v = C.conflicts(c)
    assert {(r.claim_a, r.claim_b, r.verdict, r.loser) for r in v.collect()} == {(1, 2, "basis", 1), (3, 4, "later_start", 3), (5, 6, "contradiction", None), (13, 14, "contradiction", None), (13, 15, "later_start", 13), (14, 15, "later_start", 14)}
    s = C.statuses(c, v)
    st = {r.claim_id: r.status for r in s.collect()}
    assert st == {1: "superseded", 2: "active", 3: "superseded", 4: "active", 5: "disputed", 6: "disputed", 7: "active", 8: "active", 9: "active", 10: "active", 11: "active", 12: "active", 13: "disputed", 14: "disputed", 15: "active"}
    assert sorted(r.claim_id for r in C.current_state(c, s, "2020-01-06").collect()) == [2, 4, 7, 8, 9, 11, 12, 15]
    assert C.conflicts(c.limit(0)).count() == 0


def test_two_hop(spark):
    a = spark.createDataFrame([(1, "s", "p", "m", D(0), D(10), 1), (2, "s", "p", "n", None, None, 1)], SCHEMA)
    b = spark.createDataFrame([(3, "m", "p", "o", D(10), D(20), 1), (4, "m", "p", "q", D(9), D(20), 1), (5, "n", "p", "r", D(0), None, 1)], SCHEMA)
    assert {(r.first_claim, r.second_claim, r.object) for r in C.two_hop(a, b).collect()} == {(1, 4, "q"), (2, 5, "r")}
