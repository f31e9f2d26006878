import random

from quillmesh.operators import hierarchy as H
from quillmesh.operators.hierarchy import closure, hierarchy


def run(spark, edges):
    return {r.node: r for r in hierarchy(spark.createDataFrame(edges, "node string, parent string")).collect()}


def brute(edges):
    parent = {}
    for n, p in edges:
        if n is not None:
            parent[n] = min([x for x in (parent.get(n), p) if x is not None], default=None)
        if p is not None:
            parent.setdefault(p, None)
    out = {}
    for n in parent:
        path, seen = [n], {n}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        out[n] = path[::-1] if parent[path[-1]] is None else None
    return out


def check(got, edges):
    want = brute(edges)
    assert set(got) == set(want)
    for n, path in want.items():
        r = got[n]
        if path is None:
            assert not r.rooted and r.path is None and r.depth is None
        else:
            assert r.rooted and r.path == path and r.depth == len(path) and r.root == path[0]
            below = sum(1 for p in want.values() if p and n in p) - 1
            assert r.descendants == below
            for m, other in want.items():
                if other and other[0] == path[0]:
                    inside = r.tour_in <= got[m].tour_in and got[m].tour_out <= r.tour_out
                    assert inside == (n in other)


def test_tree_cycles_and_only_parents(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "b"), ("d", None), ("e", None), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), (None, "a"), ("t", "s")]
    got = run(spark, edges)
    check(got, edges)
    assert {n for n, r in got.items() if r.on_cycle} == {"x", "y", "z", "s"} and {n for n, r in got.items() if not r.rooted} == {"x", "y", "z", "w", "s", "t"}


def test_random_forests_in_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 7)
    monkeypatch.setattr(H, "CHILDREN_PER_BUCKET", 3)
    monkeypatch.setattr(H, "PEEL_ROUNDS", 2)
    r = random.Random(4)
    edges = [(f"n{i}", f"n{r.randrange(max(1, i // 2), i + 1) if r.random() < 0.1 else r.randrange(0, i)}") for i in range(1, 60)]
    edges += [("n0", None), ("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("k4", "k3"), ("k5", "k4"), ("k6", "k5"), ("k7", "k6")]
    check(run(spark, edges), edges)


def test_long_chain_and_wide_parent(spark):
    edges = [(f"c{i:04d}", f"c{i - 1:04d}") for i in range(1, 300)] + [(f"w{i}", "hub") for i in range(500)]
    got = run(spark, edges)
    assert got["c0299"].depth == 300 and got["c0000"].descendants == 299 and got["hub"].descendants == 500


def test_closure_empty_and_conflict(spark):
    tree = hierarchy(spark.createDataFrame([("b", "a", 1), ("c", "b", 2), ("c", "a", 3)], "node string, parent string, path int"))
    assert {(r.ancestor, r.descendant, r.distance) for r in closure(tree).collect()} == {("a", "b", 1), ("a", "c", 1)}
    assert [r.node for r in tree.where("conflict").collect()] == ["c"]
    empty = hierarchy(spark.createDataFrame([], "node string, parent string"))
    assert empty.count() == 0 and closure(empty).count() == 0
    long = "x" * 100_000
    assert hierarchy(spark.createDataFrame([(long, "a")], "node string, parent string")).where("depth = 2").count() == 1
