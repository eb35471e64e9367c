import random

import pytest
from pyspark.sql import functions as F

from lessonloom.operators import hierarchy as H


def brute(rows):
    """Cycles and forest by plain walks."""
    nodes = {}
    for v, ps in rows:
        if v is not None:
            nodes.setdefault(v, ps)
    up = {v: [p for p in dict.fromkeys(ps or []) if p in nodes] for v, ps in nodes.items()}

    def reach(v):
        seen, todo = set(), list(up[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    r = {v: reach(v) for v in up}
    cycles = {v: min([w for w in r[v] if v in r[w]] + [v]) for v in up if v in r[v]}
    paths = {}
    for v in up:
        path, x = [], v
        while x is not None and x not in path:
            path.append(x)
            x = up[x][0] if up[x] else None
        paths[v] = None if x is not None else path[::-1]
    return cycles, paths


def tree(spark, rows, **k):
    df = spark.createDataFrame(rows, "node string, prev array<string>")
    nodes, edges = H.links(df, node="node", parents="prev")
    return H.hierarchy(nodes, edges, **k), H.cycles(edges, **k)


def check(spark, rows, **k):
    t, c = tree(spark, rows, **k)
    cycles, paths = brute(rows)
    assert {r.v: r.cycle_id for r in c.collect()} == cycles
    got = {r.v: r for r in t.collect()}
    shown = {r.v: r.path for r in H.paths(t).collect()}
    assert set(got) == set(paths) and set(shown) == {v for v, p in paths.items() if p}
    some = t.filter("depth >= 1").limit(3)
    assert {r.v: r.path for r in H.paths(t, some).collect()} == {r.v: paths[r.v] for r in some.collect()}
    for v, p in paths.items():
        r = got[v]
        assert shown.get(v) == p and len(r.segments or []) <= max(1, len(paths).bit_length())
        assert r.depth == (None if p is None else len(p) - 1)
        assert r.root == (None if p is None else p[0])
        assert r.cycle_id == cycles.get(v)
        if p is not None:
            below = {w for w, q in paths.items() if q and v in q and w != v}
            assert r.descendants == len(below)
            assert {w for w in got if got[w].root == r.root and r.enter < (got[w].enter or 0) <= r.leave} == below
    below = {(a, b) for b, q in paths.items() if q for a in q[:-1]}
    assert {(r.ancestor, r.descendant) for r in H.descendants(t, block=3).collect()} == below


@pytest.mark.parametrize("core", [H.CORE_LINKS, 0])
def test_chains_hubs_and_loops(spark, core):
    rows = [("r", None), ("a", ["r"]), ("b", ["a", "r"]), ("c", ["x", "b"]), *[(f"k{i}", ["a"]) for i in range(9)], *[(f"d{i:02}", [f"d{i - 1:02}" if i else "k3"]) for i in range(40)]]
    rows += [("l1", ["l2"]), ("l2", ["l3", "r"]), ("l3", ["l1"]), ("m", ["l1", "a"]), ("s", ["s"]), ("n", [None, "a", "a"]), ("z1", ["a", "z2"]), ("z2", ["z1", "m"]), (None, ["a"])]
    check(spark, rows, core_links=core)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:02}" for i in range(40)]
    rows = [(v, r.sample(ids, r.choice([0, 1, 1, 1, 2]))) for v in ids]
    check(spark, rows, core_links=0 if seed == 1 else 10**6)


def test_empty_and_repeated(spark):
    t, c = tree(spark, [])
    assert t.count() == 0 and c.count() == 0
    check(spark, [("a", None), ("a", None), ("b", ["a"]), ("b", ["a"])])
    df = spark.createDataFrame([("a", ["b"], 2), ("a", ["c"], 1), ("b", [], 1), ("c", [], 1)], "node string, prev array<string>, at int")
    _, edges = H.links(df.withColumn("v", F.lit(1)).withColumn("p", F.lit(2)), node="node", parents="prev", arrival="at")
    assert [tuple(r) for r in edges.collect()] == [("a", "c", 0)]


@pytest.mark.parametrize("length", [3, 10, 1000])
def test_long_run_closes_a_cycle(spark, length):
    rows = [("m", ["s0000", "x"]), ("x", []), *[(f"s{i:04}", [f"s{i + 1:04}" if i + 1 < length else "m"]) for i in range(length)]]
    rows += [("o1", ["o2"]), ("o2", ["o1"]), ("q", ["o1"])]
    _, edges = H.links(spark.createDataFrame(rows, "node string, prev array<string>"), node="node", parents="prev")
    want = {"m": "m"} | {f"s{i:04}": "m" for i in range(length)}
    assert {r.v: r.cycle_id for r in H.cycles(edges).collect()} == {v: "m" for v in want} | {"o1": "o1", "o2": "o1"}
