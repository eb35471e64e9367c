import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lessonloom.llm import packing as P


@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 60))
@settings(max_examples=80, deadline=None)
def test_fill_is_the_best_subset(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    got = P.fill(lengths, capacity)
    best = max(sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= capacity)
    assert sum(lengths[k] for k in got) == best and len(set(got)) == len(got)


def test_pack_fits_and_wastes_little():
    r = random.Random(3)
    sizes = [int(r.expovariate(1 / 200)) % 1000 + 1 for _ in range(3000)]
    where = P.pack(sizes, 1024)
    load = {}
    for n, b in zip(sizes, where):
        load[b] = load.get(b, 0) + n
    assert max(load.values()) <= 1024
    assert len(load) <= 1.01 * sum(sizes) / 1024 + 1


def test_rows(spark):
    items = spark.createDataFrame([(1, 1300), (2, 500), (3, 12), (3, 12), (4, 0), (5, None), (None, 9), (6, 512)], "doc_id long, n_tokens int")
    caps = spark.createDataFrame([("s", 512), ("b", 2048), (None, 10), ("z", 0), ("n", None)], "container_name string, capacity_tokens int")
    rows = P.pack_items(items, caps).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    assert all(sum(x.piece_tokens for x in v) <= v[0].capacity_tokens and len({x.container_name for x in v}) == 1 for v in by.values())
    for name in "sb":
        got = sorted((r.doc_id, r.piece_tokens) for r in rows if r.container_name == name)
        assert sum(n for _, n in got) == 1300 + 500 + 12 + 512
    assert [r.n_pieces for r in rows if r.container_name == "s" and r.doc_id == 1] == [3, 3, 3]
    assert len({r.container_id for r in rows if r.container_name == "b"}) == 2
    assert P.pack_items(items.limit(0), caps).count() == 0 and P.pack_items(items, caps.limit(0)).count() == 0
    assert P.fill_report(P.pack_items(items, caps)).count() == 2
