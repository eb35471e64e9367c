from datetime import datetime

from pyspark.sql import functions as F

from lessonloom.operators.references import Parent, Reference, orphans, report

D = lambda m, d=1: datetime(2025, m, d)


def run(spark, refs, parents, **k):
    a = spark.createDataFrame(refs, "rid string, ids array<string>, one string, at timestamp_ntz, target string")
    b = spark.createDataFrame(parents, "k string, at timestamp_ntz, gone timestamp_ntz")
    specs = [Reference("t", a, "rid", "ids", "p", "at"), Reference("t", a, "rid", "one", "p", "at")]
    return orphans(specs, [Parent("p", b, F.col("k"), "at", "gone")], **k)


def test_reasons_and_ties(spark):
    parents = [("ok", D(1), None), ("ok", D(6), None), ("del", D(1), D(2)), ("late", D(5), None), ("same", D(3), None), ("", D(1), None), ("latedel", D(9), D(10)), (None, D(1), None)]
    refs = [("r1", ["ok", "del", "late", "same", "none", None, "none", "", "latedel"], "ok ", D(3), "x"), ("r1", ["ok", "del", "late", "same", "none", None, "none", "", "latedel"], "ok ", D(4), "x"), ("r2", None, None, D(3), "y"), (None, ["none"], "none", D(3), "z")]
    want = {("ids", "del", "deleted"), ("ids", "late", "late"), ("ids", "none", "missing"), ("one", "ok ", "missing"), ("ids", "latedel", "deleted")}
    for k in ({}, {"hot": 1}):
        got = run(spark, refs, parents, **k).collect()
        assert {(r.ref_field, r.ref_id, r.reason) for r in got} == want and len(got) == len(want)
        assert {r.ref_month for r in got} == {"2025-03"} and {r.record_id for r in got} == {"r1"}


def test_empty_sides(spark):
    assert run(spark, [], [("a", D(1), None)]).count() == 0
    found = run(spark, [("r", ["a"], None, D(2), "x")], [])
    assert [r.reason for r in found.collect()] == ["missing"]
    assert report(found).collect()[0].orphan_refs == 1


def test_hot_key_is_split(spark):
    refs = [(f"r{i}", ["hot"], None, D(2), "x") for i in range(500)]
    assert run(spark, refs, [("hot", D(3), None)], hot=100).filter("reason = 'late'").count() == 500
