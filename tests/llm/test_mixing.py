from pyspark.sql import functions as F

from lessonloom.llm import mixing as M


def test_water_fill_clamps_and_shares_the_rest():
    got = M.water_fill(100, [("a", 0.5, 10), ("b", 0.3, 1000), ("c", 0.2, 1000), ("d", 0.0, 50)])
    assert got["a"] == 10 and abs(got["b"] - 54) < 1e-9 and abs(got["c"] - 36) < 1e-9 and got["d"] == 0
    assert M.water_fill(100, [("a", 1.0, 30)]) == {"a": 30}
    assert M.water_fill(5, []) == {}


def rows(spark):
    return spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "big").when(F.col("id") < 2040, "tiny").otherwise(F.when(F.col("id") < 2900, "mid")).alias("source"), (F.col("id") % 90 + 10).alias("n_tokens"))


def test_shares_caps_and_seeds(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.2, 3), ("mid", 0.2, None), ("none", 0.1, 4), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    items = rows(spark)
    plan = M.plan(items, targets, total_tokens=60_000)
    drawn = M.draw(items, plan)
    p = {r.source: r for r in plan.collect()}
    most = {r.source: r.n_tokens for r in items.groupBy("source").agg(F.max("n_tokens").alias("n_tokens")).collect()}
    s = {r.source: r for r in M.shares(plan, drawn).collect()}
    for k, r in s.items():
        assert r.most_repeats <= {"big": 1, "tiny": 3, "mid": 1, "none": 4}[k]
        assert r.planned_tokens - r.drawn_tokens <= most.get(k, 0) and r.drawn_tokens <= r.planned_tokens
    assert p["tiny"].planned_tokens == 3 * p["tiny"].tokens and s["none"].drawn_tokens == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    again = M.draw(items.repartition(7), plan)
    assert sorted(again.collect()) == sorted(drawn.collect())
    assert sorted(M.draw(items, plan, seed=1).collect()) != sorted(drawn.collect())


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    items = rows(spark).limit(0)
    plan = M.plan(items, targets)
    assert M.draw(items, plan).count() == 0 and M.shares(plan, M.draw(items, plan)).first().actual_share == 0
    assert M.plan(rows(spark), targets.limit(0)).count() == 0
