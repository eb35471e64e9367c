import hashlib

import pytest
from pyspark.sql import functions as F

from lessonloom.operators import editorial as E
from lessonloom.operators import extension, memo
from lessonloom.sources import archives


def column(spark, values, make):
    df = spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)], "k int, a string, b string" if isinstance(values[0], tuple) else "k int, a string")
    return [r.y for r in df.withColumn("y", make).orderBy("k").collect()]


def test_observable_objectives(spark):
    texts = ["Sau bài này, người học có thể phân  biệt dropout và weight decay", "You can explain backpropagation", "tính toán gradient", "Hiểu về dropout", "Explained well", None, ""]
    assert column(spark, texts, E.observable(F.col("a"))) == [True, True, True, False, False, None, False]


def test_canonical_objectives(spark):
    rows = [("Phân biệt quá khớp và thiếu khớp trên tập kiểm định, rồi sửa.", "Quá khớp"), ("Hiểu về cách dropout giảm quá khớp của mạng", "Dropout"), ("Dropout", "  Dropout. "), (None, "Dropout"), ("Dropout", None)]
    got = column(spark, rows, E.canonical_objective(F.col("a"), F.col("b")))
    role = "Người học có thể mô tả vai trò của {} trong nội dung đang học."
    assert got == ["Phân biệt quá khớp và thiếu khớp trên tập kiểm định.", "Người học có thể mô tả cách dropout giảm quá khớp của mạng.", role.format("Dropout"), role.format("Dropout"), role.format("")]
    assert column(spark, [(role.format("Dropout"), "Dropout"), ("người học có thể giải thích khái niệm DROPOUT.", "Dropout"), ("khác", "Dropout")], E.is_fallback(F.col("a"), F.col("b"))) == [True, True, False]


def test_fillers_and_titles(spark):
    assert column(spark, ["the dataset chưa connected yet", "Only model name", "dataset v2 only", "initialize  problem", "disconnected code", None], E.raw_filler(F.col("a"))) == ["raw 'connected' filler", "raw 'Only ...' filler", "raw 'Only ...' filler", "raw 'Initialize Problem' filler", None, None]
    df = spark.createDataFrame([(0, ["A", " B. ", " "], "x", 3, 3), (1, [], "ab\n  long line \nz", 3, 5), (2, None, None, 1, 2), (3, ["-"], "abc", 1, 1)], "k int, h array<string>, t string, f int, l int")
    got = [r.y for r in df.withColumn("y", E.unit_title(F.col("h"), F.col("t"), F.lit("Base"), F.col("f"), F.col("l"))).orderBy("k").collect()]
    assert got == ["B · trang 3", "long line · trang 3–5", "Base · trang 1–2", "Base · trang 1"]


def test_stored_outputs_are_checked_anew(spark):
    rows = [("a", "READY", "ok", None), ("b", "READY", "bad", None), ("c", "FAILED", "ok", memo.REFUSED), ("d", "FAILED", "ok", "TIMEOUT"), ("e", "FAILED", None, memo.REFUSED), ("f", "READY", None, None)]
    cache = spark.createDataFrame(rows, "cache_key string, status string, output string, error string")
    got = {r.cache_key: (r.status, r.error) for r in memo.revalidated(cache, F.when(F.col("output") == "bad", "BAD")).collect()}
    assert got == {"a": ("READY", None), "b": ("FAILED", memo.REFUSED), "c": ("READY", None), "d": ("FAILED", "TIMEOUT"), "e": ("FAILED", memo.REFUSED), "f": ("FAILED", memo.REFUSED)}
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = memo.intact(spark.createDataFrame([("a", "x", h("x")), ("b", "y", h("x")), ("c", None, h("x"))], "cache_key string, output string, output_sha256 string"))
    assert [r.cache_key for r in kept.collect()] == ["a"]


def test_frozen_resolved_and_built(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    path = f"file://{tmp_path}/snapshot"
    assert memo.frozen(df, path).count() == 2 and memo.frozen(df.repartition(3), path).count() == 2
    with pytest.raises(ValueError):
        memo.frozen(df.filter("k = 1"), path)
    other = spark.createDataFrame([(2, "late"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in memo.resolved("k", df, other).collect()) == [(1, "x"), (2, None), (3, "z")]
    assert memo.built({"t": df}, {"keys": lambda t: t["t"].select("k")})["keys"].columns == ["k"]
    withs = df.withColumn("h", F.lit("old"))
    a, b = (withs.withColumn("h", memo.self_digest(withs, "h")), withs.withColumn("h", F.lit("other")))
    assert a.select("h").collect() == b.withColumn("h", memo.self_digest(b, "h")).select("h").collect()


def test_failing_batches_are_halved(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(batch):
        with open(log, "a") as f:
            f.write(f"{len(batch)}\n")
        return [{"v": 10 // r["n"]} for r in batch]

    df = spark.createDataFrame([(f"k{i}", i % 16) for i in range(16)], "k string, n int").coalesce(1)
    out = {r.k: (r.status, r.error) for r in extension.bisected(df, "k", ["n"], call).collect()}
    assert out["k0"][0] == "FAILED" and "ZeroDivision" in out["k0"][1] and all(out[f"k{i}"] == ("READY", None) for i in range(1, 16))
    assert sorted(map(int, open(log).read().split())) == [1, 1, 2, 2, 4, 4, 8, 8, 16]


def test_inventory_is_verified_again(spark):
    h = lambda x: hashlib.sha256(x).hexdigest()
    listed = spark.createDataFrame([("a", 1, h(b"a")), ("b", 2, h(b"b")), ("c", 1, "sha256:" + h(b"x")), ("d", 1, h(b"d"))], "path string, size int, sha256 string")
    files = spark.createDataFrame([("a", bytearray(b"a")), ("b", bytearray(b"b")), ("c", bytearray(b"c")), ("e", bytearray(b"e"))], "path string, content binary")
    assert {tuple(r) for r in archives.reverified(listed, files).collect()} == {("b", "SIZE"), ("c", "HASH"), ("d", "MISSING"), ("e", "UNLISTED")}


def test_addresses_paths_and_zones(spark):
    from lessonloom.operators import content, study
    from lessonloom.plans import links

    urls = ["https://a.b/c", "http://u@h/", "ftp://a", "https:///x", "https://a b", None]
    assert column(spark, urls, content.link_problem(F.col("a"))) == [None, "CREDENTIALS", "SCHEME", "HOST", "BLANK", None]
    assert links.changed_paths({"a": [1, {"b": 2}], "c": 1}, {"a": [1, {"b": 3}], "d": 1}) == ["$.a[1].b", "$.c", "$.d"]
    assert links.changed_paths([1], [1, 2], "$") == ["$"] and links.changed_paths(1, True) == ["$"] and links.changed_paths(None, None) == []
    assert links.key_paths({"a": {"K": 1}, "k": [{"k": {"k": 2}}]}, frozenset({"k"})) == ["$.a.K", "$.k", "$.k[0].k", "$.k[0].k.k"]
    ms = spark.createDataFrame([(1_710_054_000_000,), (1_710_057_600_000,), (0,)], "ms long")  # the night New York's clocks go forward
    got = [(str(r.d), r.m) for r in ms.select(study.zone_day(F.col("ms"), "America/New_York").alias("d"), study.zone_midnight(F.col("ms"), "America/New_York").alias("m"), "ms").orderBy("ms").collect()]
    assert got == [("1969-12-31", -68_400_000), ("2024-03-10", 1_710_046_800_000), ("2024-03-10", 1_710_046_800_000)]
