"""Tables out: data first, one pointer last; keep-latest upserts; content-addressed files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lessonloom.operators.memo import manifest, manifest_differences, member_digest
from lessonloom.operators.study import latest
from lessonloom.runtime import materialize

_POINTER = "seq long, version string, folder string"


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not written yet
        return None


def install(spark: SparkSession, root: str, members: dict[str, DataFrame]) -> str:
    """Write members, verify what is read back against what was written, then add a pointer; the version: a digest of the members' digests.

    Each member is evaluated once: its digest is observed while it is written. The pointer is a new file beside the old
    ones, never an overwrite, so a crash at any time leaves the catalog that was there.
    """
    folder, seen = uuid.uuid4().hex, []
    for name, df in sorted(members.items()):
        watch = Observation(f"written-{name}-{folder}")
        rows, parts = member_digest(df)
        df.observe(watch, rows.alias("rows"), *[p.alias(f"p{k}") for k, p in enumerate(parts)]).write.parquet(f"{root}/data/{folder}/{name}")
        seen.append((name, *(watch.get[k] for k in ("rows", "p0", "p1", "p2", "p3"))))
    wanted = spark.createDataFrame(seen, "member string, rows long, p0 string, p1 string, p2 string, p3 string")
    wanted = wanted.select("member", "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "p0", "p1", "p2", "p3").cast("binary"), 256).alias("sha256"))
    back = {n: spark.read.schema(df.schema).parquet(f"{root}/data/{folder}/{n}") for n, df in members.items()}
    made = materialize(manifest(back), "manifest") if back else wanted
    if not manifest_differences(wanted, made).isEmpty():
        raise ValueError("the written members differ from those given")
    made.coalesce(1).write.parquet(f"{root}/data/{folder}/_manifest")
    whole = made.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "member", "sha256"))), "\n").cast("binary"), 256).alias("v")).first().v
    old = _read(spark, f"{root}/current", _POINTER)
    seq = (old.agg(F.max("seq").alias("s")).first().s or 0) + 1 if old is not None else 1
    spark.createDataFrame([(seq, whole, folder)], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return whole


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A member of the newest version."""
    at = spark.read.schema(_POINTER).parquet(f"{root}/current").agg(F.max(F.struct("seq", "version", "folder")).alias("p")).first().p
    return spark.read.parquet(f"{root}/data/{at.folder}/{name}")


def verified(spark: SparkSession, root: str) -> DataFrame:
    """(member, state) of members of the newest version that are missing, added or changed since it was installed."""
    at = spark.read.schema(_POINTER).parquet(f"{root}/current").agg(F.max(F.struct("seq", "version", "folder")).alias("p")).first().p
    kept = spark.read.parquet(f"{root}/data/{at.folder}/_manifest")
    names = [r.member for r in kept.select("member").collect()]  # one row a table
    found = {n: df for n in names if (df := _any(spark, f"{root}/data/{at.folder}/{n}")) is not None}
    return manifest_differences(kept, manifest(found)) if found else kept.select("member", F.lit("missing").alias("state"))


def _any(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows, the last of each key."""
    return latest(old.unionByName(new), key, order)


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows of keys that aren't there, each once."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")


_BLOB = "sha256 string, content binary, prefix string"


def write_blobs(files: DataFrame, path: str) -> None:
    """Content-addressed: each digest once, in folders by its first digits; digests that are there already are not written again.

    Raises if one digest has two contents, among the new ones or against what is there.
    """
    spark = files.sparkSession
    keyed = files.filter("sha256 IS NOT NULL").select("sha256", "content", F.sha2("content", 256).alias("real"), F.left(F.regexp_replace("sha256", "^sha256:", ""), F.lit(2)).alias("prefix"))
    if not keyed.groupBy("sha256").agg(F.count_distinct("real").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("one digest has several contents")
    new, old = keyed.dropDuplicates(["sha256"]), _read(spark, path, _BLOB)
    if old is not None:
        had = old.select("sha256", F.sha2("content", 256).alias("had"))
        if not new.join(had, "sha256").filter("real <> had").isEmpty():
            raise ValueError("a digest that is there has another content")
        new = new.join(had.select("sha256"), "sha256", "left_anti")
    new.select("sha256", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(path)
