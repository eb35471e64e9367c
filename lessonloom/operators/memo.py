"""Incremental work: keys of inputs, results reused by anti join, upserts, manifests and counts of what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_key(step: str, version: str, *parts: Column) -> Column:
    """Digest of a step, its version and its inputs; nulls are told apart from empty strings."""
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(step), F.lit(version), *shown).cast("binary"), 256)


#: Columns of a cache of results; it is partitioned by step and read by key, which takes the place of an index.
CACHE = "cache_key string, step string, status string, output string, output_sha256 string, error string, updated_at timestamp"
PARTITIONED_BY = ("step",)
#: The only failure that a new check may lift; failures of the call itself are never lifted.
REFUSED = "OUTPUT_VALIDATION_FAILED"


def revalidated(cache: DataFrame, problem: Column) -> DataFrame:
    """The cache with every stored output checked anew: READY rows with a problem are refused, refused ones without are READY."""
    stored = F.col("output").isNotNull()
    ready = F.when((F.col("status") == "READY") & (~stored | problem.isNotNull()), "FAILED").when((F.col("status") == "FAILED") & (F.col("error") == REFUSED) & stored & problem.isNull(), "READY").otherwise(F.col("status"))
    error = F.when(ready == "READY", F.lit(None).cast("string")).when(F.col("status") == "READY", F.lit(REFUSED)).otherwise(F.col("error"))
    return cache.withColumns({"status": ready, "error": error})


def intact(cache: DataFrame) -> DataFrame:
    """Rows whose output still has the digest stored beside it; the others count as not there."""
    return cache.filter(F.sha2(F.col("output").cast("binary"), 256).eqNullSafe(F.col("output_sha256")))


def self_digest(df: DataFrame, own: str, *others: str) -> Column:
    """The digest of a row without the field that holds it (and ``others``, such as paths of a machine)."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(df.drop(own, *others)).cast("binary"), 256))


def frozen(df: DataFrame, path: str) -> DataFrame:
    """Write once: the first call writes ``df``, later ones return what is there and raise if the input has drifted from it."""
    spark = df.sparkSession
    try:
        kept = spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not manifest_differences(manifest({"input": kept}), manifest({"input": df})).isEmpty():
        raise ValueError("the input has drifted from its frozen copy")
    return kept


def resolved(key: str, *sources: DataFrame) -> DataFrame:
    """Each key's row from the first of the sources that has it."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key), key, "left_anti"))
    return out


def built(tables: dict[str, DataFrame], builders: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Members by name, each built by its own function of the tables."""
    return {name: make(tables) for name, make in builders.items()}


def missing(inputs: DataFrame, cache: DataFrame, *, key: str = "cache_key") -> DataFrame:
    """Inputs without a READY result."""
    return inputs.join(cache.filter("status = 'READY'").select(key).distinct(), key, "left_anti")


def run(inputs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], *, key: str = "cache_key") -> DataFrame:
    """The cache with the results of missing inputs added; only those are computed."""
    return cache.join(missing(inputs, cache, key=key).select(key), key, "left_anti").unionByName(compute(missing(inputs, cache, key=key)))


def canonical_json(df: DataFrame) -> Column:
    """Rows as JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def member_digest(df: DataFrame) -> tuple[Column, list[Column]]:
    """The row count and four sums of a table's row digests, as aggregates: commutative, combined before the shuffle, exact."""
    h = F.sha2(canonical_json(df).cast("binary"), 256)
    zero = F.lit(0).cast("decimal(38,0)")
    return F.count(F.lit(1)), [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), zero).cast("string") for k in range(4)]


def manifest(members: dict[str, DataFrame]) -> DataFrame:
    """(member, rows, sha256): a digest of each table that doesn't depend on the order of rows or partitions."""
    out = None
    for name, df in sorted(members.items()):
        rows, parts = member_digest(df)
        row = df.agg(rows.alias("rows"), F.sha2(F.concat_ws("|", rows.cast("string"), *parts).cast("binary"), 256).alias("sha256")).select(F.lit(name).alias("member"), "rows", "sha256")
        out = row if out is None else out.unionByName(row)
    return out


def manifest_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Members that are missing, added or changed."""
    j = expected.select("member", F.col("sha256").alias("want")).join(actual.select("member", F.col("sha256").alias("got")), "member", "full_outer")
    return j.withColumn("state", F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "added").when(F.col("want") != F.col("got"), "changed")).filter("state IS NOT NULL").select("member", "state")
