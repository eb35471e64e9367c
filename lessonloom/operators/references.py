"""References to records that do not exist (problem 4).

References and parents of all tables are brought together by (target, key): parents are first reduced to one validity
interval per key (from its arrival until its deletion, if it was deleted), then both sides are hash-partitioned alike, sorted by the key and
merged in one pass over the two sorted streams. Keys that hold many references are split over salted partitions; only
their parents are repeated.

Null references are none. A reference repeated inside a record counts once, redelivered records count once and with
their earliest arrival. Keys are compared exactly as stored; blank ones are ordinary keys. Null record keys are dropped.
Empty parents make every reference ``missing``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.runtime import materialize, small

#: References of one key that stay together; a key with more is split over as many partitions as it needs.
HOT = 100_000


@dataclass(frozen=True)
class Reference:
    """One reference field: its table, the record's key, the ids it holds (an array or one id) and what they name."""

    table: str
    rows: DataFrame
    record: str
    field: str
    target: str
    arrival: str = "ingested_at"


@dataclass(frozen=True)
class Parent:
    """What references may name: rows, their key (a column expression), arrival and deletion."""

    target: str
    rows: DataFrame
    key: Column
    arrival: str = "ingested_at"
    deleted: str | None = "deleted_at"


def references(specs: list[Reference]) -> DataFrame:
    """(target, ref_id, table_name, ref_field, record_id, arrived): one row per record and different id."""
    out = None
    for s in specs:
        ids = F.col(s.field) if dict(s.rows.dtypes)[s.field].startswith("array") else F.array(s.field)
        own = s.rows.select(F.lit(s.target).alias("target"), F.explode(F.array_distinct(ids)).alias("ref_id"), F.lit(s.table).alias("table_name"), F.lit(s.field).alias("ref_field"), F.col(s.record).alias("record_id"), F.col(s.arrival).alias("arrived"))
        out = own if out is None else out.unionByName(own)
    return out.filter("ref_id IS NOT NULL AND record_id IS NOT NULL").groupBy("target", "ref_id", "table_name", "ref_field", "record_id").agg(F.min("arrived").alias("arrived"))


def validity(parents: list[Parent]) -> DataFrame:
    """(target, ref_id, since, until): one interval per key of any row, open if it was never deleted."""
    out = None
    for p in parents:
        gone = F.col(p.deleted).cast("timestamp_ntz") if p.deleted else F.lit(None).cast("timestamp_ntz")
        own = p.rows.select(F.lit(p.target).alias("target"), p.key.alias("ref_id"), F.col(p.arrival).alias("since"), gone.alias("until"))
        out = own if out is None else out.unionByName(own)
    return out.filter("ref_id IS NOT NULL").groupBy("target", "ref_id").agg(F.min("since").alias("since"), F.min("until").alias("until"))


def orphans(refs: list[Reference], parents: list[Parent], *, hot: int = HOT) -> DataFrame:
    """(table_name, ref_field, record_id, ref_id, reason, ref_month) of every reference without a usable row; at most some ``hot`` references of a key meet in one partition."""
    left, right = materialize(references(refs), "references"), validity(parents)
    heavy = materialize(left.groupBy("target", "ref_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot).select("target", "ref_id", F.ceil(F.col("n") / hot).cast("int").alias("salts")), "heavy")
    if heavy.isEmpty():
        left, right = left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    else:
        left = left.join(small(heavy), ["target", "ref_id"], "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        right = right.join(small(heavy), ["target", "ref_id"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    merged = left.hint("merge").join(right.withColumn("found", F.lit(True)), ["target", "ref_id", "salt"], "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("until").isNotNull(), "deleted").when(F.col("since") > F.col("arrived"), "late")
    return merged.withColumn("reason", reason).filter("reason IS NOT NULL").select("table_name", "ref_field", "record_id", "ref_id", "reason", F.date_format("arrived", "yyyy-MM").alias("ref_month"))


def report(found: DataFrame) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    return found.groupBy("table_name", "ref_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("orphan_refs"), F.countDistinct("record_id").alias("records"))
