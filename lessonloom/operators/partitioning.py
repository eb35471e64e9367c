"""Ordered data cut into contiguous parts: page ranges, balanced groups, fixed and even splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.operators.content import running_totals
from lessonloom.runtime import materialize


def page_ranges(page_count: Column, size: int) -> Column:
    """Array of (page_start, page_end), each ``size`` pages, covering 1 to page_count once."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), page_count), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("page_start"), F.least(page_count, s + (size - 1)).alias("page_end")))


def gaps(parts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Parts that don't continue at the page after the one before them (the first at page 1)."""
    w = W.partitionBy(key).orderBy(start, end)
    return parts.withColumn("expected", F.coalesce(F.lag(end).over(w) + 1, F.lit(1))).filter(F.col(start) != F.col("expected"))


def uncovered(wholes: DataFrame, parts: DataFrame, key: str, size: str, start: str, end: str) -> DataFrame:
    """(key, page_from, page_to): the pages 1 to ``size`` that no part holds, as ranges.

    Parts are merged by running ends over their different bounds, so a long document costs its parts, not its pages.
    """
    own = wholes.groupBy(key).agg(F.max(F.col(size).cast("long")).alias("_n"))
    some = parts.filter(f"{start} <= {end} AND {end} >= 1").groupBy(key, F.col(start).cast("long").alias("_a")).agg(F.max(F.col(end).cast("long")).alias("_b"))
    some = some.join(own, key).filter("_a <= _n").select(key, "_a", "_b")
    last = own.select(key, (F.col("_n") + 1).alias("_a"), (F.col("_n") + 1).alias("_b"))
    w = W.partitionBy(key).orderBy("_a").rowsBetween(W.unboundedPreceding, -1)
    return some.unionByName(last).withColumn("_to", F.coalesce(F.max("_b").over(w), F.lit(0))).filter("_a > _to + 1").select(key, (F.col("_to") + 1).alias("page_from"), (F.col("_a") - 1).alias("page_to"))


def atom_count(groups: Column, target: int, most: int = 5) -> Column:
    return F.least(F.lit(most), groups, F.greatest(F.lit(1), F.ceil(groups / target))).cast("int")


def balanced_parts(groups: DataFrame, key: str, order: str, weight: str, *, target: int = 4, most: int = 5) -> DataFrame:
    """(key, order, part): every key's ordered groups in contiguous parts of nearly equal weight; a weight counts 1 at least.

    Each part but the last ends at the group whose running weight is nearest to an even share of what is left, the
    earlier of two equally near, and leaves a group for each part behind it. One combined minimum a part over running
    weights: no key is gathered in one place, however many groups it has.
    """
    w = groups.select(key, F.col(order).cast("long").alias("o"), F.greatest(F.lit(1), F.coalesce(F.col(weight), F.lit(0))).cast("long").alias("w"), F.lit(1).cast("long").alias("one"))
    at = materialize(running_totals(w, [key], ["o"], {"w": "upto", "one": "no"}), "weights")
    state = at.groupBy(key).agg(F.max("no").alias("n"), F.max("upto").alias("total"))
    state = materialize(state.select(key, "n", "total", atom_count(F.col("n"), target, most).alias("parts"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("done"), F.array().cast("array<bigint>").alias("cuts")), "state")
    for part in range(most - 1):
        left = F.col("parts") - part
        away = F.abs(F.col("upto") - F.col("done") - (F.col("total") - F.col("done")) / left)
        inside = (left > 1) & (F.col("no") > F.col("taken")) & (F.col("no") <= F.col("n") - left + 1)
        cut = at.join(state, key).filter(inside).groupBy(key).agg(F.min(F.struct(away.alias("away"), "no", "upto")).alias("c"))
        state = materialize(state.join(cut, key, "left").select(key, "n", "total", "parts", F.coalesce("c.no", "taken").alias("taken"), F.coalesce("c.upto", "done").alias("done"), F.when(F.col("c").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.col("c.no"))).alias("cuts")), "state")
    part_of = F.size(F.filter("cuts", lambda c: c < F.col("no")))
    return at.join(state.select(key, "cuts"), key).select(key, F.col("o").alias(order), part_of.alias("part"))


def fixed_groups(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    return rows.withColumn("group_no", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size))


def even_groups(rows: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    return rows.withColumn("tile", F.ntile(count).over(W.partitionBy(key).orderBy(*order)))


def adjacent_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Numbers the runs of equal neighbouring values."""
    w = W.partitionBy(key).orderBy(*order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return rows.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
