"""Rule engine: rules as data, one ``issues(code, path, detail, severity)`` table.

Row rules of a table are evaluated together in one pass over it; reference rules are anti joins, uniqueness rules
aggregations, comparisons equi joins. A rule that can't be decided for a null (the condition is null) isn't broken.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """Broken where ``broken`` holds."""

    code: str
    table: str
    broken: Column
    detail: Column | None = None
    severity: str = "ERROR"


@dataclass(frozen=True)
class UniqueRule:
    """Broken for values that more than one different record holds."""

    code: str
    table: str
    value: Column
    severity: str = "ERROR"


@dataclass(frozen=True)
class ReferenceRule:
    """Broken for ids (an array or one value) that the target doesn't hold."""

    code: str
    table: str
    field: str
    target: str
    target_key: Column
    severity: str = "ERROR"


@dataclass(frozen=True)
class MatchRule:
    """Broken where the row that ``field`` names exists and ``broken`` holds of both (target columns as t_name)."""

    code: str
    table: str
    field: str
    target: str
    target_key: Column
    keep: dict[str, Column]
    broken: Column
    severity: str = "ERROR"


@dataclass(frozen=True)
class CountRule:
    """Broken for records that are named a number of times outside ``lo`` to ``hi``."""

    code: str
    table: str
    named_by: str
    field: str
    lo: int
    hi: int
    severity: str = "ERROR"


def _asked(ids: Column, target: str, r: ReferenceRule) -> Column:
    return F.transform(ids, lambda x: F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(target).alias("target"), x.cast("string").alias("ref")))


def issues(tables: dict[str, DataFrame], keys: dict[str, str], rules: list) -> DataFrame:
    """All issues of ``rules``; ``keys`` names each table's record key. A path is ``table:key``."""
    out: list[DataFrame] = []
    path = lambda t, c=None: F.concat(F.lit(f"{t}:"), F.coalesce((c if c is not None else F.col(keys[t])).cast("string"), F.lit("")))
    row: dict[str, list[RowRule]] = {}
    refs: dict[str, list[tuple[str, ReferenceRule]]] = {}
    wanted: dict[str, DataFrame] = {}
    unique: dict[str, list[UniqueRule]] = {}
    for r in rules:
        if isinstance(r, RowRule):
            row.setdefault(r.table, []).append(r)
        elif isinstance(r, UniqueRule):
            unique.setdefault(r.table, []).append(r)
        elif isinstance(r, ReferenceRule):
            name = f"{r.target}|{r.target_key}"
            refs.setdefault(r.table, []).append((name, r))
            wanted[name] = tables[r.target].select(F.lit(name).alias("target"), r.target_key.alias("ref"))
        elif isinstance(r, MatchRule):
            other = tables[r.target].select(r.target_key.alias("_k"), *[c.alias(f"t_{n}") for n, c in r.keep.items()]).distinct()
            j = tables[r.table].withColumn("_k", F.col(r.field)).join(other, "_k").filter(r.broken)
            out.append(j.select(F.lit(r.code).alias("code"), path(r.table).alias("path"), F.col("_k").alias("detail"), F.lit(r.severity).alias("severity")).distinct())
        elif isinstance(r, CountRule):
            t = tables[r.named_by]
            ids = F.explode("_f") if dict(t.dtypes)[r.field].startswith("array") else F.col("_f")
            named = t.select(keys[r.named_by], F.col(r.field).alias("_f")).distinct().select(ids.alias(keys[r.table])).groupBy(keys[r.table]).agg(F.count(F.lit(1)).alias("n"))
            j = tables[r.table].select(keys[r.table]).distinct().join(named, keys[r.table], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(~F.col("n").between(r.lo, r.hi))
            out.append(j.select(F.lit(r.code).alias("code"), path(r.table).alias("path"), F.col("n").cast("string").alias("detail"), F.lit(r.severity).alias("severity")))
        else:
            raise TypeError(type(r))
    # All references of a table are read in one pass, and those of all tables met with all targets in one join.
    if refs:
        asked = []
        for table, own in refs.items():
            t = tables[table]
            each = [_asked(F.col(r.field) if dict(t.dtypes)[r.field].startswith("array") else F.array(r.field), n, r) for n, r in own]
            none = F.array().cast("array<struct<code:string,severity:string,target:string,ref:string>>")
            asked.append(t.select(path(table).alias("path"), F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("x")).select("path", "x.*"))
        every = reduce(DataFrame.unionByName, asked).filter("ref IS NOT NULL").distinct()
        there = reduce(DataFrame.unionByName, wanted.values()).filter("ref IS NOT NULL").distinct()
        out.append(every.join(there, ["target", "ref"], "left_anti").select("code", "path", F.col("ref").alias("detail"), "severity"))
    for table, own in unique.items():
        each = F.array(*[F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), r.value.cast("string").alias("v")) for r in own])
        g = tables[table].select(keys[table], F.explode(each).alias("x")).filter("x.v IS NOT NULL").groupBy("x.code", "x.severity", "x.v").agg(F.count_distinct(keys[table]).alias("n")).filter("n > 1")
        out.append(g.select("code", path(table, F.col("v")).alias("path"), F.col("n").cast("string").alias("detail"), "severity"))
    for table, own in row.items():
        each = F.array_compact(F.array(*[F.when(r.broken, F.struct(F.lit(r.code).alias("code"), (r.detail.cast("string") if r.detail is not None else F.lit(None).cast("string")).alias("detail"), F.lit(r.severity).alias("severity"))) for r in own]))
        out.append(tables[table].select(path(table).alias("path"), F.explode(each).alias("i")).select("i.code", "path", "i.detail", "i.severity").distinct())
    return reduce(DataFrame.unionByName, out)


def verdict(found: DataFrame) -> DataFrame:
    """(code, severity, issues): counts per rule; a table is valid without an ERROR."""
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))
