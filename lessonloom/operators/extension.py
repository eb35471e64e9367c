"""What users add: external transforms of rows with output checks, strict readers, overlays and splices."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.operators.content import global_number


def external(rows: DataFrame, key: str, inputs: list[str], call: Callable[[dict], dict], check: Callable[[dict], str | None] | None = None) -> DataFrame:
    """(key, status, output_json, error) of a row-wise outside call, in Arrow batches; failures and refused outputs are rows, not errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    made = call({c: row[c] for c in inputs})
                    why = check(made) if check else None
                    out.append((row["_key"], "FAILED" if why else "READY", json.dumps(made, ensure_ascii=False, sort_keys=True), why))
                except Exception as e:  # noqa: BLE001 - whatever the call raises is its result
                    out.append((row["_key"], "FAILED", None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["key", "status", "output_json", "error"])

    return rows.select(F.col(key).cast("string").alias("_key"), *inputs).mapInArrow(run, "key string, status string, output_json string, error string").withColumnRenamed("key", key)


def bisected(rows: DataFrame, key: str, inputs: list[str], call: Callable[[list[dict]], list[dict]], *, size: int = 32) -> DataFrame:
    """(key, status, output_json, error) of a call on batches: a batch that fails is halved until only its failing rows are left.

    What has succeeded is not asked again; a bad row costs two calls a halving. ``call`` gives one output a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, out = batch.to_pylist(), []
            todo = [rows_[k : k + size] for k in range(0, len(rows_), size)][::-1]
            while todo:
                part = todo.pop()
                try:
                    made = call([{c: r[c] for c in inputs} for r in part])
                    if len(made) != len(part):
                        raise ValueError(f"{len(made)} outputs for {len(part)} rows")
                    out += [(r["_key"], "READY", json.dumps(m, ensure_ascii=False, sort_keys=True), None) for r, m in zip(part, made)]
                except Exception as e:  # noqa: BLE001 - whatever the call raises is its result
                    if len(part) == 1:
                        out.append((part[0]["_key"], "FAILED", None, f"{type(e).__name__}: {e}"[:500]))
                    else:
                        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["key", "status", "output_json", "error"])

    return rows.select(F.col(key).cast("string").alias("_key"), *inputs).mapInArrow(run, "key string, status string, output_json string, error string").withColumnRenamed("key", key)


def strict_json_error(text: str | None) -> str | None:
    """Why a text is no strict JSON object: repeated keys and numbers that aren't finite are errors too."""
    if text is None:
        return "NULL"

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError("REPEATED_KEY")
        return dict(items)

    def refuse(_):
        raise ValueError("NOT_FINITE")

    try:
        v = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse, parse_float=lambda s: float(s) if math.isfinite(float(s)) else refuse(s))
    except ValueError as e:
        return str(e) if str(e).isupper() else "MALFORMED"
    return None if isinstance(v, dict) else "NO_OBJECT"


def strict_json(c: Column) -> Column:
    return F.udf(strict_json_error, T.StringType(), useArrow=True)(c)


def decoded(c: Column, tag: str, shapes: dict[str, dict[str, str]]) -> Column:
    """Of a tagged JSON record: (kind, problem): the tag has to be known and its fields of their types."""
    v = F.try_parse_json(c)
    kind = F.try_variant_get(v, f"$.{tag}", "string")
    problem = F.when(v.isNull(), "MALFORMED").when(kind.isNull() | ~kind.isin(*shapes), "UNKNOWN_KIND")
    for name, fields in shapes.items():
        bad = None
        for f, t in fields.items():
            one = F.try_variant_get(v, f"$.{f}", t).isNull()
            bad = one if bad is None else bad | one
        problem = problem.when((kind == name) & bad, "BAD_FIELDS")
    return F.struct(kind.alias("kind"), problem.alias("problem"))


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of the fields that differ, nulls being equal."""
    return F.array_compact(F.array(*[F.when(~old[n].eqNullSafe(new[n]), F.lit(n)) for n in old]))


def spliced(rows: DataFrame, new: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``rows`` with one group's rows replaced by ``new`` at the same place, and all numbered anew from 0, by range partitions."""
    first = rows.filter(F.col(group) == value).agg(F.min(order).alias("_at"))
    kept = rows.filter(F.col(group) != value).withColumn("_a", F.col(order).cast("long")).withColumn("_b", F.lit(0).cast("long"))
    added = new.join(F.broadcast(first)).withColumn("_a", F.col("_at").cast("long")).withColumn("_b", F.col(order).cast("long")).drop("_at")
    both = kept.unionByName(added)
    return global_number(both.drop(order), ["_a", "_b"], order).select(*rows.columns)


def masked(rows: DataFrame, valid: DataFrame, key: str, title: str, shown: bool) -> DataFrame:
    """Titles of ids that are still valid, if titles are shown at all; else none."""
    ok = valid.select(key).distinct().withColumn("_ok", F.lit(True))
    j = rows.join(ok, key, "left")
    return j.withColumn(title, F.when(F.coalesce("_ok", F.lit(False)) & F.lit(shown), F.col(title))).drop("_ok")
