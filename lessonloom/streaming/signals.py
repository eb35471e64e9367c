"""Keyed event-time state: a table of transitions folded over each key's signals, as a stream and as a batch.

Both sides run the same ``advance``. A transition that changes nothing keeps the revision. Signals of one key are taken
in order of time and id; a repeated off signal within ``DEDUPE`` milliseconds of the last one is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lessonloom.operators.content import running_totals, with_previous
from lessonloom.runtime import shared_dir

DEDUPE = 2_000
LEARNING = ("READY_LESSON", "READY_QUIZ")


@dataclass(frozen=True)
class State:
    mode: str = "DISABLED"
    inactive: bool = False
    accepted: bool = False
    revision: int = 0
    last_off: int = -1
    last_kind: str = ""


#: signal: (modes in which it counts, what it needs of (inactive, accepted), the mode after, (inactive, accepted) after)
TRANSITIONS: dict[str, tuple[tuple[str, ...], tuple[bool | None, bool | None], str | None, tuple[bool, bool] | None]] = {
    "ENABLE": (("DISABLED",), (None, None), "READY_LESSON", None),
    "OFF": (LEARNING, (False, None), None, (True, False)),
    "ON": (LEARNING, (True, None), None, (False, True)),
    "DONE": (("READY_LESSON",), (None, True), "READY_QUIZ", (False, False)),
    "RIGHT": (("READY_QUIZ",), (None, None), "READY_LESSON", (False, False)),
    "WRONG": (("READY_QUIZ",), (None, None), "READY_QUIZ", (False, False)),
    "PAUSE": (LEARNING, (None, None), "PAUSED", (False, False)),
    "RESUME": (("PAUSED",), (None, None), "READY_LESSON", None),
}

#: What the event log's types mean (the first signal of a key also enables it).
SIGNALS = {"signup": "ENABLE", "view": "OFF", "click": "ON", "purchase": "DONE", "error": "RIGHT"}


def advance(s: State, kind: str, at: int) -> State:
    if kind == "OFF" and s.last_kind == "OFF" and 0 <= at - s.last_off < DEDUPE:
        return s
    seen = replace(s, last_kind=kind, last_off=at if kind == "OFF" else s.last_off)
    rule = TRANSITIONS.get(kind)
    if rule is None:
        return s
    modes, (inactive, accepted), mode, flags = rule
    if s.mode not in modes or (inactive is not None and s.inactive != inactive) or (accepted is not None and s.accepted != accepted):
        return seen
    new = replace(seen, mode=mode or s.mode, inactive=flags[0] if flags else s.inactive, accepted=flags[1] if flags else s.accepted)
    changed = (new.mode, new.inactive, new.accepted) != (s.mode, s.inactive, s.accepted)
    return replace(new, revision=s.revision + changed)


def utc(ts: Column) -> Column:
    """A time without zone as the moment it means in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts))


OUT = "user_id long, mode string, inactive boolean, accepted boolean, revision long, signals long"
_STATE = "mode string, inactive boolean, accepted boolean, revision long, last_off long, last_kind string, signals long"


def _signals(events: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in SIGNALS.items() for x in kv]
    return events.select("user_id", "event_id", F.unix_millis(utc(F.col("ts"))).alias("at"), F.try_element_at(F.create_map(*pairs), "event_type").alias("kind")).filter("kind IS NOT NULL")


def _fold(s: State, signals: Iterable[tuple[str, int]]) -> State:
    for kind, at in signals:
        if s.mode == "DISABLED":
            s = advance(s, "ENABLE", at)
        s = advance(s, kind, at)
    return s


_LAST = T.StructType([T.StructField("mode", T.StringType()), T.StructField("inactive", T.BooleanType()), T.StructField("accepted", T.BooleanType()), T.StructField("revision", T.LongType())])


def replayed(events: DataFrame) -> DataFrame:
    """The last state of every key, as a batch: a key's signals travel as one sorted array, many keys to an Arrow batch."""

    def last(signals: list) -> tuple:
        s = _fold(State(), [(x["kind"], x["at"]) for x in signals])
        return s.mode, s.inactive, s.accepted, s.revision

    seq = _signals(events).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "kind"))).alias("s"))
    out = seq.select("user_id", F.udf(last, _LAST, useArrow=True)("s").alias("l"), F.size("s").cast("long").alias("signals"))
    return out.select("user_id", "l.*", "signals")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *own, n = state.get if state.exists else (*astuple(State()), 0)
    pdf = pd.concat(list(batches))
    s = _fold(State(*own), pdf.sort_values(["at", "event_id"])[["kind", "at"]].itertuples(index=False, name=None))
    n += len(pdf)
    state.update((*astuple(s), n))
    yield pd.DataFrame([(key[0], s.mode, s.inactive, s.accepted, s.revision, n)], columns=["user_id", "mode", "inactive", "accepted", "revision", "signals"])


def streamed(events: DataFrame) -> DataFrame:
    """The state of each key after each trigger; ``events`` is a stream. The last row of a key is its state."""
    return _signals(events).groupBy("user_id").applyInPandasWithState(_update, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, *, mode: str = "append", spark: SparkSession | None = None) -> DataFrame:
    """Runs a streaming frame over what is there now and returns what it wrote (``batch_id`` added)."""
    import uuid

    spark = spark or df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_id", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/n={n}")  # a repeated batch replaces itself

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.withColumn("batch_id", F.lit(0).cast("long")).schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream."""
    # As a pattern, the path may be one file as well as a folder of files.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def without_repeats(events: DataFrame, kind: str, gap_us: int) -> DataFrame:
    """(event_id, user_id) of all events but those of ``kind`` that follow an accepted one within the gap, with no other event between.

    A dropped event does not count. Events are cut into runs at every other event and every gap, so a run, not a user, is
    folded; previous events and run numbers come from range partitions.
    """
    e = with_previous(events, ["user_id"], ["ts", "event_id"], ["event_type", "ts"]).withColumn("us", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), "ts"))
    near = F.col("prev_event_type").eqNullSafe(F.lit(kind)) & (F.timestamp_diff("MICROSECOND", "prev_ts", "ts") < gap_us)
    asked = e.filter(F.col("event_type") == kind).select("event_id", "user_id", "us", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1).cast("long").alias("new"))
    runs = running_totals(asked, ["user_id"], ["us", "event_id"], {"new": "run"}).groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("us", "event_id"))).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda a, x: F.when((F.size(a) == 0) | (x["us"] - F.get(a, F.size(a) - 1)["us"] >= gap_us), F.array_append(a, x)).otherwise(a))
    accepted = runs.select("user_id", F.explode(kept).alias("x")).select("x.event_id", "user_id")
    return events.filter(~F.col("event_type").eqNullSafe(F.lit(kind))).select("event_id", "user_id").unionByName(accepted)


def windowed(events: DataFrame, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and type with a watermark; works on streams and tables."""
    e = events.withColumn("at", utc(F.col("ts"))).withWatermark("at", late)
    g = e.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: list[str], *, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark (streams)."""
    return events.withColumn("at", utc(F.col("ts"))).withWatermark("at", late).dropDuplicatesWithinWatermark(key)
