"""Study history: projections, activity calendars, mastery, schedules and selection of the next item.

Times are epoch milliseconds; 0 means never. All functions take and return DataFrames and read no session state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.operators.content import with_previous

DAY = 86_400_000
#: Days until an item of box 0 to 5 is due, and until a mistake of review box 0 to 3 is (fixed values).
BOX_DAYS = (0, 1, 3, 7, 14, 30)
MISTAKE_DAYS = (3, 7, 14, 30)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a time without zone, read as UTC, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def local_day(ms: Column, offset_hours: int) -> Column:
    """The date of epoch milliseconds at a fixed offset from UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ms + F.lit(offset_hours * 3_600_000)) / F.lit(DAY)).cast("int"))


def zone_day(ms: Column, zone: str) -> Column:
    """The date of epoch milliseconds in a zone, whatever the session's own is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc_clock(ms)).cast("date")


def zone_midnight(ms: Column, zone: str) -> Column:
    """Epoch milliseconds at which that date began in the zone."""
    began = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_trunc("day", F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc_clock(ms))).cast("timestamp_ntz"))
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), began) / 1000)


def _utc_clock(ms: Column) -> Column:
    return F.timestamp_add("SECOND", F.floor(ms / 1000).cast("int"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def is_due(due: Column, now: int) -> Column:
    return due.between(1, now)


# --- views over an event log -----------------------------------------------------------------------------------


def attempts(events: DataFrame) -> DataFrame:
    """Answers: one row per click, purchase or error event."""
    return events.filter(F.col("event_type").isin("purchase", "error", "click")).select(
        "event_id", F.concat(F.lit("q"), F.col("event_id") % 50).alias("question_id"), F.concat(F.lit("a"), "user_id").alias("atom_id"), F.concat(F.lit("p"), F.col("event_id") % 20).alias("pair_id"),
        (F.col("event_type") != "error").alias("correct"), millis(F.col("ts")).alias("created_at"), F.col("event_id").cast("string").alias("attempt_uid"),
    )


def lessons_read(events: DataFrame) -> DataFrame:
    """Completed lessons: view events, keyed by the first non-blank of a JSON field and the event id."""
    k = F.get_json_object("props", "$.k")
    return events.filter("event_type = 'view'").select("event_id", millis(F.col("ts")).alias("created_at"), F.coalesce(F.nullif(k, F.lit("")), F.col("event_id").cast("string")).alias("lesson_key"))


def progress(events: DataFrame) -> DataFrame:
    """One row per atom: share of right answers, box, due time, status."""
    g = attempts(events).groupBy("atom_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if("correct").alias("right_answers"), F.max("created_at").alias("last_studied_at"))
    box = F.least(F.lit(5), 1 + F.col("right_answers") % 5)
    mastery = F.round(F.col("right_answers") / F.col("answers"), 6)
    days = F.element_at(F.array(*[F.lit(d) for d in BOX_DAYS]), (box + 1).cast("int"))
    return g.select("atom_id", F.when(mastery >= 0.7, "MASTERED").when(mastery >= 0.5, "IN_PROGRESS").otherwise("NEW").alias("status"), mastery.alias("mastery"), (F.col("last_studied_at") + days.cast("long") * F.lit(DAY)).alias("due_at"), box.cast("long").alias("leitner_box"), "last_studied_at")


def mistakes(events: DataFrame) -> DataFrame:
    """One row per wrongly answered question."""
    wrong = attempts(events).filter("NOT correct")
    last = F.max(F.struct("created_at", "event_id", "atom_id", "pair_id"))
    g = wrong.groupBy("question_id").agg(F.count(F.lit(1)).alias("error_count"), F.min("created_at").alias("first_seen_at"), last.alias("l"))
    box = F.least(F.lit(3), F.col("error_count") % 4)
    days = F.element_at(F.array(*[F.lit(d) for d in MISTAKE_DAYS]), (box + 1).cast("int"))
    return g.select("question_id", F.col("l.atom_id").alias("atom_id"), F.col("l.pair_id").alias("pair_id"), "error_count", "first_seen_at", F.col("l.created_at").alias("last_seen_at"), (F.col("l.created_at") + days.cast("long") * F.lit(DAY)).alias("due_at"), box.cast("long").alias("review_box"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert as a batch. A struct maximum combines before the shuffle, a window would not."""
    rest = [c for c in rows.columns if c not in key]
    o = [x.alias(f"_o{k}") for k, x in enumerate(order)]
    best = rows.groupBy(*key).agg(F.max(F.struct(*o, *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


# --- dashboard -------------------------------------------------------------------------------------------------


def activity_days(answers: DataFrame, lessons: DataFrame, today: str, *, days: int = 7, offset_hours: int = 7) -> DataFrame:
    """(day, answered, wrong, lessons) of the last days, days without activity as zeros. Malformed rows don't count."""
    spark = answers.sparkSession
    spine = spark.range(days).select(F.date_sub(F.lit(today).cast("date"), (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    low = F.date_sub(F.lit(today).cast("date"), days - 1)
    day = local_day(F.col("created_at"), offset_hours).alias("day")
    within = lambda df: df.filter("created_at >= 0").withColumn("day", day).filter((F.col("day") >= low) & (F.col("day") <= F.lit(today).cast("date")))
    a = within(answers).groupBy("day").agg(F.count(F.lit(1)).alias("answered"), F.count_if(~F.col("correct")).alias("wrong"))
    b = within(lessons.filter("trim(lesson_key) <> ''")).groupBy("day").agg(F.count_distinct("lesson_key").alias("lessons"))
    return spine.join(a, "day", "left").join(b, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("answered", "wrong", "lessons")])


def activity_totals(days: DataFrame) -> DataFrame:
    """Totals, means over all days, today's truncated accuracy, and the run of active days that ends today."""
    n = F.count(F.lit(1))
    last = F.max("day")
    idle = F.max(F.when((F.col("answered") == 0) & (F.col("lessons") == 0), F.col("day")))
    g = days.agg(n.alias("n"), F.sum("answered").alias("answered"), F.sum("wrong").alias("wrong"), F.sum("lessons").alias("lessons"), F.max("answered").alias("most"), F.max(F.struct("day", "answered", "wrong")).alias("today"), last.alias("last"), idle.alias("idle"))
    accuracy = F.when(F.col("today.answered") > 0, F.floor((F.col("today.answered") - F.col("today.wrong")) * 100 / F.col("today.answered"))).otherwise(0)
    return g.select("answered", "wrong", "lessons", (F.col("answered") / F.col("n")).alias("mean_answers"), accuracy.cast("long").alias("accuracy"), F.when(F.col("idle").isNull(), F.col("n")).otherwise(F.datediff("last", "idle")).cast("long").alias("streak"), F.greatest(F.lit(1), "most", F.ceil(F.col("answered") / F.col("n"))).cast("long").alias("chart_top"))


# --- selection -------------------------------------------------------------------------------------------------


def sanitized(atoms: DataFrame) -> DataFrame:
    """Mastery inside 0 to 1 and finite, negative times off."""
    m = F.col("mastery")
    finite = F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m)))
    return atoms.withColumn("mastery", finite).withColumn("due_at", F.greatest(F.coalesce("due_at", F.lit(0)), F.lit(0))).withColumn("last_studied_at", F.when(F.col("last_studied_at") >= 0, F.col("last_studied_at")))


def snapshot(atoms: DataFrame, now: int) -> DataFrame:
    """(due_count, weak_atom_id, continue_atom_id): arg-min and arg-max with all ties settled, in one aggregation."""
    a = sanitized(atoms)
    due = is_due(F.col("due_at"), now)
    far = F.lit(2**62)
    touched = (F.col("status") != "NEW") | F.col("last_studied_at").isNotNull() | (F.col("due_at") > 0) | (F.col("mastery") > 0)
    order = [F.col("ord"), F.col("atom_id")]
    weak = F.min(F.when(touched, F.struct("mastery", F.when(F.col("due_at") > 0, F.col("due_at")).otherwise(far).alias("d"), *order)))
    going = F.min(F.when((F.col("status") != "MASTERED") & F.col("last_studied_at").isNotNull(), F.struct((-F.col("last_studied_at")).alias("l"), *order)))
    open_ = F.min(F.when(F.col("status") != "MASTERED", F.struct(*order)))
    any_due = F.min(F.when(due, F.struct(*order)))
    g = a.agg(F.count_if(due).alias("due_count"), weak.alias("w"), going.alias("g"), open_.alias("o"), any_due.alias("u"))
    return g.select("due_count", F.col("w.atom_id").alias("weak_atom_id"), F.coalesce("g.atom_id", "o.atom_id", "u.atom_id", "w.atom_id").alias("continue_atom_id"))


def eligible(atoms: DataFrame, done: DataFrame) -> DataFrame:
    """(atom_id, eligible): whether all prerequisites are in ``done`` (atom_id); an empty list is. Division by anti join and bool_and."""
    need = atoms.select("atom_id", F.explode(F.array_distinct("prerequisite_ids")).alias("p")).filter("p IS NOT NULL")
    met = need.join(done.select(F.col("atom_id").alias("p"), F.lit(True).alias("ok")).distinct(), "p", "left").groupBy("atom_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("met"))
    return atoms.select("atom_id").distinct().join(met, "atom_id", "left").select("atom_id", F.coalesce("met", F.lit(True)).alias("eligible"))


def priority(status: Column, due: Column, now: int) -> Column:
    """0 due, 1 new, 2 other."""
    return F.when(F.coalesce(is_due(due, now), F.lit(False)), 0).when(status.isNull() | (status == "NEW"), 1).otherwise(2)


def next_item(atoms: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """The next atom: of the first group with unfinished atoms, the eligible one that is least by priority, due time, mastery, order and id.

    ``atoms`` has atom_id, group_order, ord, prerequisite_ids; ``state`` atom_id, status, due_at, mastery.
    """
    a = atoms.join(state, "atom_id", "left")
    a = a.join(eligible(atoms, state.filter("status = 'MASTERED'")), "atom_id")
    rank = F.struct(priority(F.col("status"), F.col("due_at"), now).alias("k"), F.coalesce("due_at", F.lit(2**62)).alias("d"), F.coalesce("mastery", F.lit(0.0)).alias("m"), "ord", "atom_id")
    unfinished = F.coalesce(F.col("status") != "MASTERED", F.lit(True))
    per = a.groupBy("group_order").agg(F.bool_or(unfinished).alias("open"), F.min(F.when(unfinished & F.col("eligible"), rank)).alias("best"), F.min(rank).alias("any"))
    g = per.agg(F.min(F.when(F.col("open"), F.struct("group_order", "best"))).alias("o"), F.min("any").alias("a"))
    return g.select(F.when(F.col("o").isNotNull(), F.col("o.best.atom_id")).otherwise(F.col("a.atom_id")).alias("atom_id"), F.col("o.group_order").alias("group_order"))


def mastery_fold(answers: DataFrame, *, slice_ms: int = 6 * 3_600_000) -> DataFrame:
    """(atom_id, mastery, leitner_box, mastered): answers of each atom in time order folded into its progress.

    A right answer adds 0.2 (from 0.1 up to 1) and a box, a wrong one takes 0.15 off and returns to box 1. Each step is
    min(hi, max(lo, m + a)), and so is any run of steps; slices of time are reduced to (a, lo, hi) first and then to the
    atom's whole run, so no task holds all answers of a busy atom. Box and status rest on the right answers since the
    last wrong one, which is a count.
    """
    compose = lambda p, q: F.struct((p["a"] + q["a"]).alias("a"), F.least(q["hi"], F.greatest(q["lo"], p["lo"] + q["a"])).alias("lo"), F.least(q["hi"], F.greatest(q["lo"], p["hi"] + q["a"])).alias("hi"))
    step = lambda a, lo, hi: F.struct(*[F.lit(v).cast("long").alias(n) for v, n in ((a, "a"), (lo, "lo"), (hi, "hi"))])
    none = step(0, -(2**40), 2**40)
    one = F.when(F.col("correct"), step(4, 2 + 4, 20)).otherwise(step(-3, 2, 2**40))  # in twentieths, so sums are exact
    at = answers.select("atom_id", "created_at", "event_id", "correct", F.floor(F.col("created_at") / slice_ms).alias("slice"), one.alias("f"))
    fold = lambda c: F.aggregate(F.transform(F.array_sort(c), lambda x: x["f"]), none, compose)
    slices = at.groupBy("atom_id", "slice").agg(fold(F.collect_list(F.struct("created_at", "event_id", "f"))).alias("f"))
    whole = slices.groupBy("atom_id").agg(fold(F.collect_list(F.struct("slice", "f"))).alias("f"))
    wrong = at.groupBy("atom_id").agg(F.max(F.when(~F.col("correct"), F.struct("created_at", "event_id"))).alias("last"))
    since = F.col("last").isNull() | (F.struct("created_at", "event_id") > F.col("last"))
    right = at.join(wrong, "atom_id").groupBy("atom_id").agg(F.count_if(since & F.col("correct")).alias("right"))
    m = F.least("f.hi", F.greatest("f.lo", F.col("f.a")))
    return whole.join(right, "atom_id").select("atom_id", F.round(m / 20, 6).alias("mastery"), F.least(F.lit(5), 1 + F.col("right")).alias("leitner_box"), ((F.col("right") > 0) & (m >= 16)).alias("mastered"))


def round_progress(answers: DataFrame) -> DataFrame:
    """(pair_id, question_id, correct, wrong_count, correct_at): any right, number of wrong ones, last right time."""
    return answers.groupBy("pair_id", "question_id").agg(F.bool_or("correct").alias("correct"), F.count_if(~F.col("correct")).alias("wrong_count"), F.max(F.when(F.col("correct"), F.col("created_at"))).alias("correct_at"))


def sessions(events: DataFrame) -> DataFrame:
    """Pairs of an off signal (view) and the first on signal (click) after it, per user: (user_id, off_at, on_at)."""
    e = with_previous(events.filter(F.col("event_type").isin("view", "click")), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    return e.filter("event_type = 'click' AND prev_event_type = 'view'").select("user_id", "event_id", millis(F.col("prev_ts")).alias("off_at"), millis(F.col("ts")).alias("on_at"))
