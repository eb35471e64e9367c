"""Queries over the event log read as a study history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.operators import study as S
from lessonloom.runtime import tables

NOW, TODAY = 1_706_000_000_000, "2024-01-23"
#: A time at which reviews of the log have fallen due.
REVIEW = 1_708_000_000_000

QUERIES: dict = {}
SQL: dict = {}

_VIEWS = f"""
att AS (SELECT event_id, 'q' || (event_id % 50) AS question_id, 'a' || user_id AS atom_id, 'p' || (event_id % 20) AS pair_id, event_type <> 'error' AS correct, (epoch_us(ts) // 1000) AS created_at, event_id::VARCHAR AS attempt_uid FROM events WHERE event_type IN ('purchase', 'error', 'click')),
les AS (SELECT event_id, (epoch_us(ts) // 1000) AS created_at, coalesce(nullif(json_extract_string(props, '$.k'), ''), event_id::VARCHAR) AS lesson_key FROM events WHERE event_type = 'view'),
prog0 AS (SELECT atom_id, count(*) AS n, count(*) FILTER (correct) AS r, max(created_at) AS last_studied_at FROM att GROUP BY atom_id),
prog AS (SELECT atom_id, CASE WHEN round(r / n, 6) >= 0.7 THEN 'MASTERED' WHEN round(r / n, 6) >= 0.5 THEN 'IN_PROGRESS' ELSE 'NEW' END AS status, round(r / n, 6) AS mastery, last_studied_at + [0, 1, 3, 7, 14, 30][least(5, 1 + r % 5) + 1] * 86400000::BIGINT AS due_at, least(5, 1 + r % 5) AS leitner_box, last_studied_at FROM prog0),
mis0 AS (SELECT question_id, count(*) AS error_count, min(created_at) AS first_seen_at, max({{'c': created_at, 'e': event_id, 'a': atom_id, 'p': pair_id}}) AS l FROM att WHERE NOT correct GROUP BY question_id),
mis AS (SELECT question_id, l.a AS atom_id, l.p AS pair_id, error_count, first_seen_at, l.c AS last_seen_at, l.c + [3, 7, 14, 30][least(3, error_count % 4) + 1] * 86400000::BIGINT AS due_at, least(3, error_count % 4) AS review_box FROM mis0)
"""


def query(sql: str | None):
    """Registers a query with its SQL, which sees the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS} {sql}"
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)("events")


@query("""SELECT (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE AS day, coalesce(answered, 0) AS answered, coalesce(wrong, 0) AS wrong, coalesce(lessons, 0) AS lessons FROM range(7) t(i)
LEFT JOIN (SELECT (DATE '1970-01-01' + floor((created_at + 25200000) / 86400000)::INTEGER)::DATE AS day, count(*) AS answered, count(*) FILTER (NOT correct) AS wrong FROM att GROUP BY 1) a ON a.day = (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE
LEFT JOIN (SELECT (DATE '1970-01-01' + floor((created_at + 25200000) / 86400000)::INTEGER)::DATE AS day, count(DISTINCT lesson_key) AS lessons FROM les GROUP BY 1) b ON b.day = (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE""")
def dash_daily(spark, d):
    e = _events(spark, d)
    return S.activity_days(S.attempts(e), S.lessons_read(e), TODAY)


@query("""SELECT sum(answered) AS answered, sum(wrong) AS wrong, sum(lessons) AS lessons, sum(answered) / 7 AS mean_answers, CASE WHEN sum(answered) FILTER (day = DATE '2024-01-23') > 0 THEN floor((sum(answered - wrong) FILTER (day = DATE '2024-01-23')) * 100 / sum(answered) FILTER (day = DATE '2024-01-23')) ELSE 0 END::BIGINT AS accuracy,
CASE WHEN max(day) FILTER (answered = 0 AND lessons = 0) IS NULL THEN 7 ELSE max(day) - max(day) FILTER (answered = 0 AND lessons = 0) END::BIGINT AS streak, greatest(1, max(answered), ceil(sum(answered) / 7))::BIGINT AS chart_top FROM (
SELECT (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE AS day, coalesce(a.n, 0) AS answered, coalesce(a.w, 0) AS wrong, coalesce(b.n, 0) AS lessons FROM range(7) t(i)
LEFT JOIN (SELECT floor((created_at + 25200000) / 86400000)::INTEGER AS k, count(*) AS n, count(*) FILTER (NOT correct) AS w FROM att GROUP BY 1) a ON a.k = (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE - DATE '1970-01-01'
LEFT JOIN (SELECT floor((created_at + 25200000) / 86400000)::INTEGER AS k, count(DISTINCT lesson_key) AS n FROM les GROUP BY 1) b ON b.k = (DATE '2024-01-23' - (6 - i)::INTEGER)::DATE - DATE '1970-01-01')""")
def dash_totals(spark, d):
    return S.activity_totals(dash_daily(spark, d))


@query(f"SELECT count(DISTINCT question_id) AS known_mistakes, count(*) FILTER (due_at BETWEEN 1 AND {NOW}) AS due_mistakes FROM mis")
def dash_mistakes(spark, d):
    return S.mistakes(_events(spark, d)).agg(F.count_distinct("question_id").alias("known_mistakes"), F.count_if(S.is_due(F.col("due_at"), NOW)).alias("due_mistakes"))


@query("SELECT count(*) FILTER (status = 'MASTERED') AS mastered, count(*) AS total, CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (status = 'MASTERED') / count(*) END AS fraction FROM prog")
def dash_mastered(spark, d):
    m = F.count_if(F.col("status") == "MASTERED")
    return S.progress(_events(spark, d)).agg(m.alias("mastered"), F.count(F.lit(1)).alias("total"), F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(m / F.count(F.lit(1))).alias("fraction"))


@query("SELECT *, row_number() OVER (ORDER BY mastery, due_at, atom_id) AS pos FROM prog ORDER BY pos LIMIT 200")
def progress_weakest(spark, d):
    """The 200 weakest atoms with their rank: a top-k, then a rank over its few rows."""
    top = S.progress(_events(spark, d)).orderBy("mastery", "due_at", "atom_id").limit(200)
    return top.withColumn("pos", F.row_number().over(W.orderBy("mastery", "due_at", "atom_id")).cast("long"))


@query("SELECT * FROM prog WHERE atom_id = 'a7'")
def progress_point(spark, d):
    e = _events(spark, d).filter("user_id = 7")
    return S.progress(e).filter("atom_id = 'a7'")


@query("SELECT * FROM mis")
def mistakes_all(spark, d):
    return S.mistakes(_events(spark, d))


@query("SELECT * FROM mis WHERE question_id = 'q7'")
def mistake_point(spark, d):
    return S.mistakes(_events(spark, d).filter("event_id % 50 = 7"))


@query("SELECT * FROM mis WHERE pair_id = 'p7'")
def mistakes_by_pair(spark, d):
    return S.mistakes(_events(spark, d)).filter("pair_id = 'p7'").orderBy(F.desc("last_seen_at"))


@query("SELECT * FROM att ORDER BY created_at DESC, event_id DESC LIMIT 100")
def attempts_recent(spark, d):
    return S.attempts(_events(spark, d)).orderBy(F.desc("created_at"), F.desc("event_id")).limit(100)


@query(f"SELECT created_at, correct FROM att WHERE created_at >= {NOW}")
def attempts_since(spark, d):
    return S.attempts(_events(spark, d)).filter(F.col("created_at") >= NOW).select("created_at", "correct").orderBy("created_at")


@query("SELECT * FROM att WHERE pair_id = 'p3'")
def attempts_by_pair(spark, d):
    return S.attempts(_events(spark, d)).filter("pair_id = 'p3'").orderBy(F.desc("created_at"))


@query("SELECT attempt_uid, count(*) AS n FROM att GROUP BY attempt_uid HAVING count(*) >= 1")
def attempt_uid_counts(spark, d):
    return S.attempts(_events(spark, d)).groupBy("attempt_uid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM les")
def lesson_activity_key(spark, d):
    return S.lessons_read(_events(spark, d))


@query(f"SELECT m.* FROM mis m JOIN prog p ON m.atom_id = p.atom_id WHERE p.status = 'MASTERED' AND m.due_at > 0 AND m.due_at <= {REVIEW}")
def due_mastered_mistakes(spark, d):
    e = _events(spark, d)
    m, p = S.mistakes(e), S.progress(e).filter("status = 'MASTERED'").select("atom_id")
    return m.filter(S.is_due(F.col("due_at"), REVIEW)).join(p, "atom_id", "left_semi").orderBy("due_at", F.desc("error_count"), "first_seen_at", "question_id")


@query(f"SELECT m.question_id, m.atom_id FROM mis m JOIN prog p ON m.atom_id = p.atom_id WHERE p.status = 'MASTERED' AND m.due_at > 0 AND m.due_at <= {REVIEW} ORDER BY m.due_at, m.error_count DESC, m.first_seen_at, m.question_id LIMIT 1")
def first_due_review(spark, d):
    return due_mastered_mistakes(spark, d).limit(1).select("question_id", "atom_id")


@query("SELECT question_id, atom_id, CASE WHEN question_id = 'q7' THEN left(repeat('note ', 500), 2000) ELSE '' END AS user_note FROM mis")
def note_update(spark, d):
    return S.mistakes(_events(spark, d)).select("question_id", "atom_id", F.when(F.col("question_id") == "q7", F.left(F.repeat(F.lit("note "), F.lit(500)), F.lit(2000))).otherwise("").alias("user_note"))


@query("SELECT atom_id, arg_max(event_id, (created_at, event_id)) AS event_id, arg_max(question_id, (created_at, event_id)) AS question_id, max(created_at) AS created_at FROM att GROUP BY atom_id")
def upsert_latest(spark, d):
    a = S.attempts(_events(spark, d)).select("atom_id", "event_id", "question_id", "created_at")
    return S.latest(a, ["atom_id"], [F.col("created_at"), F.col("event_id")])


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type, ts, value, props")
def idempotent_insert(spark, d):
    e = _events(spark, d)
    return e.groupBy("user_id", "event_type", "ts", "value", "props").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")


@query("SELECT pair_id, question_id, bool_or(correct) AS correct, count(*) FILTER (NOT correct) AS wrong_count, max(created_at) FILTER (correct) AS correct_at FROM att GROUP BY ALL")
def round_progress(spark, d):
    return S.round_progress(S.attempts(_events(spark, d)))


@query("SELECT question_id FROM (SELECT question_id, bool_or(correct) AS c FROM att WHERE pair_id = 'p3' GROUP BY question_id) WHERE c")
def round_correct_ids(spark, d):
    return S.round_progress(S.attempts(_events(spark, d)).filter("pair_id = 'p3'")).filter("correct").select("question_id")


@query("""SELECT user_id, event_id, (epoch_us(pt) // 1000) AS off_at, (epoch_us(ts) // 1000) AS on_at FROM (SELECT *, lag(event_type) OVER w AS pe, lag(ts) OVER w AS pt FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND pe = 'view'""")
def sessions_all(spark, d):
    return S.sessions(_events(spark, d))


@query(f"""SELECT user_id, event_id, (epoch_us(pt) // 1000) AS off_at, (epoch_us(ts) // 1000) AS on_at FROM (SELECT *, lag(event_type) OVER w AS pe, lag(ts) OVER w AS pt FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND pe = 'view' ORDER BY on_at DESC, event_id DESC LIMIT 20""")
def sessions_recent(spark, d):
    return S.sessions(_events(spark, d)).orderBy(F.desc("on_at"), F.desc("event_id")).limit(20)


@query(f"SELECT since, count(a.event_id) AS attempts, coalesce(sum(correct::INT), 0)::BIGINT AS right_sum FROM (VALUES ({NOW}::BIGINT), ({NOW + 90 * S.DAY}::BIGINT)) v(since) LEFT JOIN att a ON a.created_at >= since GROUP BY since")
def sums_since(spark, d):
    """Counts and sums since two times; over no rows they are 0."""
    a = S.attempts(_events(spark, d))
    one = lambda t: a.filter(F.col("created_at") >= t).agg(F.lit(t).cast("long").alias("since"), F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)).alias("right_sum"))
    return one(NOW).unionByName(one(NOW + 90 * S.DAY))


@query("SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_recent(spark, d):
    return _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("SELECT * FROM att WHERE pair_id <> 'p3' OR NOT correct")
def delete_rows(spark, d):
    """A deletion as the rows that stay."""
    return S.attempts(_events(spark, d)).filter("NOT (pair_id = 'p3' AND correct)")


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'ACTIVE' WHEN event_type = 'error' THEN 'FAILED' ELSE upper(event_type) END AS state, 0 AS revision, NULL::VARCHAR AS surface FROM events")
def migrate_states(spark, d):
    """Schema migration: new columns with defaults and values mapped by cases."""
    t = F.col("event_type")
    return _events(spark, d).select("event_id", F.when(t.isin("signup", "purchase"), "ACTIVE").when(t == "error", "FAILED").otherwise(F.upper(t)).alias("state"), F.lit(0).alias("revision"), F.lit(None).cast("string").alias("surface"))


@query("SELECT user_id, coalesce(max(value) FILTER (event_type = 'view'), 3.0) AS view_limit, coalesce(max(value) FILTER (event_type = 'click'), 5.0) AS click_limit, coalesce(max(value) FILTER (event_type = 'signup'), 0.0) AS signup_limit FROM events GROUP BY user_id")
def settings_pivot(spark, d):
    """Key-value rows to one typed row with defaults."""
    p = _events(spark, d).groupBy("user_id").pivot("event_type", ["view", "click", "signup"]).agg(F.max("value"))
    return p.select("user_id", *[F.coalesce(k, F.lit(v)).alias(f"{k}_limit") for k, v in (("view", 3.0), ("click", 5.0), ("signup", 0.0))])


@query("SELECT event_id, hour(ts) AS h, (hour(ts) >= 22 OR hour(ts) < 6) AS at_night, (hour(ts) >= 8 AND hour(ts) < 17) AS at_day FROM events")
def active_hours(spark, d):
    """Hours windows that may wrap around midnight."""

    def within(h, start, end):
        return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)

    h = F.hour("ts")
    return _events(spark, d).select("event_id", h.alias("h"), within(h, 22, 6).alias("at_night"), within(h, 8, 17).alias("at_day"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY ALL")
def activity_by_day(spark, d):
    return _events(spark, d).groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


_ATOMS = "SELECT atom_id, status, mastery, due_at, last_studied_at, substr(atom_id, 2)::BIGINT % 10 AS ord FROM prog"


def _widget(spark, d):
    return S.progress(_events(spark, d)).withColumn("ord", F.substring("atom_id", 2, 20).cast("long") % 10)


@query(f"""SELECT (SELECT count(*) FROM prog WHERE due_at BETWEEN 1 AND {NOW}) AS due_count,
(SELECT atom_id FROM ({_ATOMS}) WHERE status <> 'NEW' OR last_studied_at IS NOT NULL OR due_at > 0 OR mastery > 0 ORDER BY mastery, due_at, ord, atom_id LIMIT 1) AS weak_atom_id,
(SELECT atom_id FROM ({_ATOMS}) WHERE status <> 'MASTERED' AND last_studied_at IS NOT NULL ORDER BY last_studied_at DESC, ord, atom_id LIMIT 1) AS continue_atom_id""")
def widget_snapshot(spark, d):
    return S.snapshot(_widget(spark, d), NOW)


@query(f"SELECT atom_id, CASE WHEN due_at BETWEEN 1 AND {NOW} THEN 0 WHEN status = 'NEW' THEN 1 ELSE 2 END AS priority FROM prog")
def selection_priority(spark, d):
    return S.progress(_events(spark, d)).select("atom_id", S.priority(F.col("status"), F.col("due_at"), NOW).alias("priority"))


@query("SELECT question_id, due_at, review_box, [3, 7, 14, 30][least(3, review_box + 1) + 1] AS next_days, due_at + [3, 7, 14, 30][least(3, review_box + 1) + 1] * 86400000::BIGINT AS next_due FROM mis")
def mistake_schedule(spark, d):
    days = F.element_at(F.array(*[F.lit(x) for x in S.MISTAKE_DAYS]), (F.least(F.lit(3), F.col("review_box") + 1) + 1).cast("int"))
    return S.mistakes(_events(spark, d)).select("question_id", "due_at", "review_box", days.alias("next_days"), (F.col("due_at") + days.cast("long") * F.lit(S.DAY)).alias("next_due"))


@query("""SELECT atom_id, round(f.m / 20, 6) AS mastery, f.b::BIGINT AS leitner_box, f.d AS mastered FROM (
SELECT atom_id, list_reduce(list_concat([{'m': 0, 'b': 1, 'd': false, 'c': true}], list_transform(list(correct ORDER BY created_at, event_id), lambda c: {'m': 0, 'b': 0, 'd': false, 'c': c})), lambda a, x: CASE WHEN x.c THEN {'m': least(20, greatest(2, a.m) + 4), 'b': least(5, a.b + 1), 'd': a.d OR least(20, greatest(2, a.m) + 4) >= 16, 'c': true} ELSE {'m': greatest(2, a.m - 3), 'b': 1, 'd': false, 'c': true} END) AS f FROM att GROUP BY atom_id)""")
def mastery_fold(spark, d):
    return S.mastery_fold(S.attempts(_events(spark, d)))


@query("SELECT event_id, ts, event_type, CASE WHEN value > 50 THEN 'k=' || event_id || ';v=' || user_id ELSE 'k=' || event_id END AS detail, event_id::VARCHAR AS k, CASE WHEN value > 50 THEN user_id::VARCHAR END AS v FROM events")
def event_details(spark, d):
    """Details written as k=v;k=v and read back as a map."""
    detail = F.when(F.col("value") > 50, F.concat(F.lit("k="), "event_id", F.lit(";v="), "user_id")).otherwise(F.concat(F.lit("k="), "event_id"))
    m = F.str_to_map(F.col("detail"), F.lit(";"), F.lit("="))
    return _events(spark, d).select("event_id", "ts", "event_type", detail.alias("detail")).withColumn("k", m["k"]).withColumn("v", m["v"])


@query(f"SELECT event_id, ((epoch_us(ts) // 1000) > 0 AND (epoch_us(ts) // 1000) <= {NOW} + 5000 AND {NOW} - (epoch_us(ts) // 1000) <= 90000000) AS fresh FROM events")
def heartbeat_fresh(spark, d):
    t = S.millis(F.col("ts"))
    return _events(spark, d).select("event_id", ((t > 0) & (t <= NOW + 5000) & (NOW - t <= 90_000_000)).alias("fresh"))
