from datetime import datetime, timezone

from pyspark.sql import functions as F

from lessonloom.operators import study as S

HOUR = 3_600_000


def ms(day, hour=5):
    return int(datetime(2026, 8, day, hour, tzinfo=timezone.utc).timestamp() * 1000)


def answers(spark, rows):
    return spark.createDataFrame(rows, "created_at long, correct boolean")


def lessons(spark, rows):
    return spark.createDataFrame(rows, "created_at long, lesson_key string")


def test_dashboard(spark):
    a = answers(spark, [(ms(25), True), (ms(25), False), (ms(23), True)])
    b = lessons(spark, [(ms(25), "x"), (ms(25), "x"), (ms(25), "y"), (ms(24), "z")])
    days = S.activity_days(a, b, "2026-08-25")
    rows = {str(r.day): r for r in days.collect()}
    assert sorted(rows) == [f"2026-08-{d}" for d in range(19, 26)]
    assert (rows["2026-08-25"].answered, rows["2026-08-25"].wrong, rows["2026-08-25"].lessons) == (2, 1, 2)
    t = S.activity_totals(days).first()
    assert (t.answered, t.accuracy, t.streak) == (3, 50, 3)  # the accuracy is that of today and abs(t.mean_answers - 3 / 7) < 1e-12


def test_midnight_in_another_zone(spark):
    at = int(datetime(2026, 8, 24, 17, 0, tzinfo=timezone.utc).timestamp() * 1000)  # 00:00 at +7
    days = S.activity_days(answers(spark, [(at - 1, True), (at, True)]), lessons(spark, []), "2026-08-25")
    assert {str(r.day): r.answered for r in days.collect() if r.answered} == {"2026-08-24": 1, "2026-08-25": 1}


def test_malformed_rows_count_nothing(spark):
    t = S.activity_totals(S.activity_days(answers(spark, [(-1, True)]), lessons(spark, [(ms(25), "  ")]), "2026-08-25")).first()
    assert (t.answered, t.lessons, t.streak, t.accuracy, t.chart_top) == (0, 0, 0, 0, 1)


SCHEMA = "atom_id string, status string, mastery double, due_at long, last_studied_at long, ord int"


def test_snapshot_and_its_ties(spark):
    a = spark.createDataFrame([("a", "MASTERED", 0.9, 5, 10, 0), ("b", "IN_PROGRESS", 0.2, 9, 30, 1), ("c", "IN_PROGRESS", 0.4, 0, 20, 2), ("d", "NEW", 0.0, 0, None, 3)], SCHEMA)
    assert tuple(S.snapshot(a, 10).first()) == (2, "b", "b")
    tie = spark.createDataFrame([("b", "IN_PROGRESS", float("nan"), 0, 7, 0), ("a", "IN_PROGRESS", -3.0, -5, 7, 0)], SCHEMA)
    assert tuple(S.snapshot(tie, 10).first()) == (0, "a", "a")
    assert tuple(S.snapshot(a.limit(0), 10).first()) == (0, None, None)


def test_division_and_selection(spark):
    atoms = spark.createDataFrame([("a", 0, 0, None), ("b", 0, 1, ["a"]), ("c", 0, 2, ["a", "x"]), ("d", 1, 0, [])], "atom_id string, group_order long, ord int, prerequisite_ids array<string>")
    done = spark.createDataFrame([("a",)], "atom_id string")
    assert {r.atom_id: r.eligible for r in S.eligible(atoms, done).collect()} == {"a": True, "b": True, "c": False, "d": True}
    state = spark.createDataFrame([("a", "MASTERED", 5, 0.9)], "atom_id string, status string, due_at long, mastery double")
    assert S.next_item(atoms, state, 100).first().atom_id == "b"
    all_done = spark.createDataFrame([(x, "MASTERED", 5 + k, 0.9) for k, x in enumerate("abcd")], state.schema)
    assert S.next_item(atoms, all_done, 100).first().atom_id == "a"


def test_fold(spark):
    rows = [("a", k, k, c) for k, c in enumerate([True, True, False, True, True, True, True, True])]
    r = S.mastery_fold(spark.createDataFrame(rows, "atom_id string, created_at long, event_id long, correct boolean")).first()
    m, b, d = 0.0, 1, False
    for *_, c in rows:
        if c:
            m, b = min(1.0, max(0.1, m) + 0.2), min(5, b + 1)
            d = d or m >= 0.8
        else:
            m, b, d = max(0.1, m - 0.15), 1, False
    assert (r.mastery, r.leitner_box, r.mastered) == (round(m, 6), b, d)


def test_latest_keeps_one_row_a_key(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("k", 3, "z"), ("l", 0, None)], "k string, at int, v string")
    assert {tuple(r) for r in S.latest(df, ["k"], [F.col("at")]).collect()} == {("k", 3, "z"), ("l", 0, None)}
