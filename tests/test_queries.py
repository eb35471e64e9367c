import pytest

from lessonloom.plans import registry

from . import oracle

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.database(data)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    oracle.same(registry.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_stream_equals_batch(spark, data):
    q = registry.queries()
    cols = ["user_id", "mode", "inactive", "accepted", "revision", "signals"]
    assert sorted(q["signal_states"](spark, data).select(cols).collect()) == sorted(q["signal_states_streamed"](spark, data).select(cols).collect())
