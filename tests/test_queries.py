import pytest

import __spark_entry__ as entry
from compare import DATA, assert_same
from memgrid import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(plans.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams_equal_batches(spark):
    q = plans.queries()
    assert sorted(map(tuple, q["rolling_context_stream"](spark, DATA).collect())) == sorted(map(tuple, q["rolling_context"](spark, DATA).collect()))
