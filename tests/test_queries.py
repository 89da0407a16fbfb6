import pytest

from cinderlake import queries as core
from tests.compare import DATA, both

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    a, b, mine, theirs = both(spark, core.queries()[name], SQL[name])
    assert a == b
    assert len(mine) == len(theirs)
    assert mine == theirs
    assert name in ("a20_ratio_summary",) or mine


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    core.queries()[name](spark, str(DATA)).collect()


def test_flagship(spark):
    assert core.flagship(spark, str(DATA)).count() > 0


def test_boxes_take_all_orders(spark):
    t = core.Tables(spark, str(DATA))
    assert t.boxes().count() == t.read("orders").count()
    for name in ("j10_overlapping", "j11_leaks"):
        assert core.queries()[name](spark, str(DATA)).where("a_id % 5 != 0 and b_id % 5 != 0").limit(1).count() == 1


def test_bootstrap_takes_2000_draws(spark):
    t = core.Tables(spark, str(DATA))
    want = core.evaluation.paired_bootstrap(t.counts(), "first", "second", draws=2000).first().asDict()
    got = core.queries()["a28_paired_bootstrap"](spark, str(DATA)).first().asDict()
    # the query rounds what it tells
    assert got == {k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()}
