"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

SLOW = {"gradient_boosting", "cross_validate"}


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", [n for n in entry_module.QUERIES if n not in SLOW])
def test_query(spark, small, con, name):
    got = entry_module.queries()[name](spark, small).toPandas()
    assert not got.columns.duplicated().any()
    sql = entry_module.oracle_sql().get(name)
    if sql is not None:
        assert check.difference(got, con.execute(sql).fetchdf()) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == entry_module.entry(spark).columns
    scores = [r.lead_score for r in df.collect()]
    assert scores and scores == sorted(scores, reverse=True)


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
