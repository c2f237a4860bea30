"""Every library query against its SQL; those without SQL must give rows."""

import pytest

import __spark_entry__
from conftest import SF, same_rows
from gridloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same_rows(df, duck, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
