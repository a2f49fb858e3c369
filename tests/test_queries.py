"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import DATA, difference

SF_DIR = str(DATA / "sf0.001")


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert difference(df, oracle_sql()[name], SF_DIR) is None
    else:
        assert df.count() > 0
