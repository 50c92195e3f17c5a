"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf, name):
    result, _ = compare(spark, con, name, sf)
    assert result.startswith(("ok", "rows-only")), result
    assert "types" not in result and "EMPTY" not in result, result


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns[:2] == ["sample", "cut"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
