"""Every registered query against DuckDB at the smallest scale."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    return connect(SF)


OWN = sorted(n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d", n))


def test_names():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert difference(df, duck, entry.oracle_sql()[name]) is None


def test_entry(spark, duck):
    rows = entry.entry(spark).collect()
    assert len(rows) == 18 and all(0 <= r.f1 <= 1 for r in rows)
