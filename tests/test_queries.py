"""Registered queries against their check SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

# Long jobs; `python -m tests.compare` runs them all at sf0.01.
_LONG = ("str1", "str5", "str7", "snk4", "snk5", "agg25", "exp12", "exp13", "exp1_", "exp2_", "exp3_", "exp4_")
CHECKED = [n for n in contract.oracle_sql() if not n.startswith(_LONG)]


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_check(spark, db, folder, name):
    assert difference(spark, db, name, folder) in (None, "no rows")


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
