"""Every query of the price domain against its SQL on the smallest tables."""

import pytest

from tests.oracle import connect, same
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"mod1_trees"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_is_stable(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema == __spark_entry__.entry(spark).schema
