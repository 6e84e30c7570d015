"""Every query against DuckDB at the smallest scale."""

import pytest

from leadframe.plans.oracles import ORACLES
from leadframe.plans.queries import QUERIES

from .conftest import DATA
from .harness import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")


def test_every_query_is_accounted_for():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc", "page_number", "score", "reasons", "rank"] and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
