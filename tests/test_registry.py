from __future__ import annotations

import pytest

from tarnwork.plans import registry

from .compare import connect, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    same(registry.queries()[name](spark, data), registry.oracle_sql()[name], connect(data))


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "f2" in df.columns
