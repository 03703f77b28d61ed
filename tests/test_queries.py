"""Every registered query of the stream operators against its SQL."""

import oracle
import pytest

from streamcheck.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    f, text = registry.REGISTERED[name]
    assert oracle.compare(spark, name, f, text, SF, con) > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
