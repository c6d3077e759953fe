"""Every registered query against its SQL twin; those without one must give rows."""

import pytest
from oracle import DATA, difference, duck

from flowloom.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    rows = registry.QUERIES[name](spark, SF).toPandas()
    assert len(rows)
    if name in registry.ORACLES:
        assert difference(rows, con.sql(registry.ORACLES[name]).df()) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(registry.QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).limit(1).count() == 1


def test_counts_that_were_measured_before(spark):
    """Numbers of flows that are known for these tables."""
    assert registry.QUERIES["flow_idle_sessions"](spark, SF).count() == 329
    assert registry.QUERIES["flow_exact_sessions"](spark, f"{DATA}/sf0.01").count() == 3374
