import math

import pytest

import __spark_entry__ as entry
from nodelake.plans import registry

from .conftest import SF


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    assert name in registry.ORACLES
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLES[name]})").fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["pos", "path", "ancestors", "segment", "balance"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_engine(spark):
    for name in ("q_flagship", "q_and", "a_latest_event", "n_block2d", "j_event_semi", "r_partition"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Cartesian")), name
