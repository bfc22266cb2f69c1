"""Every registered query against its SQL, and that the comparison can fail."""

import pytest

from compare import canonical, connect, difference
from conftest import SF
from workload.oracle import ORACLE
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


@pytest.mark.parametrize("name,old,new", [
    ("blend_tiles", "/ 2 ELSE 1", "/ 3 ELSE 1"),
    ("tile_grid", "start + 480 + 16", "start + 480 + 17"),
    ("skip_reason", "width < 300", "width < 400"),
    ("frame_islands", "ORDER BY start", "ORDER BY start DESC"),
])
def test_a_changed_constant_is_noticed(spark, con, name, old, new):
    assert old in ORACLE[name]
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name].replace(old, new)) is not None


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["image_id", "c", "y", "h", "x", "v"] and df.limit(1).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
    assert canonical(["a"], [(1,), (0,)]) == canonical(["a"], [(0.0,), (1.0,)])
