import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from harness import SF, compare, views  # noqa: E402

from quarry.operators import registry  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return views()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, db, name):
    compare(spark, db, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
