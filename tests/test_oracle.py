"""Every registered query against its DuckDB oracle on the sf0.01 tables."""
import os

import pytest

from linkflow.plans.catalog import oracle_sql, queries
from tests.oracle import compare

SF = os.environ.get("LINKFLOW_TEST_SF", "/root/testdata/sf0.01")
NAMES = sorted(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, msg = compare(queries()[name](spark, SF), oracle_sql()[name], SF)
    assert ok, msg


def test_every_query_has_a_spec():
    assert set(oracle_sql()) <= set(queries())
