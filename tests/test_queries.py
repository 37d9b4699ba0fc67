"""Every fact query against its SQL on the smallest tables."""

import pytest

from factweave.plans.catalog import ORACLE_SQL, QUERIES
from tests.compare import oracle_rows, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    columns, want = oracle_rows(ORACLE_SQL[name], SF)
    assert sorted(got.columns) == columns
    assert rows(got) == want
