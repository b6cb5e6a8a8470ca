"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from auditlake.plans import catalogue
from tests.compare import same_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    if name in catalogue.ORACLE_SQL:
        same_rows(df, catalogue.ORACLE_SQL[name], FOLDER)
    else:
        assert df.count() >= 0
