"""Every named query against its SQL, or for rows and a stable schema where SQL can't express it."""

import pytest

from tests.conftest import SF_DIR
from wayfarer.plans import catalog


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, agrees, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    if name in catalog.ORACLE_SQL:
        agrees(df, catalog.ORACLE_SQL[name])
    else:
        assert df.columns and len(df.collect()) > 0
