"""Every registered query of the text operators that SQL can express against its SQL, over whole tables."""

import pytest
from compare import SF_DIR, assert_same

from codestrata.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    assert_same(queries()[name](spark, SF_DIR), oracle_sql()[name])
