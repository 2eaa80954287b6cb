"""Every registered query of the engine against its SQL."""

import pytest
from comparing import rows_of

from fathomlog.plans import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    ours = queries.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
