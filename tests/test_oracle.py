"""Every core query with SQL gives DuckDB's rows over the whole small tables."""

import pytest
from conftest import DATA
from oracle import duck, rows

from lodestone.plans import catalog

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck(catalog.oracle_sql()[name], FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
