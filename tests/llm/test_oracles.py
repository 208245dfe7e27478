"""Queries with SQL give the rows of DuckDB, and all queries run."""

import pytest
from compare import difference

from cairn.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Rows of queries without SQL that do not give one for each document.
ROWS = {"op12_lanczos_whitening": 4 * 500}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert difference(df, ORACLE_SQL[name], SF) == ""
    else:
        assert df.count() == ROWS.get(name, 200)
