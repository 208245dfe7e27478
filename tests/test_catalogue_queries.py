"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import difference

from cairn.plans.search_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express, and rows that they give at least; other tests compare their operators with plain Python.
WITHOUT_SQL = {"v01_sentence_chunks": 200, "v03_indexed_join": 100}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    if name in WITHOUT_SQL:
        assert df.count() >= WITHOUT_SQL[name]
        return
    assert name in ORACLE_SQL
    assert difference(df, ORACLE_SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark):
    """Queries over lineitem take all of its rows."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name in ("p03_distribution_columns", "p19_default_title"):
        assert QUERIES[name](spark, SF).count() == lines
