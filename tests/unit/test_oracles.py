"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from liftloom.plans import catalogue, terms

TABLES = "/root/testdata/sf0.001"
NAMES = [*terms.QUERIES, "knn_cosine", "greedy_no_replacement", "shapley_values", "forecast_columns"]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    sql = duckdb.connect()
    for file in os.listdir(TABLES):
        if file.endswith(".parquet"):
            sql.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{TABLES}/{file}'")
    found, wanted = catalogue.queries()[name](spark, TABLES).toPandas(), sql.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns) and len(found)
    rows = lambda df: sorted(map(tuple, df[columns].to_numpy().tolist()))
    assert rows(found) == rows(wanted)
