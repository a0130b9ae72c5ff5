"""Queries against the SQL of their oracle."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.plans import catalog_io  # noqa: F401
from scorelake.plans.catalog import _TOKENS, ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(oracle.execute(ORACLE_SQL[name]).df())


def test_all_tokens_of_each_text(spark, oracle):
    """q31_tokens gives the first five only."""
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.array_join(F.array_sort(text.tokens(F.col("text"))), " ").alias("t")).toPandas()
    assert plain(got) == plain(oracle.execute(f"SELECT doc_id, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS t FROM documents").df())


def test_flagship(spark):
    assert flagship(spark, SF).first().total_count > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
