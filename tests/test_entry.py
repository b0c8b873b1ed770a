"""The driver's contract, and the queries on empty tables."""

import glob
import os

import __spark_entry__
import pytest
from tests.conftest import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def test_every_sql_has_its_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_entry(spark):
    assert len(rows(__spark_entry__.entry(spark))) > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for path in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def test_queries_on_empty_tables(spark, empty):
    """As many rows as the SQL gives on empty tables (aggregates over everything give one even so), none without SQL."""
    duckdb = pytest.importorskip("duckdb")
    tables = duckdb.connect()
    for path in glob.glob(f"{empty}/*.parquet"):
        tables.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name, query in queries.items():
        want = len(tables.execute(sql[name]).fetchall()) if name in sql else 0
        assert len(query(spark, empty).collect()) == want, name


def test_extra_columns_with_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    for path in glob.glob(f"{DATA}/*.parquet"):
        frame = spark.read.parquet(path)
        for extra in ("v", "k1", "pos", "path", "qn", "rank", "n", "kind2", "prints", "ids", "bucket"):
            if extra not in frame.columns:
                frame = frame.withColumn(extra, F.lit(1))
        frame.write.parquet(f"{tmp_path}/{os.path.basename(path)}")
    for name in [n for n in __spark_entry__.queries() if n[0] == "p" and n[1].isdigit()]:
        query = __spark_entry__.queries()[name]
        assert rows(query(spark, str(tmp_path))) == rows(query(spark, DATA)), name
