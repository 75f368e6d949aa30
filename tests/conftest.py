"""Shared fixtures: one Spark session, the smallest tables and their DuckDB views."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    """A value's text for comparison; doubles to nine significant digits."""
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    """Holds a query's rows and columns against its SQL."""
    def check(query, sql):
        df = query(spark, sf_dir)
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())

    return check
