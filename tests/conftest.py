"""One local session for all tests, and the comparison of a query with its SQL."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as both engines would show it."""
    if isinstance(value, float):
        return round(value, 6) if value == value else "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


@pytest.fixture(scope="session")
def agrees():
    def compare(df, sql):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        expected = rows_of(columns, found.fetchall())
        assert sorted(df.columns) == sorted(columns)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert len(got) == len(expected)
        differing = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
        assert not differing, f"{len(differing)} rows differ, first: {differing[0]}"

    return compare
