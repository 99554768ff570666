"""One local session for all tests, and a comparison of DataFrames with DuckDB."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.default.parallelism", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def matches():
    """matches(df, sql, sf_dir): asserts that both give the same columns and rows."""

    def check(df, sql: str, sf_dir: str) -> int:
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        got = con.execute(sql)
        names, want = [d[0] for d in got.description], got.fetchall()
        assert sorted(names) == sorted(df.columns)
        a, b = rows_of(df.columns, df.collect()), rows_of(names, want)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y
        return len(a)

    return check
