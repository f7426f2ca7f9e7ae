from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def larger():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if x != x else str(int(x)) if x == int(x) else f"{x:.6f}"
    return str(x)


@pytest.fixture(scope="session")
def same_rows():
    def check(df, con, sql: str) -> None:
        columns = sorted(df.columns)
        found = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
        told = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})")
        assert found == sorted(tuple(map(_plain, r)) for r in told.fetchall())

    return check
