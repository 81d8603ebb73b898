import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

TOP = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join([TOP, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='gristmill-tests-')}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(_plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Assert that a query gives the rows of its SQL on the smallest tables."""
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")

    def check(query, sql):
        found = query(spark, SMALL)
        told = db.execute(sql)
        names = [c[0] for c in told.description]
        assert sorted(names) == sorted(found.columns)
        order = sorted(names)
        rows = sorted(([_plain(r[c]) for c in order] for r in found.collect()), key=repr)
        wanted = sorted(([_plain(r[names.index(c)]) for c in order] for r in told.fetchall()), key=repr)
        assert rows == wanted

    return check
