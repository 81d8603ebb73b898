"""Files without bytes are listed by executors: the driver asks for none of them."""

import os

import pytest

from gristmill.sources import files as sources


@pytest.fixture
def landed(tmp_path):
    for at in ("r 1/a/x.txt", "r 1/a/e%20.txt", "r2/b/c/d/e.txt", "e.txt", "r2/b/_e.txt", "r2/.b/e.txt", "r2/b/.part-1", "_r/e.txt"):
        (tmp_path / "in" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / at).write_bytes(b"x" * at.endswith("x.txt"))
    os.utime(tmp_path / "in" / "e.txt", ns=(10**18, 10**18 + 1_999_999))
    return tmp_path / "in"


def test_files_without_bytes_are_listed_by_executors(spark, landed, monkeypatch):
    monkeypatch.setattr(sources, "_ask_empty", lambda *a: pytest.fail("the driver asks for single files"), raising=False)
    monkeypatch.setattr(type(spark.range(1)), "inputFiles", lambda self: pytest.fail("the driver takes all paths"))
    rows = {r.path.removeprefix(f"file:{landed}/"): (r.length, bytes(r.content)) for r in sources.read_files(spark, f"file://{landed}").collect()}
    assert rows == {"r 1/a/x.txt": (1, b"x"), "r 1/a/e%20.txt": (0, b""), "r2/b/c/d/e.txt": (0, b""), "e.txt": (0, b"")}


def test_both_ways_of_listing_agree(spark, landed):
    path = f"file://{landed}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    asked = spark.createDataFrame(sources._ask_empty(spark, found), "path string, at long").selectExpr("path", "timestamp_millis(at) AS modificationTime")
    listed = sources._empty_files(spark, path, found).select("path", "modificationTime")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, asked.collect())) and listed.count() == 3
    one = sources._empty_files(spark, f"{path}/r2/b/c/d/e.txt", found)
    assert [r.path for r in one.collect()] == [f"file:{landed}/r2/b/c/d/e.txt"]
    assert sources._empty_files(spark, f"{path}/r*", found).count() == 2


def test_a_task_reads_many_small_files(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.txt").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = sources.read_files(spark, f"file://{tmp_path}")
    # Four tasks of the listing, and of the scan four; at Spark's own open cost it has 13.
    assert found.rdd.getNumPartitions() <= 9 and found.count() == 400
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
