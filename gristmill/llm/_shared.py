"""Storage and join helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch as scratch_path

#: A key is hot when it holds at least one row in this many.
HOT_SHARE = 2_000


@cache
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda kept: 0)


def give_back() -> None:
    """Give the system the memory that this worker has freed, as workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`gristmill.storage.scratch`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: what is read no longer depends on any executor.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`written`, with the path, for tables that go before the end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by what is in it: equal rows have equal keys.

    Repeated rows have the same result, so they need no key apart.
    """
    text = F.col(text_col).cast("string")
    return F.struct(
        F.col(id_col).alias("id"),
        F.xxhash64(text, F.lit(1)).alias("a"),
        F.xxhash64(F.lit(2), text, text.isNull()).alias("b"),
    )


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str) -> DataFrame:
    """Join ``rows`` to ``table``, which has each key once and its row count.

    Keys with at least one in ``HOT_SHARE`` of all ``total`` rows number at
    most ``HOT_SHARE``, so their part of ``table`` is broadcast and their rows
    are not shuffled.  All other keys are light and meet in a shuffle join.
    ``how`` is ``inner`` or ``left``.
    """
    at_least = max(1_000, -(-total // HOT_SHARE))
    hot = F.broadcast(table.filter(F.col(weight) >= at_least))
    cold = table.filter(F.col(weight) < at_least)
    light = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key, "inner").unionByName(light)


def join_salted(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, salts: int = 32) -> DataFrame:
    """Inner join as :func:`join_hot`, for tables whose rows are too large to broadcast.

    Rows of a hot key (a long) go to one of ``salts`` partitions by a hash of the
    whole row, and that key's row of ``table`` is there once for each salt.
    Broadcast are the hot keys alone, at most ``HOT_SHARE`` longs.
    """
    at_least = max(1_000, -(-total // HOT_SHARE))
    hot = F.broadcast(table.filter(F.col(weight) >= at_least).select(F.col(key).alias("_hot")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    spread = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(salt)).drop("_hot")
    copies = F.when(F.col(weight) >= at_least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(table.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")


def keep_rows(docs: DataFrame, first: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose key is in ``first`` (``key``, ``n`` rows that have it), one for each key.

    Texts are shuffled once; only rows whose key repeats are grouped, and of
    these the first by all columns stays.
    """
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).join(first, "key")
    one = rows.filter("n = 1").select("row.*")
    many = rows.filter("n > 1").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.unionByName(many.select("row.*"))
