"""Token ids in ORC files.

One row per document: ``doc_id``, ``block`` and ``local_start`` (its place in
the stream of ids), ``n_tokens``, ``ids``.  ORC run-length encodes the integers; stripes can
be read in parallel; stripe and row-group statistics, with a Bloom filter on
``doc_id``, let a reader skip what a lookup does not need.

Rows are range-partitioned and sorted by ``doc_id``, so the files, in the order
of their names, hold the ids in ascending order of ``doc_id``.  A document's
place in the whole stream is its place in its block plus the lengths of the
blocks before, of which there is one for each written partition.

Defined results: a null text counts as empty and has the end id alone; rows
that share a ``doc_id`` stand in the order of their texts' hashes, equal rows
next to each other; null ids come first; an empty table gives files without
rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import blocks, encoder

SCHEMA = "doc_id long, block int, local_start long, n_tokens int, ids array<int>"
#: Rows for which the files hold statistics and a Bloom filter.
ROW_GROUP = 1_000
STRIPE_BYTES = 16 << 20


def _encode(path: str, end_id: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in blocks(batches):
            at = 0
            for size, ids in coder.encode(batch.column(1)):
                n = len(size)
                end = np.cumsum(size)
                with_end = np.insert(ids, end, end_id).astype(np.int32)
                offsets = np.r_[0, end + np.arange(1, n + 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(np.full(n, block, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(with_end)),
                    ],
                    ["doc_id", "block", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])
                at += n

    return of_batches


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the files to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (in the whole stream) and ``ids`` of every document."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = sorted(rows.groupBy("block").agg(F.sum("n_tokens")).collect())  # one row for each file; the ids are not read
    base, bases = 0, []
    for block, n in sums:
        bases.append((block, base))
        base += n
    bases = spark.createDataFrame(bases, "block int, base long")
    return rows.join(F.broadcast(bases), "block").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of some documents; statistics and Bloom filters prune the rest."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of what :func:`read` gives."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(of_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
