"""Ingest of files as they land."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import IngestOptions
from ..plans.ingest import ingest
from ..sources.files import from_landing

#: The columns of the binaryFile source.
LANDED = "path string, modificationTime timestamp, length long, content binary"


def stream_landing(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of file records from ``<request>/<field>/<name>`` below a folder."""
    reader = spark.readStream.format("binaryFile").schema(LANDED).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return from_landing(reader.load(path))


def ingest_stream(files: DataFrame, options: IngestOptions, out: str, checkpoint: str, once: bool = True, **more: Any) -> StreamingQuery:
    """Ingest each batch with :func:`gristmill.plans.ingest.ingest`.

    A batch is written to its own folder under ``out`` and replaces what an
    earlier attempt at it left; names of stored files depend on the record
    alone.  So a batch that runs again changes nothing.  A request whose files
    land in several batches is limited batch by batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ingest(rows, options, **more).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
