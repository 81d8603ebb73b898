"""Files as rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE
from ..shipping import ship

#: MIME types by extension.
MIME_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "gif": "image/gif",
    "avif": "image/avif",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "svg": "image/svg+xml",
    "heif": "image/heif",
    "heic": "image/heic",
    "bmp": "image/bmp",
    "pdf": "application/pdf",
    "txt": "text/plain",
    "csv": "text/csv",
    "json": "application/json",
    "mp4": "video/mp4",
}


def mimetype_of(name: Column) -> Column:
    """By extension; octet-stream if it is not known."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME_TYPES.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def from_landing(found: DataFrame) -> DataFrame:
    """File records from the binaryFile columns of ``<request>/<field>/<name>``.

    Files arrive in the order of their modification time; the path breaks ties
    and makes the order the same on each read.
    """
    at = F.split("path", "/")
    arrival = F.unix_micros("modificationTime")
    return found.select(
        F.element_at(at, -3).alias("request_id"),
        arrival.alias("arrival_idx"),
        F.element_at(at, -2).alias("fieldname"),
        F.element_at(at, -1).alias("originalname"),
        F.lit("binary").alias("encoding"),
        mimetype_of(F.element_at(at, -1)).alias("mimetype"),
        F.col("path"),
        F.col("content"),
        F.col("length").alias("size"),
    )


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """All files below a landing folder; the bytes are read only if they are used."""
    return from_landing(read_files(spark, path))


#: Bytes that opening a file counts as, unless the session sets a number of its own.
OPEN_BYTES = 256 << 10
_OPEN = "spark.sql.files.openCostInBytes"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The binaryFile columns of all files below a folder, also of those without bytes.

    The source leaves files without bytes out of its rows; they are put back
    from a second listing.
    """
    # Opening a file counts as OPEN_BYTES in this scan alone: at Spark's 4 MB a task would read 32 small files.
    own = spark._jsparkSession.cloneSession()
    if spark.conf.get(_OPEN, None) is None:
        own.conf().set(_OPEN, str(OPEN_BYTES))
    found = DataFrame(own.read().format("binaryFile").option("recursiveFileLookup", "true").load(path), spark)
    return _empty_files(spark, path, found).unionByName(found)


def _empty_files(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Rows for the files that have no bytes.

    Executors list local folders, so the driver sees the uppermost names alone;
    elsewhere it takes the paths of all files from the source's listing and
    asks for the times of the empty ones.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.makeQualified(top).toUri().getScheme() == "file":
        ship(spark)
        tops = [x.getPath().toUri().getPath() for x in system.globStatus(top)]
        inner = [(x.path, True) for at in tops if os.path.isdir(at) for x in os.scandir(at) if x.is_dir() and not _hidden(x.name)]
        times = spark.createDataFrame(inner + [(at, False) for at in tops], "folder string, deep boolean").mapInArrow(_list_empty, "path string, at long")
    else:
        times = spark.createDataFrame(_ask_empty(spark, found), "path string, at long")
    return times.select("path", F.timestamp_millis("at").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").cast("binary").alias("content"))


def _hidden(name: str) -> bool:
    """Whether the source takes no notice of a name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _list_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and time of the files without bytes in folders, or below them."""
    for batch in batches:
        for top, deep in zip(*(c.to_pylist() for c in batch.columns)):
            for at, inner, names in os.walk(top, followlinks=True) if os.path.isdir(top) else [("", [], [top])]:
                inner[:] = [x for x in inner if deep and not _hidden(x)]
                paths = [os.path.join(at, x) for x in names if not _hidden(os.path.basename(x))]
                empty = [(x, s.st_mtime_ns // 1_000_000) for x in paths if (s := os.stat(x)).st_size == 0]
                if empty:
                    yield pa.RecordBatch.from_arrays([pa.array([f"file:{x}" for x, _ in empty]), pa.array([t for _, t in empty], pa.int64())], ["path", "at"])


def _ask_empty(spark: SparkSession, found: DataFrame) -> list[tuple[str, int]]:
    """The same of a source's listing, from the driver."""
    listed = [(re.sub(r"^file:/+", "file:/", unquote(x)),) for x in found.inputFiles()]
    rows = []
    for (path,) in spark.createDataFrame(listed, "path string").join(found.select("path"), "path", "left_anti").collect():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        rows.append((path, status.getModificationTime()))
    return rows


def from_buffers(rows: DataFrame, files_col: str = "files", request_col: str = "request_id") -> DataFrame:
    """File records from a column of files in memory.

    The column is an array of structs, or a map of field names to such arrays;
    missing parts of a record are null.
    """
    kind = rows.schema[files_col].dataType.simpleString()
    if kind.startswith("map"):
        flat = rows.select(F.col(request_col), F.explode(files_col).alias("_field", "_files")).select(request_col, "_field", F.posexplode("_files").alias("_at", "f"))
    else:
        flat = rows.select(F.col(request_col), F.lit(None).cast("string").alias("_field"), F.posexplode(files_col).alias("_at", "f"))
    there = {f.name for f in flat.schema["f"].dataType.fields}

    def of(field) -> Column:
        if field.name == "request_id":
            out = F.col(request_col)
        elif field.name == "arrival_idx" and "arrival_idx" not in there:
            out = F.col("_at")
        elif field.name == "fieldname":
            own = F.col("f.fieldname") if "fieldname" in there else F.lit(None)
            out = F.coalesce(F.col("_field"), own.cast("string"))
        elif field.name == "size" and "size" not in there and "content" in there:
            out = F.octet_length("f.content")
        else:
            out = F.col(f"f.{field.name}") if field.name in there else F.lit(None)
        return out.cast(field.dataType).alias(field.name)

    return flat.select(*[of(x) for x in FILE.fields])
