"""Views of the test tables as files.

The tables hold no files, so names, types and fields of files are derived from
their columns, in the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IngestOptions

#: A MIME type for each remainder of an id.
KINDS = ("image/png", "image/bmp", "application/pdf", "image/jpeg", "text/plain")
S3 = {"region": "eu-west-1", "bucket": "corpus", "accessKeyId": "none", "secretAccessKey": "none"}
OPTIONS = IngestOptions(
    fields={
        "src1": {"output": "disk", "format": "jpeg", "quality": 70},
        "src1*": {"cloud_storage": True, "cloud_provider": "s3", "cloud_config": S3},
        "src0": {"keep_original": True},
        "s*2": {"output": "disk", "format": "png"},
        "src3": {},
    },
    safe_file=True,
    spill_threshold=4096,
)


def file_records(documents: DataFrame) -> DataFrame:
    """A file for each document; its text is the bytes."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents.select(
        (F.col("doc_id") % 50).cast("string").alias("request_id"),
        F.col("doc_id").alias("arrival_idx"),
        F.col("source").alias("fieldname"),
        F.concat("lang", F.lit(" Doc #"), "doc_id", F.lit(".TXT")).alias("originalname"),
        F.lit("binary").alias("encoding"),
        kind.alias("mimetype"),
        F.lit(None).cast("string").alias("path"),
        F.encode("text", "UTF-8").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
    )
