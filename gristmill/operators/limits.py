"""The size limit: one file above it rejects its whole request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rejected_requests(files: DataFrame, limit: float, request_col: str = "request_id", size_col: str = "size") -> DataFrame:
    """Requests with a file above the limit: id and greatest size.

    Only files above the limit are grouped, and the filter reaches the scan.
    """
    return files.filter(F.col(size_col) > limit).groupBy(request_col).agg(F.max(size_col).alias("largest"))


def within_limit(files: DataFrame, limit: float, request_col: str = "request_id", size_col: str = "size") -> DataFrame:
    """The files of all requests that keep to the limit."""
    over = rejected_requests(files, limit, request_col, size_col).select(F.col(request_col).alias("_over"))
    return files.join(over, files[request_col].eqNullSafe(over["_over"]), "left_anti")


#: Rejected requests are broadcast up to so many rows and bytes of ids.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def marked(files: DataFrame, limit: float, request_col: str = "request_id", size_col: str = "size") -> DataFrame:
    """All files, with ``over_limit``: the greatest size in their request, if that is above the limit.

    Rejected requests are counted first, from sizes alone.  Without any, no file
    is joined; a few are broadcast, so that no bytes of files are shuffled.
    """
    over = rejected_requests(files, limit, request_col, size_col).select(F.col(request_col).alias("_over"), F.col("largest").alias("over_limit"))
    n, n_bytes = over.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_over").cast("string"))), F.lit(0))).first()
    if not n:
        return files.withColumn("over_limit", F.lit(None).cast("long"))
    if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        over = F.broadcast(over)
    return files.join(over, files[request_col].eqNullSafe(over["_over"]), "left").drop("_over")
