"""Types of file records and of what comes out of a run."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()

#: What goes wrong with a file, by where it went wrong.
ERRORS = ("conversion", "cloudUpload", "diskWrite", "pipeline", "fallback", "message")

METADATA = T.StructType(
    [
        T.StructField("isBackupFallback", _B),
        T.StructField("isSkipped", _B),
        T.StructField("isProcessed", _B),
        T.StructField("errors", T.StructType([T.StructField(e, _S) for e in ERRORS])),
    ]
)

#: One row for each file; ``arrival_idx`` orders the files of a request.
FILE = T.StructType(
    [
        T.StructField("request_id", _S),
        T.StructField("arrival_idx", _L),
        T.StructField("fieldname", _S),
        T.StructField("originalname", _S),
        T.StructField("encoding", _S),
        T.StructField("mimetype", _S),
        T.StructField("path", _S),
        T.StructField("content", T.BinaryType()),
        T.StructField("size", _L),
    ]
)

CLOUD = T.StructType(
    [
        T.StructField("cloudProvider", _S),
        T.StructField("cloudUrl", _S),
        T.StructField("cloudPublicId", _S),
        T.StructField("cloudSize", _L),
        T.StructField("cloudFormat", _S),
        T.StructField("cloudWidth", _I),
        T.StructField("cloudHeight", _I),
        T.StructField("cloudCreatedAt", _S),
        T.StructField("cloudResourceType", _S),
        T.StructField("cloudBucket", _S),
        T.StructField("cloudRegion", _S),
        T.StructField("cloudETag", _S),
        T.StructField("cloudContentType", _S),
        T.StructField("cloudRaw", _S),
    ]
)
