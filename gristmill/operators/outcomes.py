"""What comes of each file: the result columns and the record of errors.

Rows carry what happened to them: ``route``; ``n_content`` and ``n_converted``,
the sizes of the original and of what it became; ``converted`` (bytes of files
that stay in memory) or ``convert_error``; ``store_error`` for what was to be stored; ``backup_error``
where a backup was stored instead; the place in ``stored_path``,
``stored_name`` and the ``cloud`` struct.  ``outcome`` names the end:

``stored``      passed on as it is
``converted``   converted, and stored where it was to go
``fallback``    conversion or storing failed, the original took its place
``skipped``     nothing could be kept
``rejected``    a file of its request is above the limit
``unchanged``   conversion alone: the file stays as it was
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import output_mimetype
from ..schema import CLOUD, ERRORS, METADATA

FALLBACK, SKIPPED = (True, False, True), (False, True, False)


def metadata(state: tuple[bool, bool, bool], **errors: Column) -> Column:
    """The record of an end that was not a plain success."""
    found = [errors[e].cast("string").alias(e) if e in errors else F.lit(None).cast("string").alias(e) for e in ERRORS]
    names = ("isBackupFallback", "isSkipped", "isProcessed")
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, state)], F.struct(*found).alias("errors")).cast(METADATA)


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def has_backup(safe_file: bool) -> Column:
    """Whether there are original bytes to fall back to."""
    return F.lit(safe_file) & (F.coalesce("n_content", F.lit(0)) > 0)


def ingest_outcome(files: DataFrame, safe_file: bool) -> DataFrame:
    """Result columns of an ingest run."""
    to, how = F.substring_index("route", "_", 1), F.substring_index("route", "_", -1)
    convert, stores = how == "convert", to != "memory"
    bad, store_bad, backup_bad = F.col("convert_error").isNotNull(), F.col("store_error").isNotNull(), F.col("backup_error").isNotNull()
    fell = convert & bad & has_backup(safe_file) & ~backup_bad
    skipped, rejected = F.col("route") == "skipped", F.col("route") == "rejected"
    lost = convert & bad & ~fell
    unstored = stores & store_bad & ~(convert & bad)
    outcome = _first(
        [(rejected, F.lit("rejected")), (skipped | lost | unstored, F.lit("skipped")), (fell, F.lit("fallback")), (convert, F.lit("converted"))],
        F.lit("stored"),
    )
    error, where = F.col("convert_error"), F.col("store_error")
    both = F.concat_ws("; ", error, F.col("backup_error"))
    tried = convert & bad & backup_bad
    none = F.lit(None).cast(METADATA)
    record = _first(
        [
            (skipped | rejected, metadata(SKIPPED, message=F.col("convert_error"))),
            (fell & (to == "disk"), metadata(FALLBACK, pipeline=error)),
            (fell, metadata(FALLBACK, conversion=error)),
            (tried & (to == "disk"), metadata(SKIPPED, pipeline=error, fallback=F.col("backup_error"), message=both)),
            (tried & (to == "cloud"), metadata(SKIPPED, conversion=error, cloudUpload=F.col("backup_error"), message=both)),
            (lost & (to == "disk"), metadata(SKIPPED, pipeline=error, message=error)),
            (lost, metadata(SKIPPED, conversion=error, message=F.when(backup_bad, both).otherwise(error))),
            (unstored & (to == "disk"), metadata(SKIPPED, diskWrite=where, message=where)),
            (unstored, metadata(SKIPPED, cloudUpload=where, message=where)),
        ],
        none,
    )
    original, now = F.col("n_content"), F.col("n_converted")
    ok = outcome == "converted"
    kept = outcome.isin("stored", "fallback")
    there = ~outcome.isin("skipped", "rejected")
    memory = to == "memory"
    null_long = F.lit(None).cast("long")
    return files.withColumns(
        {
            "outcome": outcome,
            "result_mimetype": F.when(ok, output_mimetype(F.col("format"))).otherwise(F.col("mimetype")),
            "result_size": _first([(ok & memory, now), (kept & ~(fell & (to == "cloud")), original)], null_long),
            "originalSize": F.when(ok | (fell & (to != "cloud")), original),
            "convertedSize": F.when(ok & stores, now),
            "buffer": F.when(there & memory, F.when(ok, F.col("converted")).otherwise(F.col("content"))),
            "result_path": F.when(there & (to == "disk"), F.col("stored_path")),
            "filename": F.when(there & (to == "disk"), F.col("stored_name")),
            "cloud": F.when(there & (to == "cloud"), F.col("cloud")).otherwise(F.lit(None).cast(CLOUD)),
            "error": F.when(skipped | rejected, F.col("convert_error")),
            "_metadata": record,
        }
    )


def convert_outcome(files: DataFrame, safe_file: bool) -> DataFrame:
    """Result columns of a conversion without ingest."""
    convert, disk = F.col("route").endswith("_convert"), F.col("route").startswith("disk")
    bad, store_bad = F.col("convert_error").isNotNull(), F.col("store_error").isNotNull()
    failed = convert & (bad | (disk & store_bad))
    backed = has_backup(safe_file) & ~F.col("backup_error").isNotNull()
    fell, ok = failed & backed, convert & ~failed
    outcome = _first([(fell, F.lit("fallback")), (ok, F.lit("converted"))], F.lit("unchanged"))
    record = _first(
        [(fell & bad, metadata(FALLBACK, conversion=F.col("convert_error"))), (fell, metadata(FALLBACK, diskWrite=F.col("store_error")))],
        F.lit(None).cast(METADATA),
    )
    original, now = F.col("n_content"), F.col("n_converted")
    sized = ok | fell
    size = F.when(ok, now).otherwise(original)
    return files.withColumns(
        {
            "outcome": outcome,
            "result_mimetype": F.when(ok, output_mimetype(F.col("format"))).otherwise(F.col("mimetype")),
            "result_size": F.when(sized, size).otherwise(F.col("size")),
            "originalSize": F.when(sized, original),
            "convertedSize": F.when(sized, size),
            "buffer": F.when(sized & disk, F.lit(None).cast("binary")).when(ok, F.col("converted")).otherwise(F.col("content")),
            "result_path": F.when(sized & disk, F.col("stored_path")),
            "filename": F.when(sized & disk, F.col("stored_name")),
            "_metadata": record,
        }
    )
