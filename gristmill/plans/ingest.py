"""The two runs: ingest files, or convert files that are at hand."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConvertOptions, FieldConfig, IngestOptions
from ..functions import matching, naming
from ..functions.metrics import byte_count
from ..logs import log
from ..operators import codecs as images
from ..operators import limits, outcomes
from ..schema import CLOUD
from ..shipping import ship
from ..sinks.adapters import Adapter, preflight
from ..sinks.store import process


def _settings(files: DataFrame, fields: Mapping[str, FieldConfig]) -> DataFrame:
    """The matched field's settings as columns, with defaults for no match."""
    filled, plain = {k: v.filled() for k, v in fields.items()}, FieldConfig().filled()
    key = F.col("match_key")

    def of(name: str, kind: str) -> Column:
        return matching.setting(key, {k: getattr(v, name) for k, v in filled.items()}, getattr(plain, name), kind)

    return files.withColumns({"output": of("output", "string"), "format": of("format", "string"), "quality": of("quality", "double"), "keep_original": of("keep_original", "boolean"), "cloud_storage": of("cloud_storage", "boolean")})


def _targets(files: DataFrame, options: IngestOptions | ConvertOptions, root: str | None) -> DataFrame:
    """Where a file would be stored, and under which names."""
    disk = {k: v for k, v in options.fields.items() if v.filled().output == "disk"}
    dirs = {k: naming.resolve_dir(v.output_dir or options.output_dir, root) for k, v in disk.items()}
    folder = matching.setting(F.col("match_key"), dirs, None, "string")
    unique = F.concat_ws("/", F.col("request_id"), F.col("fieldname"), F.col("arrival_idx"), F.col("originalname"))
    name = naming.generated_name(F.col("originalname"), F.col("fieldname"), F.col("mimetype"), unique, digits=16)
    files = files.withColumns({"target_dir": folder, "target_name": name})
    return files.withColumns({"converted_name": naming.converted_name(F.col("target_name"), F.col("format")), "result_mimetype": naming.output_mimetype(F.col("format"))})


def plan_ingest(files: DataFrame, options: IngestOptions) -> DataFrame:
    """Match, settle and route, without touching the bytes.

    Adds ``match_key``, the settings, ``route`` and ``backup_tier``; files of
    fields that no key matches are dropped, silently.
    """
    keys = list(options.fields)
    matched = files.withColumn("match_key", matching.match_key(F.col("fieldname"), keys)).filter(F.col("match_key").isNotNull())
    settled = _settings(matched, options.fields)
    route = matching.route(F.col("mimetype"), F.col("keep_original"), F.col("cloud_storage"), F.col("output"))
    return settled.withColumns({"route": route, "backup_tier": matching.backup_tier(F.col("size"), options.spill_threshold)})


def _done(files: DataFrame, options: IngestOptions | ConvertOptions, codecs: Mapping[str, images.Codec] | None, adapters, fall_back: bool) -> DataFrame:
    """Convert and store what is to be, in one pass over one scan; all else stays in the JVM."""
    done = process(files, options.fields, options.safe_file, images.BUILT_IN if codecs is None else codecs, adapters, fall_back)
    said = F.when(F.col("route") == "skipped", F.concat(F.lit("unsupported image format "), F.col("mimetype"))).otherwise(F.col("convert_error"))
    return done.withColumns({"convert_error": said, "n_content": byte_count(F.col("content"))})


RESULT = ("request_id", "arrival_idx", "fieldname", "originalname", "encoding", "match_key", "route", "outcome")


def _result(files: DataFrame, with_cloud: bool) -> DataFrame:
    renamed = [F.col("result_mimetype").alias("mimetype"), F.col("result_size").alias("size"), "originalSize", "convertedSize", "buffer", F.col("result_path").alias("path"), "filename"]
    cloud = [F.col("cloud")[f].alias(f) for f in CLOUD.names] + ["error"] if with_cloud else []
    return files.select(*RESULT, *renamed, *cloud, "attempts", "_metadata")


def ingest(files: DataFrame, options: IngestOptions, codecs: Mapping[str, images.Codec] | None = None, adapters: Mapping[str, Callable[..., Adapter]] | None = None, root: str | None = None, probe: bool = False) -> DataFrame:
    """Ingest file records (see ``schema.FILE``); one result row for each file.

    A request with a file above the limit is rejected whole: each of its files
    has a row that says so, and none is kept.  Writing happens when the result
    is computed, so write the result once and read it from there, as
    :func:`ingest_to` does.
    With ``probe`` the places of cloud fields are asked first, and those that
    do not answer are logged.
    """
    ship(files.sparkSession)
    if probe:
        for field, wrong in preflight(options.cloud_fields(), adapters).items():
            if wrong:
                log.warning("field %s: %s", field, wrong)
    images.check_formats([v.filled().format for v in options.fields.values()], images.BUILT_IN if codecs is None else codecs)
    allowed = files.filter(matching.allowed(F.col("fieldname"), list(options.fields)))
    planned = _targets(plan_ingest(limits.marked(allowed, options.limit), options), options, root)
    over = F.col("over_limit").isNotNull()
    planned = planned.withColumn("route", F.when(over, F.lit("rejected")).otherwise(F.col("route")))
    done = _done(planned, options, codecs, adapters, False)
    why = F.concat(F.lit("a file of the request has "), F.col("over_limit").cast("string"), F.lit(f" bytes, above the limit of {options.limit}"))
    done = done.withColumn("convert_error", F.when(over, why).otherwise(F.col("convert_error")))
    return _result(outcomes.ingest_outcome(done, options.safe_file), True)


def ingest_to(files: DataFrame, options: IngestOptions, path: str, **more: Any) -> DataFrame:
    """Ingest once: write the result to ``path``, and with it the files, and read it from there."""
    result = ingest(files, options, **more)
    result.write.parquet(path)
    return files.sparkSession.read.schema(result.schema).parquet(path)


def convert(files: DataFrame, options: ConvertOptions, codecs: Mapping[str, images.Codec] | None = None, root: str | None = None, wildcards: bool = False) -> DataFrame:
    """Convert files in memory; one result row for each file.

    Fields without settings take the defaults, files without bytes and files
    that are not images pass as they are, and a failure leaves the original.
    """
    ship(files.sparkSession)
    plain = {k: FieldConfig(output=v.output, output_dir=v.output_dir, format=v.format, quality=v.quality, keep_original=v.keep_original) for k, v in options.fields.items()}
    found = files.withColumn("match_key", matching.match_key(F.col("fieldname"), list(plain), wildcards))
    settled = _settings(found, plain)
    todo = matching.should_convert(F.col("mimetype"), F.col("keep_original")) & F.col("content").isNotNull()
    routed = settled.withColumn("route", F.when(todo, F.concat(F.col("output"), F.lit("_convert"))).otherwise(F.lit("memory_passthrough")))
    plain_options = ConvertOptions(fields=plain, output_dir=options.output_dir, safe_file=options.safe_file)
    done = _done(_targets(routed, plain_options, root), plain_options, codecs, None, True)
    return _result(outcomes.convert_outcome(done, options.safe_file), False)


def empty_content(files: DataFrame) -> DataFrame:
    """Records without their bytes, for plans that need only names and sizes."""
    return files.withColumn("content", F.lit(None).cast(T.BinaryType()))
