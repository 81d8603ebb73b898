"""The step that converts files and stores them, on disk or with a provider.

One pass through Python does both, and a file's bytes cross to it once: a
column of rows that need work goes in, and what came of each comes out; all
other columns, and the bytes of files that need nothing, stay where they are.
Bytes come back only for files that stay in memory.

Names do not depend on the attempt and files appear whole, so a task that runs
again writes the same objects again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FieldConfig
from ..operators.codecs import Codec, convert_one
from ..schema import CLOUD
from .adapters import Adapter, Upload, create_adapter, delete_file, write_whole

#: Bytes of a batch that crosses to Python.
BATCH_BYTES = 64 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

WORK = T.StructType(
    [
        T.StructField("converted", T.BinaryType()),
        T.StructField("n_converted", T.LongType()),
        T.StructField("convert_error", T.StringType()),
        T.StructField("stored_path", T.StringType()),
        T.StructField("stored_name", T.StringType()),
        T.StructField("cloud", CLOUD),
        T.StructField("store_error", T.StringType()),
        T.StructField("backup_error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)
_NEEDED = ["route", "match_key", "format", "quality", "target_dir", "target_name", "converted_name", "mimetype", "result_mimetype", "content"]


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch, unless the session sets a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def process(files: DataFrame, fields: Mapping[str, FieldConfig], safe_file: bool, codecs: Mapping[str, Codec], adapters: Mapping[str, Callable[..., Adapter]] | None = None, fall_back_on_write: bool = False) -> DataFrame:
    """Convert and store the rows whose ``route`` asks for it; adds the columns of ``WORK``.

    Needs ``route, match_key, format, quality, target_dir, target_name,
    converted_name, content, mimetype, result_mimetype``.  Where a file could not
    be converted its original is stored, if it has bytes, and an upload that fails
    is tried once more with the same bytes, which may be none; both if ``safe_file``.
    ``fall_back_on_write`` stores the original where a converted file could not
    be written.
    """

    def work(row: dict, made: dict[str, Adapter]) -> dict:
        out = dict.fromkeys(WORK.names)
        to, _, how = row["route"].partition("_")
        content = row["content"]
        backup = content if safe_file and content else None
        data, name, mimetype = content, row["target_name"], row["mimetype"]
        if how == "convert":
            data, out["convert_error"] = (None, "no bytes to convert") if content is None else convert_one(content, row["format"], row["quality"], codecs)
            if out["convert_error"] is None:
                out["n_converted"], name, mimetype = len(data), row["converted_name"], row["result_mimetype"]
                if to == "memory":
                    out["converted"] = data
            else:
                data = backup
        if to == "memory" or data is None:
            return out

        def put(data: bytes, name: str, mimetype: str) -> None:
            if to == "disk":
                out["attempts"] = 1
                out["stored_path"], out["stored_name"] = write_whole(row["target_dir"], name, data), name
                return
            key = row["match_key"]
            if key not in made:
                made[key] = create_adapter(fields[key].cloud_provider, fields[key].cloud_config, adapters=adapters)
            out["attempts"] = 1
            try:
                got = made[key].upload(data, Upload(name, mimetype, len(data)))
            except Exception:
                if not safe_file:
                    raise
                out["attempts"] = 2
                got = made[key].upload(data, Upload(name, mimetype, len(data)))
            out["cloud"] = dict.fromkeys(CLOUD.names) | got

        converted = out["n_converted"] is not None
        try:
            put(data, name, mimetype)
        except Exception as e:
            out["backup_error" if out["convert_error"] else "store_error"] = f"{type(e).__name__}: {e}"
            if converted and fall_back_on_write and backup:
                try:
                    put(backup, row["target_name"], row["mimetype"])
                except Exception as again:
                    out["backup_error"] = f"{type(again).__name__}: {again}"
        return out

    @F.arrow_udf(WORK)
    def worked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, made = to_arrow_type(WORK), {}
        for batch in batches:
            yield pa.array([work(row.as_py(), made) if row.is_valid else None for row in batch], kind)

    bound_batches(files.sparkSession)
    leaves = F.col("route").startswith("disk_") | F.col("route").startswith("cloud_")
    need = F.when(leaves | F.col("route").endswith("_convert"), F.struct(*_NEEDED))
    done = files.withColumn("_need", need).withColumn("_work", worked.asNondeterministic()(F.col("_need"))).drop("_need")
    return done.select("*", *[F.col("_work")[n].alias(n) for n in WORK.names]).drop("_work")


def discard(results: DataFrame, fields: Mapping[str, FieldConfig], adapters: Mapping[str, Callable[..., Adapter]] | None = None) -> DataFrame:
    """Delete what the rows of a written result stored; one row for each object that went.

    For runs that are given up, and for requests that turn out bad later.  An
    object that is not there any more is no error.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Adapter] = {}
        for batch in batches:
            gone = []
            for key, path, public_id in zip(*(c.to_pylist() for c in batch.columns)):
                if path is not None:
                    if delete_file(path):
                        gone.append(path)
                    continue
                if key not in made:
                    made[key] = create_adapter(fields[key].cloud_provider, fields[key].cloud_config, adapters=adapters)
                try:
                    made[key].delete(public_id)
                    gone.append(public_id)
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["deleted"])

    there = results.filter(F.col("path").isNotNull() | F.col("cloudPublicId").isNotNull())
    return there.select("match_key", "path", "cloudPublicId").mapInArrow(of_batches, "deleted string")
