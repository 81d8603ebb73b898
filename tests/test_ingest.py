"""One case for each way a file can end."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from gristmill.config import ConvertOptions, IngestOptions
from gristmill.operators import codecs, grouping, limits
from gristmill.plans.ingest import convert, ingest, ingest_to
from gristmill.schema import FILE
from gristmill.sinks.adapters import EmulatorAdapter

GOOD = {"webp": lambda data, quality: b"webp:" + data, "jpeg": lambda data, quality: b"jpeg"}
BAD = {"webp": codecs.failing("Conversion failed"), "jpeg": codecs.failing("Conversion failed")}


def files(spark, *rows):
    """Rows of (field, name, type, bytes), in order of arrival, of one request."""
    made = [("r", i, f, n, "7bit", m, None, None if b is None else bytearray(b), None if b is None else len(b)) for i, (f, n, m, b) in enumerate(rows)]
    return spark.createDataFrame(made, FILE)


def one(df):
    row = df.collect()[0].asDict(recursive=True)
    errors = {k: v for k, v in (row["_metadata"] or {}).get("errors", {}).items() if v} if row["_metadata"] else None
    flags = tuple(row["_metadata"][k] for k in ("isBackupFallback", "isSkipped", "isProcessed")) if row["_metadata"] else None
    return row, flags, errors


FB, SK = (True, False, True), (False, True, False)
PNG = ("image", "test.jpg", "image/jpeg", b"test image")
PDF = ("image", "doc.pdf", "application/pdf", b"PDF content")


def run(spark, file, field, codecs_=GOOD, safe=False, root="/tmp", **more):
    return one(ingest(files(spark, file), IngestOptions(fields={"image": field}, safe_file=safe, **more), codecs=codecs_, root=str(root)))


def test_memory_passthrough(spark):
    row, flags, _ = run(spark, PDF, {})
    assert (row["buffer"], row["size"], row["mimetype"], row["outcome"], flags) == (b"PDF content", 11, "application/pdf", "stored", None)
    assert row["originalSize"] is row["convertedSize"] is None


def test_memory_converted(spark):
    row, flags, _ = run(spark, PNG, {"format": "webp", "quality": 80})
    assert (row["buffer"], row["size"], row["originalSize"], row["convertedSize"], row["mimetype"], flags) == (b"webp:test image", 15, 10, None, "image/webp", None)


def test_memory_fallback(spark):
    row, flags, errors = run(spark, PNG, {}, BAD, True)
    assert (row["buffer"], row["size"], row["originalSize"], row["mimetype"]) == (b"test image", 10, 10, "image/jpeg")
    assert flags == FB and errors == {"conversion": "Conversion failed"}


@pytest.mark.parametrize("safe, content", [(False, b"test image"), (True, b"")])
def test_memory_lost(spark, safe, content):
    row, flags, errors = run(spark, (*PNG[:3], content), {}, BAD, safe)
    assert flags == SK and errors == {"conversion": "Conversion failed", "message": "Conversion failed"}
    assert row["buffer"] is None and row["size"] is None


def test_disk_passthrough(spark, tmp_path):
    row, flags, _ = run(spark, PDF, {"output": "disk"}, root=tmp_path, output_dir="/up")
    assert flags is None and row["size"] == 11 and row["buffer"] is None
    assert row["path"] == str(tmp_path / "up" / row["filename"]) and open(row["path"], "rb").read() == b"PDF content"


def test_disk_write_error(spark, tmp_path):
    (tmp_path / "up").write_text("in the way")
    row, flags, errors = run(spark, PDF, {"output": "disk"}, safe=True, root=tmp_path, output_dir="up")
    assert flags == SK and set(errors) == {"diskWrite", "message"} and row["path"] is None


def test_disk_converted(spark, tmp_path):
    row, flags, _ = run(spark, PNG, {"output": "disk", "output_dir": "own"}, root=tmp_path)
    assert (row["size"], row["originalSize"], row["convertedSize"], row["mimetype"], flags) == (None, 10, 15, "image/webp", None)
    assert row["filename"].endswith(".webp") and open(row["path"], "rb").read() == b"webp:test image"
    assert [f for f in os.listdir(tmp_path / "own")] == [row["filename"]]


def test_disk_fallback(spark, tmp_path):
    row, flags, errors = run(spark, PNG, {"output": "disk"}, BAD, True, tmp_path)
    assert flags == FB and errors == {"pipeline": "Conversion failed"}
    assert (row["size"], row["originalSize"]) == (10, 10) and row["filename"].endswith(".jpg")
    assert open(row["path"], "rb").read() == b"test image"


def test_disk_fallback_fails(spark, tmp_path):
    (tmp_path / "up").write_text("in the way")
    _, flags, errors = run(spark, PNG, {"output": "disk", "output_dir": "up"}, BAD, True, tmp_path)
    assert flags == SK and set(errors) == {"pipeline", "fallback", "message"}


def test_disk_lost(spark, tmp_path):
    _, flags, errors = run(spark, PNG, {"output": "disk"}, BAD, False, tmp_path)
    assert flags == SK and set(errors) == {"pipeline", "message"} and not any(tmp_path.rglob("*.*"))


def cloud(tmp_path, **more):
    return {"cloud_storage": True, "cloud_provider": "emulator", "cloud_config": {"root": str(tmp_path), **more}}


class Refusing(EmulatorAdapter):
    def upload(self, data, meta):
        raise OSError("no route")


def send(spark, file, tmp_path, codecs_=GOOD, safe=False, adapter=EmulatorAdapter, **more):
    options = IngestOptions(fields={"image": cloud(tmp_path, **more)}, safe_file=safe)
    return one(ingest(files(spark, file), options, codecs=codecs_, adapters={"emulator": adapter}, root=str(tmp_path)))


def test_cloud_converted(spark, tmp_path):
    row, flags, _ = send(spark, PNG, tmp_path)
    assert (row["cloudProvider"], row["cloudSize"], row["originalSize"], row["convertedSize"], row["mimetype"], flags) == ("emulator", 15, 10, 15, "image/webp", None)
    assert row["buffer"] is None and row["cloudUrl"].endswith(".webp")


def test_cloud_fallback(spark, tmp_path):
    row, flags, errors = send(spark, PNG, tmp_path, BAD, True)
    assert flags == FB and errors == {"conversion": "Conversion failed"} and row["cloudSize"] == 10


def test_cloud_fallback_fails(spark, tmp_path):
    row, flags, errors = send(spark, PNG, tmp_path, BAD, True, Refusing)
    assert flags == SK and set(errors) == {"conversion", "cloudUpload", "message"} and row["cloudUrl"] is None


def test_cloud_lost(spark, tmp_path):
    _, flags, errors = send(spark, PNG, tmp_path, BAD)
    assert flags == SK and set(errors) == {"conversion", "message"}


def test_cloud_upload_fails(spark, tmp_path):
    _, flags, errors = send(spark, PNG, tmp_path, adapter=Refusing)
    assert flags == SK and set(errors) == {"cloudUpload", "message"} and "no route" in errors["message"]


def test_cloud_passthrough(spark, tmp_path):
    row, flags, _ = send(spark, PDF, tmp_path)
    assert flags is None and (row["size"], row["cloudSize"], row["cloudContentType"]) == (11, 11, "application/pdf")


def test_cloud_passthrough_fails(spark, tmp_path):
    _, flags, errors = send(spark, PDF, tmp_path, adapter=Refusing)
    assert flags == SK and set(errors) == {"cloudUpload", "message"}


def test_second_try_with_backup_only(spark, tmp_path):
    assert send(spark, PDF, tmp_path, safe=True, fail_first=1)[1] is None
    assert send(spark, PDF, tmp_path, safe=True, fail_first=2)[1] == SK
    assert send(spark, PDF, tmp_path, safe=False, fail_first=1)[1] == SK


@pytest.mark.parametrize("file, size", [((*PDF[:3], b""), 0), ((*PNG[:3], b""), 5)])
def test_second_try_of_a_file_without_bytes(spark, tmp_path, file, size):
    row, flags, _ = send(spark, file, tmp_path, safe=True, fail_first=1)
    assert flags is None and (row["attempts"], row["cloudSize"]) == (2, size)
    assert send(spark, file, tmp_path, safe=True, fail_first=2)[1] == SK


def test_unsupported_format(spark):
    row, flags, errors = run(spark, ("image", "a.bmp", "image/bmp", b"BM"), {})
    assert flags == SK and row["outcome"] == "skipped" and "image/bmp" in row["error"] and set(errors) == {"message"}
    assert run(spark, ("image", "a.bmp", "image/bmp", b"BM"), {"keep_original": True})[0]["outcome"] == "stored"


def test_unknown_format_fails_the_run(spark):
    with pytest.raises(codecs.UnknownFormat):
        ingest(files(spark, PNG), IngestOptions(fields={"image": {"format": "xyz"}}))


def test_missing_codec_is_said(spark):
    _, flags, errors = run(spark, PNG, {}, None)
    assert flags == SK and "no codec for webp" in errors["conversion"]


def test_other_errors_fail_the_run(spark):
    def crash(data, quality):
        raise RuntimeError("out of the blue")

    with pytest.raises(Exception, match="out of the blue"):
        run(spark, PNG, {}, {"webp": crash})


def test_unmatched_fields_are_dropped(spark):
    df = files(spark, PNG, ("other", "a.txt", "text/plain", b"x"))
    assert ingest(df, IngestOptions(fields={"im*": {}}), codecs=GOOD).count() == 1


def test_multi_field(spark):
    df = files(spark, ("avatar", "a.png", "image/png", b"avatar image"), ("cover", "c.png", "image/png", b"cover image"))
    done = ingest(df, IngestOptions(fields={"avatar": {"format": "webp", "quality": 90}, "cover": {"format": "jpeg", "quality": 85}}), codecs=GOOD)
    assert {(r.fieldname, r.mimetype) for r in done.collect()} == {("avatar", "image/webp"), ("cover", "image/jpeg")}
    grouped = grouping.as_map(done, ["originalname"]).collect()[0].files
    assert {k: [f.originalname for f in v] for k, v in grouped.items()} == {"avatar": ["a.png"], "cover": ["c.png"]}


def test_limit_rejects_the_request(spark):
    df = files(spark, PNG, ("image", "big.jpg", "image/jpeg", b"x" * 26)).unionByName(files(spark, PNG).withColumn("request_id", F.lit("other")))
    rows = ingest(df, IngestOptions(fields={"image": {}}, limit=10), codecs=GOOD).collect()
    assert sorted((r.request_id, r.outcome, r.buffer is None) for r in rows) == [("other", "converted", False), ("r", "rejected", True), ("r", "rejected", True)]
    assert all("26 bytes" in r.error and r["_metadata"].isSkipped for r in rows if r.request_id == "r")
    assert [tuple(r) for r in limits.rejected_requests(df, 10).collect()] == [("r", 26)]


def test_limit_ignores_files_that_are_not_allowed(spark):
    df = files(spark, PNG, ("else", "big.jpg", "image/jpeg", b"x" * 26))
    assert ingest(df, IngestOptions(fields={"image": {}}, limit=10), codecs=GOOD).count() == 1


def test_no_rows(spark):
    assert ingest(files(spark), IngestOptions(fields={"*": {"output": "disk"}}), codecs=GOOD, root="/tmp").count() == 0


def test_disk_needs_a_root(spark):
    with pytest.raises(ValueError, match="root"):
        ingest(files(spark, PNG), IngestOptions(fields={"*": {"output": "disk"}}), codecs=GOOD)


def test_retry_sends_what_was_converted(spark, tmp_path):
    """The second upload of a converted file holds the converted bytes, under their name and type."""
    cloud = {"cloud_storage": True, "cloud_provider": "emulator", "cloud_config": {"root": str(tmp_path), "fail_first": 1}, "format": "png"}
    row = ingest(files(spark, PNG), IngestOptions(fields={"image": cloud}, safe_file=True), codecs={"png": lambda data, quality: b"NEW:" + data}).first()
    stored = (tmp_path / "bucket" / row.cloudPublicId).read_bytes()
    assert stored.startswith(b"NEW:") and row.outcome == "converted" and row.attempts == 2
    assert (row.cloudSize, row.convertedSize, row.cloudContentType) == (len(stored), len(stored), "image/png") and row.cloudPublicId.endswith(".png")


def test_an_image_is_converted_once(spark, tmp_path):
    """One scan of the files and one codec call an image, whatever the routes are."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(data, quality):
        (calls / uuid.uuid4().hex).write_bytes(data)
        return data

    spark.createDataFrame([(str(i), i, f"f{i % 3}", "a.png", "binary", "image/png", None, bytes([i]) * 9, 9) for i in range(12)], FILE).write.parquet(f"{tmp_path}/files")
    cloud = {"cloud_storage": True, "cloud_provider": "emulator", "cloud_config": {"root": str(tmp_path / "o")}}
    options = IngestOptions(fields={"f0": {"format": "png"}, "f1": {"output": "disk", "format": "png"}, "f2": cloud | {"format": "png"}})
    result = ingest_to(spark.read.parquet(f"{tmp_path}/files"), options, f"{tmp_path}/out", codecs={"png": counted}, root=str(tmp_path / "d"))
    assert result.count() == 12 and len(list(calls.iterdir())) == 12
    plan = ingest(spark.read.parquet(f"{tmp_path}/files"), options, codecs={"png": counted}, root=str(tmp_path / "d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


# conversion alone


def turn(spark, file, field=None, codecs_=GOOD, safe=False, root="/tmp", **more):
    return one(convert(files(spark, file), ConvertOptions(fields={"image": field or {}}, safe_file=safe, **more), codecs=codecs_, root=str(root)))


def test_convert_memory(spark):
    row, flags, _ = turn(spark, PNG)
    assert (row["buffer"], row["size"], row["convertedSize"], row["originalSize"], row["mimetype"], flags) == (b"webp:test image", 15, 15, 10, "image/webp", None)


def test_convert_memory_fallback(spark):
    row, flags, errors = turn(spark, PNG, None, BAD, True)
    assert (row["buffer"], row["size"], row["convertedSize"], row["originalSize"], flags) == (b"test image", 10, 10, 10, FB)
    assert errors == {"conversion": "Conversion failed"}


def test_convert_memory_unchanged(spark):
    row, flags, _ = turn(spark, PNG, None, BAD)
    assert (row["buffer"], row["size"], row["convertedSize"], row["mimetype"], row["outcome"], flags) == (b"test image", 10, None, "image/jpeg", "unchanged", None)


def test_convert_disk(spark, tmp_path):
    row, flags, _ = turn(spark, PNG, {"output": "disk"}, root=tmp_path)
    assert (row["size"], row["convertedSize"], row["originalSize"], row["buffer"], flags) == (15, 15, 10, None, None)
    assert open(row["path"], "rb").read() == b"webp:test image"


def test_convert_disk_fallback(spark, tmp_path):
    row, flags, errors = turn(spark, PNG, {"output": "disk"}, BAD, True, tmp_path)
    assert flags == FB and set(errors) == {"conversion"} and open(row["path"], "rb").read() == b"test image"


def test_convert_disk_write_error(spark, tmp_path):
    (tmp_path / "up").write_text("in the way")
    row, flags, _ = turn(spark, PNG, {"output": "disk", "output_dir": "up"}, root=tmp_path)
    assert (row["outcome"], row["buffer"], row["path"], flags) == ("unchanged", b"test image", None, None)


def test_convert_disk_write_fallback(spark, tmp_path, monkeypatch):
    # The converted name is taken by a folder, the original's is not.
    first = turn(spark, PNG, {"output": "disk"}, root=tmp_path)[0]
    os.unlink(first["path"])
    os.makedirs(first["path"])
    row, flags, errors = turn(spark, PNG, {"output": "disk"}, safe=True, root=tmp_path)
    assert flags == FB and set(errors) == {"diskWrite"} and row["filename"].endswith(".jpg")
    assert open(row["path"], "rb").read() == b"test image"


@pytest.mark.parametrize("file, field", [(PDF, {"output": "disk"}), (PNG, {"keep_original": True, "output": "disk"}), ((*PNG[:3], None), None)])
def test_convert_leaves_the_rest(spark, file, field):
    row, flags, _ = turn(spark, file, field)
    assert (row["outcome"], row["buffer"], row["path"], flags) == ("unchanged", file[3], None, None)


def test_convert_uses_exact_keys_and_defaults(spark):
    df = files(spark, ("images1", "a.png", "image/png", b"1"), ("images2", "b.png", "image/png", b"2"))
    done = convert(df, ConvertOptions(fields={"images*": {"format": "jpeg"}}), codecs=GOOD)
    assert [r.mimetype for r in done.collect()] == ["image/webp"] * 2
    done = convert(df, ConvertOptions(fields={"images*": {"format": "jpeg"}}), codecs=GOOD, wildcards=True)
    assert [r.mimetype for r in done.collect()] == ["image/jpeg"] * 2


def test_convert_ignores_cloud_settings(spark, tmp_path):
    assert turn(spark, PNG, cloud(tmp_path))[0]["outcome"] == "converted"
