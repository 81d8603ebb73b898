"""Codecs, adapters, sources and the landing stream."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.config import ConfigError, FieldConfig, IngestOptions
from gristmill.operators import codecs
from gristmill.sinks import adapters
from gristmill.sources.files import from_buffers, read_landing
from gristmill.streaming.landing import ingest_stream, stream_landing

PIXELS = st.tuples(st.integers(1, 6), st.integers(1, 6), st.integers(1, 4), st.integers(0, 2**32 - 1))


def test_a_second_decoder_reads_what_is_written(spark, tmp_path):
    """The JVM's own decoders, behind Spark's image source, see the same pixels."""
    rng = np.random.default_rng(3)
    smooth = np.stack(np.meshgrid(np.arange(37) * 6, np.arange(45) * 5), 2).astype(np.uint8)
    colour = np.concatenate([smooth, smooth[:, :, :1] // 2 + 20], 2)
    cases = {"a.jpg": (codecs.BUILT_IN["jpeg"](codecs.encode_png(colour), 100), colour, 4), "b.jpg": (codecs.BUILT_IN["jpeg"](codecs.encode_png(colour[:, :, :1]), 95), colour[:, :, :1], 5)}
    few = rng.integers(0, 4, (20, 31, 3)).astype(np.uint8) * 60
    cases |= {"c.gif": (codecs.BUILT_IN["gif"](codecs.encode_png(few), 80), few, 0), "d.png": (codecs.encode_png(colour), colour, 0)}
    for name, (data, _, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == len(cases)
    for r in rows:
        data, pixels, off = cases[r.origin.rsplit("/", 1)[1]]
        seen = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, ::-1].astype(int)
        own = codecs.decode(data).astype(int)
        assert seen.shape[:2] == pixels.shape[:2]
        assert np.abs(seen[:, :, -3:] - np.broadcast_to(pixels, (*pixels.shape[:2], 3))).max() <= off
        assert np.abs(seen[:, :, -3:] - np.broadcast_to(own, (*own.shape[:2], 3))).max() <= 2


def test_other_kinds_of_png():
    """Sixteen bits, one bit, a palette of four, and interlacing, each written out by hand."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(w, h, bits, colour, raw, interlaced=0, more=b""):
        return codecs.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    assert codecs.decode(png(2, 1, 16, 0, b"\0\x12\x34\xab\xcd")).ravel().tolist() == [0x12, 0xAB]
    assert codecs.decode(png(10, 1, 1, 0, b"\0\xa0\x40")).ravel().tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 0, 255]
    palette = chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\x07")
    assert codecs.decode(png(3, 1, 2, 3, b"\0\x18", more=palette)).tolist() == [[[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255]]]
    pixels = np.arange(9 * 10, dtype=np.uint8).reshape(9, 10)
    raw = b""
    for x, y, dx, dy in [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]:
        raw += b"".join(b"\0" + row.tobytes() for row in pixels[y::dy, x::dx])
    assert (codecs.decode(png(10, 9, 8, 0, raw, 1))[:, :, 0] == pixels).all()


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=60), st.sampled_from(["jpeg", "gif"]), st.integers(0, 400))
def test_damaged_images_fail_alone(junk, kind, at):
    data = codecs.BUILT_IN[kind](codecs.encode_png(np.arange(300, dtype=np.uint8).reshape(10, 10, 3)), 80)
    for bad in (data[:at], data[:at] + junk + data[at + len(junk) :], data[:4] + junk):
        out, error = codecs.convert_one(bad, "png", 80, codecs.BUILT_IN)
        assert (out is None) != (error is None)


@settings(max_examples=30, deadline=None)
@given(PIXELS)
def test_pixels_round_trip(shape):
    h, w, c, seed = shape
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w, c), np.uint8)
    png, tiff = codecs.encode_png(pixels), codecs.encode_tiff(pixels)
    assert (codecs.decode(png) == pixels).all() and (codecs.decode(tiff) == pixels).all()
    assert (codecs.decode(codecs.BUILT_IN["tiff"](png, 80)) == pixels).all()
    assert (codecs.decode(codecs.BUILT_IN["png"](tiff, 1)) == pixels).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct
    import zlib

    pixels = np.random.default_rng(kind).integers(0, 256, (5, 4, 3), np.uint8)
    flat = pixels.reshape(5, 12).astype(int)
    left = np.hstack([np.zeros((5, 3), int), flat[:, :-3]])
    up = np.vstack([np.zeros((1, 12), int), flat[:-1]])
    corner = np.hstack([np.zeros((5, 3), int), up[:, :-3]])
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    lines = (flat - [0 * left, left, up, (left + up) // 2, paeth][kind]) % 256
    raw = b"".join(bytes([kind]) + bytes(x.tolist()) for x in lines)

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    png = codecs.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (codecs.decode(png) == pixels).all()


@pytest.mark.parametrize("data", [b"", b"GIF89a", codecs.PNG_MARK, codecs.PNG_MARK + b"\0\0\0\rIHDR", b"II*\0", b"II*\0\xff\xff\xff\x7f"])
def test_what_is_not_an_image(data):
    with pytest.raises(codecs.UnsupportedImage):
        codecs.decode(data)


class Client:
    """Notes every call and answers as the real ones do."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*args, **options):
            self.calls.append((name, args, options))
            if name in ("bucket", "blob"):
                return self
            return {"ETag": "e1", "secure_url": "https://c/x", "public_id": "x", "bytes": 3, "format": "png", "width": 1, "height": 2}

        return call


def test_s3_contract():
    client = Client()
    it = adapters.create_adapter("AWS", {"bucket": "b", "region": "r", "uploadParams": {"StorageClass": "GLACIER"}}, client)
    got = it.upload(b"abc", adapters.Upload("k.png", "image/png", 3))
    assert got["cloudUrl"] == "https://b.s3.r.amazonaws.com/k.png" and got["cloudETag"] == "e1" and got["cloudSize"] == 3
    assert client.calls[0][2]["StorageClass"] == "GLACIER" and "ACL" not in client.calls[0][2]
    it.delete("k.png")
    it.validate_connection()
    assert [c[0] for c in client.calls] == ["put_object", "delete_object", "head_bucket"]


@pytest.mark.parametrize("public", [False, True])
def test_gcs_is_private_unless_asked(public):
    client = Client()
    it = adapters.create_adapter("google", {"bucket": "b", "public": public, "customDomain": "https://d"}, client)
    assert it.upload(b"abc", adapters.Upload("k", "text/plain", 3))["cloudUrl"] == "https://d/k"
    assert ("make_public" in [c[0] for c in client.calls]) == public


def test_cloudinary_contract():
    client = Client()
    it = adapters.create_adapter("cloudinary", {"folder": "f"}, client)
    assert it.upload(b"abc", adapters.Upload("a.pdf", "application/pdf", 3))["cloudPublicId"] == "x"
    assert client.calls[-1][2]["public_id"] == "a.pdf" and client.calls[-1][2]["secure"] is True
    it.upload(b"abc", adapters.Upload("a.png", "image/png", 3))
    assert "public_id" not in client.calls[-1][2] and client.calls[-1][2]["resource_type"] == "image"
    kinds = [it.resource_type(adapters.Upload(*x)) for x in (("a.MP4",), ("a.zip",), ("a", "video/x"), ("a", "text/x"))]
    assert kinds == ["auto", "raw", "video", "raw"]


def test_unknown_provider_and_missing_client():
    with pytest.raises(ConfigError):
        adapters.create_adapter("ftp", {})
    with pytest.raises(RuntimeError, match="client_factory"):
        adapters.create_adapter("s3", {"bucket": "b"}).validate_connection()


def test_retry_uses_the_backup(tmp_path):
    it = adapters.EmulatorAdapter({"root": str(tmp_path), "fail_first": 1})
    assert adapters.upload_with_retry(it, b"new", adapters.Upload("k"), b"old!")["cloudSize"] == 4
    with pytest.raises(OSError):
        adapters.upload_with_retry(it, b"new", adapters.Upload("other"))
    it.delete("k")
    assert not adapters.delete_file(str(tmp_path / "bucket" / "k"))


def test_preflight_reports_and_does_not_raise(tmp_path):
    good = FieldConfig(cloud_storage=True, cloud_provider="emulator", cloud_config={"root": str(tmp_path)})
    bad = FieldConfig(cloud_storage=True, cloud_provider="s3", cloud_config={"region": "r", "bucket": "b", "accessKeyId": "a", "secretAccessKey": "s"})
    found = adapters.preflight({"a": good, "b": bad, "c": FieldConfig()})
    assert found["a"] is None and "client" in found["b"] and "c" not in found
    with pytest.raises(RuntimeError):
        adapters.preflight({"b": bad}, strict=True)


def test_buffers_as_array_and_as_map(spark):
    rows = spark.sql("SELECT 'r' AS request_id, array(named_struct('fieldname','f','originalname','a.png','mimetype','image/png','content',cast('xyz' AS binary))) AS files")
    got = from_buffers(rows).collect()[0]
    assert (got.request_id, got.fieldname, got.size, got.arrival_idx, got.path) == ("r", "f", 3, 0, None)
    mapped = rows.select("request_id", F.create_map(F.lit("g"), "files").alias("files"))
    assert from_buffers(mapped).collect()[0].fieldname == "g"


def test_landing_folder_and_stream(spark, tmp_path):
    for request, field, name, data in (("r1", "a", "x.png", b"12345"), ("r1", "b", "y.txt", b"1"), ("r2", "a", "z.txt", b"0")):
        (tmp_path / "in" / request / field).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / request / field / name).write_bytes(data)
    found = {(r.request_id, r.fieldname, r.originalname, r.mimetype, r.size) for r in read_landing(spark, f"file://{tmp_path}/in").collect()}
    assert found == {("r1", "a", "x.png", "image/png", 5), ("r1", "b", "y.txt", "text/plain", 1), ("r2", "a", "z.txt", "text/plain", 1)}
    options = IngestOptions(fields={"a": {"format": "png"}})

    def run():
        query = ingest_stream(stream_landing(spark, f"file://{tmp_path}/in"), options, f"file://{tmp_path}/out", f"file://{tmp_path}/at", codecs={"png": codecs.identity})
        query.awaitTermination()
        return sorted((r.originalname, r.outcome) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out").collect())

    assert run() == [("x.png", "converted"), ("z.txt", "stored")]
    assert run() == [("x.png", "converted"), ("z.txt", "stored")]
    (tmp_path / "in" / "r3" / "a").mkdir(parents=True)
    (tmp_path / "in" / "r3" / "a" / "new.txt").write_bytes(b"1")
    assert run() == [("new.txt", "stored"), ("x.png", "converted"), ("z.txt", "stored")]


def test_landing_reads_no_bytes_it_does_not_need(spark, tmp_path):
    (tmp_path / "r" / "f").mkdir(parents=True)
    (tmp_path / "r" / "f" / "x").write_bytes(b"1")
    plan = read_landing(spark, f"file://{tmp_path}").filter("size <= 10").select("fieldname", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "LessThanOrEqual(length,10)" in plan
