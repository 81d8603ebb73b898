import math

import pytest

from gristmill.config import ConfigError, ConvertOptions, FieldConfig, IngestOptions, check_cloud

S3 = {"region": "r", "bucket": "b", "accessKeyId": "a", "secretAccessKey": "s"}


@pytest.mark.parametrize("fields", [None, [], "x", {"a": 1}, {"a": None}, {"a": {"nope": 1}}])
def test_fields_are_mappings(fields):
    for kind in (IngestOptions, ConvertOptions):
        with pytest.raises(TypeError):
            kind(fields=fields)


@pytest.mark.parametrize(
    "bad, error",
    [
        ({"output": "tape"}, ValueError),
        ({"output_dir": 3}, TypeError),
        ({"quality": 0}, ValueError),
        ({"quality": 100.5}, ValueError),
        ({"quality": "80"}, ValueError),
        ({"quality": True}, ValueError),
        ({"format": 1}, TypeError),
        ({"keep_original": "yes"}, TypeError),
        ({"cloud_storage": True}, TypeError),
        ({"cloud_storage": True, "cloud_provider": "ftp", "cloud_config": {}}, ConfigError),
        ({"cloud_storage": True, "cloud_provider": "s3", "cloud_config": None}, TypeError),
        ({"cloud_storage": True, "cloud_provider": "s3", "cloud_config": {}}, ConfigError),
        ({"cloud_storage": True, "cloud_provider": "s3", "cloud_config": S3, "output": "disk"}, ConfigError),
        ({"cloud_storage": True, "cloud_provider": "s3", "cloud_config": S3, "strict": True}, ConfigError),
    ],
)
def test_field_rules(bad, error):
    with pytest.raises(error):
        IngestOptions(fields={"a": bad})


def test_what_is_allowed():
    IngestOptions(fields={"a": {"quality": 1.5, "format": "anything"}, "b": {"cloud_storage": True, "cloud_provider": "AWS", "cloud_config": S3}})
    FieldConfig(quality=math.nan)


@pytest.mark.parametrize("bad", [{"output_dir": 1}, {"safe_file": 1}, {"limit": 0}, {"limit": "1"}, {"limit": True}])
def test_run_rules(bad):
    with pytest.raises(TypeError):
        IngestOptions(fields={}, **bad)


def test_defaults():
    filled = FieldConfig(format="").filled()
    assert (filled.output, filled.format, filled.quality, filled.keep_original) == ("memory", "webp", 80, False)
    assert IngestOptions(fields={}).limit == 10 * 1024 * 1024 and IngestOptions(fields={}).spill_threshold == 7 * 1024 * 1024


@pytest.mark.parametrize("name, config, provider", [("aws", S3, "s3"), ("Google", {"bucket": "b", "credentials": {"x": 1}}, "gcs"), ("cloudinary", {"cloud_name": "c", "api_key": "k", "api_secret": "s"}, "cloudinary")])
def test_aliases(name, config, provider):
    assert check_cloud(name, config) == provider
    with pytest.raises(ConfigError, match="lacks"):
        check_cloud(name, {"bucket": "b"} if provider != "s3" else {})


def test_secrets_are_not_shown():
    assert "secretAccessKey" not in repr(FieldConfig(cloud_storage=True, cloud_provider="s3", cloud_config=S3))
