"""Options of a run, checked when they are made.

Three kinds of mistakes raise three kinds of errors: a wrong type raises
TypeError, a value out of range raises ValueError, and settings that do not go
together raise ConfigError.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

#: Byte limits, default output, and what each provider needs.
DEFAULT_LIMIT = 10 * 1024 * 1024
SPILL_THRESHOLD = 7 * 1024 * 1024
DEFAULT_FORMAT = "webp"
DEFAULT_QUALITY = 80
DEFAULT_DIR = "./uploads"
OUTPUTS = ("disk", "memory")
PROVIDERS = {"cloudinary": "cloudinary", "s3": "s3", "aws": "s3", "gcs": "gcs", "google": "gcs", "emulator": "emulator"}
REQUIRED = {
    "cloudinary": (("cloud_name",), ("api_key",), ("api_secret",)),
    "s3": (("region",), ("bucket",), ("accessKeyId",), ("secretAccessKey",)),
    "gcs": (("bucket",), ("keyFilename", "credentials")),
    "emulator": (("root",),),
}


class ConfigError(Exception):
    """Settings that do not go together."""


def provider_name(name: str) -> str:
    """The provider that a name or an alias stands for, in any case."""
    if not isinstance(name, str) or not name:
        raise TypeError("cloud storage needs a provider: cloudinary, s3 or gcs")
    if name.lower() not in PROVIDERS:
        raise ConfigError(f"unsupported cloud provider {name!r}; known are cloudinary, s3 and gcs")
    return PROVIDERS[name.lower()]


def check_cloud(provider: str, config: Mapping[str, Any] | None) -> str:
    """The provider's name, if its settings are whole."""
    name = provider_name(provider)
    if not isinstance(config, Mapping):
        raise TypeError(f"{name} needs a mapping of settings")
    missing = [" or ".join(any_of) for any_of in REQUIRED[name] if not any(config.get(k) for k in any_of)]
    if missing:
        raise ConfigError(f"{name} lacks {', '.join(missing)}")
    return name


def _of_type(name: str, value: Any, kind: type) -> None:
    if value is not None and not isinstance(value, kind):
        raise TypeError(f"{name} must be {kind.__name__}, not {type(value).__name__}")


@dataclass(frozen=True)
class FieldConfig:
    """What happens to the files of one field.

    Settings left out, empty or zero take their defaults; see ``filled``.
    """

    output: str | None = None
    output_dir: str | None = None
    format: str | None = None
    quality: float | None = None
    keep_original: bool | None = None
    cloud_storage: bool = False
    cloud_provider: str | None = None
    cloud_config: Mapping[str, Any] | None = field(default=None, repr=False)
    #: Cloud storage must then be given its output in so many words.
    strict: bool = False

    def __post_init__(self) -> None:
        if self.cloud_storage and (self.output == "disk" or self.strict and self.output != "memory"):
            raise ConfigError("cloud storage works on files in memory: output must be 'memory'")
        if self.output is not None and self.output not in OUTPUTS:
            raise ValueError(f"output must be one of {OUTPUTS}")
        _of_type("output_dir", self.output_dir, str)
        q = self.quality
        if q is not None:
            if isinstance(q, bool) or not isinstance(q, (int, float)):
                raise ValueError("quality must be a number")
            if not math.isnan(q) and not 1 <= q <= 100:
                raise ValueError("quality must be from 1 to 100")
        _of_type("format", self.format, str)
        _of_type("keep_original", self.keep_original, bool)
        if self.cloud_storage:
            check_cloud(self.cloud_provider, self.cloud_config)

    def filled(self) -> FieldConfig:
        """The same with all defaults in place."""
        quality = self.quality
        if not quality or math.isnan(quality):
            quality = DEFAULT_QUALITY
        return replace(self, output=self.output or "memory", format=self.format or DEFAULT_FORMAT, quality=quality, keep_original=bool(self.keep_original))


@dataclass(frozen=True)
class _Options:
    fields: Mapping[str, FieldConfig | Mapping[str, Any]]
    output_dir: str = DEFAULT_DIR
    safe_file: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.fields, Mapping):
            raise TypeError("fields must be a mapping of field names")
        known = {f.name for f in fields(FieldConfig)}
        made = {}
        for name, config in self.fields.items():
            if isinstance(config, FieldConfig):
                made[name] = config
            elif isinstance(config, Mapping):
                if extra := set(config) - known:
                    raise TypeError(f"field {name!r} has unknown settings {sorted(extra)}")
                made[name] = FieldConfig(**config)
            else:
                raise TypeError(f"the settings of field {name!r} must be a mapping")
        object.__setattr__(self, "fields", made)
        if not isinstance(self.output_dir, str):
            raise TypeError("output_dir must be str")
        if not isinstance(self.safe_file, bool):
            raise TypeError("safe_file must be bool")


@dataclass(frozen=True)
class IngestOptions(_Options):
    """Options of :func:`gristmill.plans.ingest.ingest`."""

    limit: float = DEFAULT_LIMIT
    spill_threshold: int = SPILL_THRESHOLD

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.limit, bool) or not isinstance(self.limit, (int, float)) or not self.limit > 0:
            raise TypeError("limit must be a positive number of bytes")

    def cloud_fields(self) -> dict[str, FieldConfig]:
        """The fields that go to cloud storage."""
        return {k: v for k, v in self.fields.items() if v.cloud_storage}


@dataclass(frozen=True)
class ConvertOptions(_Options):
    """Options of :func:`gristmill.plans.ingest.convert`; cloud settings play no part."""
