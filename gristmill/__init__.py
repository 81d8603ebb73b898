"""File ingest and data preparation on Spark DataFrames.

The names below are looked up when they are used, so that Python workers, which
need single modules only, start quickly.
"""

from importlib import import_module

_NAMES = {
    "ConfigError": "config",
    "ConvertOptions": "config",
    "FieldConfig": "config",
    "IngestOptions": "config",
    "check_cloud": "config",
    "Adapter": "sinks.adapters",
    "CloudinaryAdapter": "sinks.adapters",
    "EmulatorAdapter": "sinks.adapters",
    "GCSAdapter": "sinks.adapters",
    "S3Adapter": "sinks.adapters",
    "create_adapter": "sinks.adapters",
    "preflight": "sinks.adapters",
    "upload_with_retry": "sinks.adapters",
    "convert": "plans.ingest",
    "ingest": "plans.ingest",
    "ingest_to": "plans.ingest",
    "discard": "sinks.store",
    "sweep": "sinks.adapters",
    "ingest_stream": "streaming.landing",
    "stream_landing": "streaming.landing",
    "read_landing": "sources.files",
    "from_buffers": "sources.files",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_NAMES[name]}"), name)
