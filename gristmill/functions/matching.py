"""Rules that match fields, and predicates on files, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME types that can be converted.
CONVERTIBLE = (
    "image/jpeg",
    "image/jpg",
    "image/png",
    "image/webp",
    "image/gif",
    "image/avif",
    "image/tiff",
    "image/svg+xml",
    "image/heif",
    "image/heic",
)


def is_wildcard(key: str) -> bool:
    return "*" in key


def matches(name: Column, key: str) -> Column:
    """Whether a field name matches a key; ``*`` stands for any run of characters.

    A key without line breaks matches no name with one, as ``*`` does not stand
    for them.  LIKE is kept where it means the same, as it reaches the scan.
    """
    if not is_wildcard(key):
        return F.coalesce(name == F.lit(key), F.lit(False))
    pattern = r"\A" + r"[^\n\r\u2028\u2029]*".join(re.escape(p) for p in key.split("*")) + r"\z"
    like = re.sub(r"([%_\\])", r"\\\1", key).replace("*", "%")
    return F.coalesce(name.like(like) & name.rlike(pattern), F.lit(False))


def in_order(keys: Iterable[str]) -> list[str]:
    """Keys as they are tried: exact ones first, then wildcards as they stand."""
    keys = list(keys)
    return [k for k in keys if not is_wildcard(k)] + [k for k in keys if is_wildcard(k)]


def match_key(name: Column, keys: Sequence[str], wildcards: bool = True) -> Column:
    """The first key that matches; null if none does.

    With ``wildcards`` off every key is a plain name.
    """
    found = F.lit(None).cast("string")
    for key in reversed(in_order(keys) if wildcards else list(keys)):
        hit = matches(name, key) if wildcards else F.coalesce(name == F.lit(key), F.lit(False))
        found = F.when(hit, F.lit(key)).otherwise(found)
    return found


def allowed(name: Column, keys: Sequence[str]) -> Column:
    """Whether any key matches."""
    return match_key(name, keys).isNotNull()


def setting(key: Column, values: dict[str, object], default: object, kind: str) -> Column:
    """The value for a matched key, or the default, as type ``kind``."""
    out = F.lit(default).cast(kind)
    for k, v in values.items():
        out = F.when(key == F.lit(k), F.lit(v).cast(kind)).otherwise(out)
    return out


def is_image(mimetype: Column) -> Column:
    """Starts with ``image``, in that case; no slash is asked for."""
    return F.coalesce(mimetype.startswith("image"), F.lit(False))


def is_convertible(mimetype: Column) -> Column:
    return F.coalesce(mimetype.isin(*CONVERTIBLE), F.lit(False))


def should_convert(mimetype: Column, keep_original: Column) -> Column:
    return is_image(mimetype) & ~keep_original


def is_unsupported(mimetype: Column, keep_original: Column) -> Column:
    """An image to be converted, in a format that cannot be."""
    return should_convert(mimetype, keep_original) & ~is_convertible(mimetype)


def route(mimetype: Column, keep_original: Column, cloud: Column, output: Column) -> Column:
    """Where a file goes, and whether converted: cloud before disk before memory."""
    to = F.when(cloud, F.lit("cloud")).when(output == "disk", F.lit("disk")).otherwise(F.lit("memory"))
    how = F.when(should_convert(mimetype, keep_original), F.lit("convert")).otherwise(F.lit("passthrough"))
    return F.when(is_unsupported(mimetype, keep_original), F.lit("skipped")).otherwise(F.concat_ws("_", to, how))


def backup_tier(size: Column, threshold: int) -> Column:
    """Whether a backup of so many bytes is too large for memory."""
    return F.when(size > threshold, F.lit("disk")).otherwise(F.lit("memory"))
