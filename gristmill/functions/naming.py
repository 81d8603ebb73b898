"""File names and folders, as column expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import is_image

#: Used where a file has no name.
NAMELESS = "file"


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one inner hyphen."""
    # The line break and tab are trimmed too; as they would become edge hyphens, that is the same.
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_name(path: Column) -> Column:
    """The last segment of a path, without slashes at its end."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """The last dot of the last segment and what follows.

    Empty without a dot, for a leading dot only, and for ``..``.
    """
    base = base_name(path)
    return F.when(base == "..", F.lit("")).otherwise(F.regexp_extract(base, r"(?s)^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The last segment without its extension."""
    base = base_name(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


def generated_name(original: Column, field: Column, mimetype: Column, unique: Column, digits: int = 4) -> Column:
    """``field-slug-hash.ext``: the field for images only, the extension if any.

    The hash is of ``unique``, so a task that runs again gives the same name.
    The field is made a slug as well, so that it cannot name another folder.
    """
    name = F.when(F.coalesce(original, F.lit("")) == "", F.lit(NAMELESS)).otherwise(original)
    ext = F.lower(F.regexp_replace(extension(name), r"^\.", ""))
    lead = F.when(is_image(mimetype), F.nullif(slugify(field), F.lit("")))
    mark = F.substring(F.md5(unique.cast("string")), 1, digits)
    return F.concat_ws(".", F.concat_ws("-", lead, F.nullif(slugify(stem(name)), F.lit("")), mark), F.nullif(ext, F.lit("")))


def converted_name(name: Column, fmt: Column) -> Column:
    """The same name with the output format as its extension."""
    return F.concat(stem(name), F.lit("."), F.lower(fmt))


def output_mimetype(fmt: Column) -> Column:
    return F.concat(F.lit("image/"), F.lower(fmt))


def resolve_dir(path: str, root: str | None = None) -> str:
    """An output folder under ``root``, a folder that all executors share.

    Leading slashes count for nothing, a drive path stands as it is, and a path
    that leaves the root is refused.
    """
    if not isinstance(path, str) or not path.strip():
        raise TypeError("an output folder must be a path that is not empty")
    path = path.strip()
    if re.match(r"[A-Za-z]:[\\/]", path):
        return path
    if not root:
        raise ValueError("files that go to disk need a root folder, which all executors share")
    inner = posixpath.normpath(path.lstrip("/\\").replace("\\", "/") or ".")
    if inner == ".." or inner.startswith("../"):
        raise ValueError(f"{path!r} leaves the output root")
    return root if inner == "." else posixpath.join(root, inner)
