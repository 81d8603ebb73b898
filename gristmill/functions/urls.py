"""Public URLs and resource types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are not raw files where the MIME type is unknown.
MEDIA = ("jpg", "jpeg", "png", "gif", "webp", "svg", "mp4", "mov", "avi")


def _url(domain: Column, default: Column, key: Column) -> Column:
    return F.concat(F.when(F.coalesce(domain, F.lit("")) != "", domain).otherwise(default), F.lit("/"), key)


def s3_url(bucket: Column, region: Column, key: Column, domain: Column | None = None) -> Column:
    """By the custom domain, which brings its own scheme, or by bucket and region."""
    own = F.concat(F.lit("https://"), bucket, F.lit(".s3."), region, F.lit(".amazonaws.com"))
    return _url(F.lit(None).cast("string") if domain is None else domain, own, key)


def gcs_url(bucket: Column, key: Column, domain: Column | None = None) -> Column:
    own = F.concat(F.lit("https://storage.googleapis.com/"), bucket)
    return _url(F.lit(None).cast("string") if domain is None else domain, own, key)


def resource_type(mimetype: Column, name: Column) -> Column:
    """image, video or raw by MIME type; raw or auto by extension without one."""
    mime = F.lower(mimetype)
    ext = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1))
    by_name = F.when((ext != "") & ~ext.isin(*MEDIA), F.lit("raw")).otherwise(F.lit("auto"))
    by_mime = F.when(mime.startswith("image/"), F.lit("image")).when(mime.startswith("video/"), F.lit("video")).otherwise(F.lit("raw"))
    return F.when(F.coalesce(mimetype, F.lit("")) == "", by_name).otherwise(by_mime)
