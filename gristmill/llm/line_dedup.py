"""Removal of repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed (to 128 bits).  Of each hash the
occurrence that comes first, by id, then text hash, then line, stays; every
later one covers its lines, and a document loses all covered lines.  Windows
overlap, so a passage of any length above two lines is covered whole.

The counts are summed before the shuffle, and hashes that hold a large share of
all windows meet the windows through a broadcast (there can be few of them), so
a passage that a third of all documents share does not gather in one task.

Defined results: a null text stays null; a text of fewer than three lines has
no window and stays as it is; a later occurrence that overlaps its own first
one covers only the lines after it, so the first stays whole; a text whose
lines all go becomes empty and the row stays; rows with the same id and text
are one document and are trimmed alike; null ids come last; an empty table
gives an empty result.  Other columns are carried in ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, row_key, written

WINDOW = 3


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``key``, ``pos`` and ``hash`` of every run of ``size`` lines."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), _lines(F.col(text_col).cast("string")).alias("l")).filter(F.size("l") >= size)

    def digest(i: Column) -> Column:
        run = [F.get("l", i + k) for k in range(size)]
        return F.struct(F.xxhash64(*run).alias("x"), F.xxhash64(F.lit(size), *reversed(run)).alias("y"))

    hashes = F.transform(F.sequence(F.lit(0), F.size("l") - size), digest)
    return rows.select("key", F.posexplode(hashes).alias("pos", "hash"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``key`` and ``gone`` (positions of lines to remove) of the documents that lose lines."""
    runs = written(windows(docs, id_col, text_col, size), "windows")
    place = F.struct(F.col("key.id").isNull().alias("none"), F.col("key"), F.col("pos"))
    counts = runs.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    repeated = written(counts.filter("n > 1"), "repeated")
    found = join_hot(runs, repeated, "hash", "n", runs.count(), "inner")
    own = F.col("key").eqNullSafe(F.col("first.key"))
    later = found.filter(~own | (F.col("pos") > F.col("first.pos")))
    after = F.when(own, F.greatest("pos", F.col("first.pos") + size)).otherwise(F.col("pos"))
    spans = later.select("key", F.struct(after.alias("a"), (F.col("pos") + size).alias("z")).alias("span")).filter("span.a < span.z")
    lines = F.array_distinct(F.flatten(F.transform(F.collect_set("span"), lambda s: F.sequence(s["a"], s["z"] - 1))))
    return spans.groupBy("key").agg(lines.alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``row`` (all columns of ``docs``), the new ``text``, ``n_lines``, ``n_removed``."""
    gone = covered(docs, id_col, text_col, size).select(F.col("key").alias("gone_key"), "gone")
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    rows = rows.join(gone, rows["key"].eqNullSafe(gone["gone_key"]), "left")
    text = F.col("row")[text_col].cast("string")
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    new = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return rows.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(new).alias("text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
