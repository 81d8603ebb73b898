"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (the whole item, if it has
fewer).  The tokens of the join are shingles of ``SHINGLE`` consecutive words
(the whole window, if it has fewer), ordered by how rare they are in the corpus.
A window occurs in a document only if all of its shingles stand there, so in
the prefix filter's terms its required overlap is its size, and the prefix that
is necessary is one token: each window is indexed under its rarest shingle, with
that shingle's place in the window.  Document shingles equi-join that index; a
match fixes where the window would start, which bounds length and position on
both sides (it may not begin before the document or end after it), and the
document's words there are compared with the window's.

The index is broadcast if it takes at most ``BROADCAST_BYTES``; the join then
runs in the pass that splits the texts, and only verified occurrences are
shuffled.  Beyond that, document shingles meet the index in a shuffle join in
which frequent shingles are spread over many partitions, and candidates go back
to their documents to be verified.

Everything here is DataFrame operations.

Defined results: a null or empty text has no words and is not contaminated; an
item without words has no windows; items that share an id count once; an item
without an id marks its words but is not counted; repeated documents give
repeated result rows; an empty table on either side is allowed.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_salted, row_key, written

WINDOW = 13
SHINGLE = 3
#: An index of so many bytes, and a vocabulary of an eighth of it in longs, are broadcast.
BROADCAST_BYTES = 32 << 20
#: The upper-case letters, and what separates words.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The token at the end of each document; only there it stands for no shingle.
_END = 0


def words(col: str | Column) -> Column:
    """The words of a text, A-Z lower-cased and other letters as they are."""
    text = F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (words), ``items`` (ids of the items that hold it)."""
    rows = items.select(F.col(id_col).alias("item_id"), words(text_col).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    return rows.select("item_id", F.explode(runs).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _shingle(w: Column, at: Column, size: int) -> Column:
    """The token of the ``size`` words from place ``at`` (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)])


def _positions(docs: DataFrame, sizes: list[int], text_col: str, *more: Column) -> DataFrame:
    """``token`` and ``pos`` of every shingle, and of every document's end; with ``w``, its words, and ``n``, their number."""
    rows = docs.select(*more, words(text_col).alias("w")).withColumn("n", F.size("w"))
    # One generator for all sizes keeps the words out of the rows that it makes.
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("n") + 1) * len(sizes) - 1)))
    rows = rows.withColumn("pos", F.floor(F.col("at") / len(sizes)).cast("int"))
    pos, n = F.col("pos"), F.col("n")
    token = F.lit(None).cast("long")
    for k, size in enumerate(sizes):
        token = F.when((F.col("at") % len(sizes) == k) & (pos + size <= n), _shingle(F.col("w"), pos, size)).otherwise(token)
    return rows.withColumn("token", F.when(F.col("at") == n * len(sizes), F.lit(_END).cast("long")).otherwise(token)).drop("at")


def frequencies(docs: DataFrame, vocabulary: DataFrame, sizes: list[int], text_col: str = "text", broadcast: bool = True) -> DataFrame:
    """How often each shingle of ``vocabulary`` (column ``token``) stands in the corpus."""
    found = _positions(docs, sizes, text_col).filter("pos < n").select("token")
    if broadcast:
        return found.join(F.broadcast(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    return found.groupBy("token").agg(F.count("*").alias("freq")).join(vocabulary, "token", "left_semi")


def index(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", doc_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, list[int]]:
    """Windows under their rarest shingle (``token, off, len, win, items, freq``), and the sizes of shingles.

    Windows with a shingle that the corpus lacks cannot occur and are left out.
    """
    wins = written(windows(items, window, id_col, text_col), "windows")
    sizes = sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE rows
    at = wins.withColumn("off", F.explode(F.sequence(F.lit(0), F.size("win") - F.least(F.size("win"), F.lit(SHINGLE)))))
    token = F.lit(None).cast("long")
    for size in sizes:
        token = F.when(F.least(F.size("win"), F.lit(SHINGLE)) == size, _shingle(F.col("win"), F.col("off"), size)).otherwise(token)
    tokens = written(at.withColumn("token", token), "shingles")
    vocabulary = written(tokens.select("token").distinct(), "vocabulary")
    if not sizes:
        return written(tokens.withColumns({"len": F.size("win"), "freq": F.lit(0).cast("long")}), "index"), [SHINGLE]
    freq = written(frequencies(docs, vocabulary, sizes, doc_text_col, 64 * vocabulary.count() <= broadcast_bytes), "frequencies")
    ranked = tokens.join(freq, "token", "left").groupBy("win", "items").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token", "off")).alias("r"))
    ranked = ranked.filter("r.freq > 0").select("r.token", "r.off", F.size("win").alias("len"), "win", "items", "r.freq")
    return written(ranked, "index"), sizes


def _bytes(index: DataFrame) -> int:
    """About how much memory the rows of an index take."""
    each = F.aggregate("win", F.lit(0).cast("long"), lambda n, x: n + 24 + F.octet_length(x)) + 24 * F.size("items") + 64
    return index.agg(F.sum(each)).first()[0] or 0


def _occurrences(docs: DataFrame, key: Column, index: DataFrame, sizes: list[int], text_col: str, broadcast: bool) -> DataFrame:
    """``key, n_words`` once per document, and ``key, span, items`` per occurrence."""
    start, size = F.col("pos") - F.col("off"), F.col("len")
    span = F.struct(start.cast("long").alias("a"), (start + size).cast("long").alias("z"))
    inside = (size > 0) & (F.col("pos") < F.col("n")) & (start >= 0) & (start + size <= F.col("n"))
    exact = F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("win")
    ends = (size == 0) & (F.col("pos") == F.col("n"))
    out = [F.col("key"), F.when(size == 0, F.col("n")).cast("long").alias("n_words"), F.when(size > 0, span).alias("span"), F.col("items")]
    end = index.sparkSession.range(1).select(F.lit(_END).cast("long").alias("token"), F.lit(0).alias("off"), F.lit(0).alias("len"), *[F.array().cast(index.schema[c].dataType).alias(c) for c in ("win", "items")])
    positions = _positions(docs, sizes, text_col, key.alias("key"))
    if broadcast:
        table = F.broadcast(index.drop("freq").unionByName(end))
        return positions.join(table, "token").filter(ends | (inside & exact)).select(*out)
    whole = docs.select(key.alias("key"), words(text_col).alias("w")).groupBy("key").agg(F.first("w").alias("w"), F.count("*").alias("times"))  # rows of one key have one text
    ended = whole.select("key", F.size("w").cast("long").alias("n_words"), F.lit(None).cast("struct<a:bigint,z:bigint>").alias("span"), F.lit(None).cast(index.schema["items"].dataType).alias("items"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("t")).drop("t")
    total = index.agg(F.sum("freq")).first()[0] or 0
    candidates = join_salted(positions.filter("pos < n").select("key", "pos", "n", "token"), index, "token", "freq", total)
    candidates = candidates.filter(inside).select("key", "pos", "n", "off", "len", "win", "items").distinct()
    return candidates.join(whole.select("key", "w"), "key").filter(exact).select(*out).unionByName(ended)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """For every document: ``key`` (of its row), ``n_words``, ``n_hit`` and ``item_ids``.

    ``n_hit`` counts the words inside any occurrence of a window, and
    ``item_ids`` (strings, sorted) are the items whose windows occur.  Rows of
    the same id and text have one result row, with their number in ``n_rows``.
    """
    table, sizes = index(docs, items, window, item_id_col, item_text_col, text_col, broadcast_bytes)
    found = _occurrences(docs, row_key(id_col, text_col), table, sizes, text_col, _bytes(table) <= broadcast_bytes)
    per_doc = found.groupBy("key").agg(
        F.count("n_words").alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("item_ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda at, x: F.struct((at["n"] + F.greatest(F.lit(0).cast("long"), x["z"] - F.greatest(at["to"], x["a"]))).alias("n"), F.greatest(at["to"], x["z"]).alias("to")),
        lambda at: at["n"],
    )
    return per_doc.select("key", "n_rows", "n_words", covered.alias("n_hit"), "item_ids")


def is_contaminated() -> Column:
    """At least one in twenty of a document's words is inside a window."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for every row of ``docs``: counts, a digest of the items, the verdict."""
    found = contamination(docs, items, window, id_col, text_col, broadcast_bytes=broadcast_bytes)
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return found.select(
        F.col("key.id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
