"""SimHash near-duplicate groups through deletion-variant signatures.

A document's 64-bit fingerprint holds the majority bits of its shingles'
hashes.  Two fingerprints link when they differ in at most ``max_bits`` bits.
To find all links without comparing all fingerprints, the bits are cut into
``max_bits // 2 + 1`` segments: of two linked fingerprints at least one segment
differs in one bit or none.  Each segment is indexed once for each of its bits
with that bit left out; equal variants meet, and the whole fingerprints are
verified.

What meets under one variant is settled in place, and only a spanning forest
of its links goes on, so a group of n fingerprints makes fewer than n rows, not
n * n.  A variant under which many fingerprints meet is not capped: its rows
are indexed again by the bits that the variant does not fix, cut in the same
way, until the groups are small or the fixed bits bound them.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a text with fewer words than a
shingle is one shingle; repeated rows give repeated result rows; null ids take
part, but ``component_id`` is the smallest id that is not null (null if a group
has none); an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop_path, join_hot, keep_rows, row_key, written, written_at

#: Up to this many fingerprints under one variant are compared directly.
GROUP = 2_048
SEED = 42
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 18

_LANES = np.arange(8, dtype=np.uint16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """Hashes of a text's shingles in their order, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(tokens) - words + 1].tolist()
    found = (digest(joined[a:b], SEED) for a, b in zip(start, end[words - 1 :].tolist()))
    return np.fromiter(found, np.uint64, len(start))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        lanes = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_: Column, text_col: str = "text", words: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(id_.alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of_batches, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def _ranges(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Cut bit ranges (from, to) into ``parts`` lists of nearly equal width."""
    bits = [b for lo, hi in free for b in range(lo, hi)]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        runs: list[tuple[int, int]] = []
        for bit in bits[a:b]:
            if runs and runs[-1][1] == bit:
                runs[-1] = (runs[-1][0], bit + 1)
            else:
                runs.append((bit, bit + 1))
        out.append(runs)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(ranges: list[tuple[int, int]]) -> int:
    return sum(1 << b for lo, hi in ranges for b in range(lo, hi))


def _variants(rows: DataFrame, segment: list[tuple[int, int]], tag: int) -> DataFrame:
    """A row for each bit of ``segment``: the key is the segment without it."""
    whole = _mask(segment)
    masks = [_signed(whole & ~(1 << b)) for lo, hi in segment for b in range(lo, hi)]
    keep = F.array(*[F.lit(m).cast("long") for m in masks])
    return rows.select("key", "fp", F.explode(keep).alias("mask")).select(
        F.xxhash64(F.col("key"), F.lit(tag), F.col("mask"), F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"
    )


def _forest(prints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one variant's fingerprints."""
    left = np.unique(prints)
    while len(left) > 1:
        at, left = left[:1], left[1:]
        while len(at) and len(left):
            near = np.bitwise_count(left ^ at[0]) <= max_bits
            found = left[near]
            if len(found):
                yield np.full(len(found), at[0]), found
            left, at = left[~near], np.concatenate([at[1:], found])


def _settle(max_bits: int, group: int):
    """Over rows sorted by key: links of small groups, rows of large ones."""

    def schema(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b)], ["key", "a", "b"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = None  # the key of a group that has already passed the bound

        def groups(key, fp, over):
            """Rows of whole groups; rows of the key ``over`` are the rest of a large one."""
            edge = np.flatnonzero(np.diff(key)) + 1
            start, end = np.r_[0, edge], np.r_[edge, len(key)]
            size = end - start
            a, b = [], []
            two = start[size == 2]
            close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
            a.append(fp[two][close])
            b.append(fp[two + 1][close])
            large = (size > group) | (key[start] == over if over is not None else False)
            for i in np.flatnonzero((size > 2) & ~large):
                for x, y in _forest(fp[start[i] : end[i]], max_bits):
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            apart = a != b
            a, b = a[apart].view(np.int64), b[apart].view(np.int64)
            yield schema(np.zeros(len(a), np.int64), a, b)
            for i in np.flatnonzero(large):
                part = fp[start[i] : end[i]].view(np.int64)
                yield schema(key[start[i] : end[i]], part, part)

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            before = over  # its last rows may start this batch
            if len(key) - last > group:
                over, last = key[-1], len(key)
            elif over is not None and key[-1] == over:
                last = len(key)
            if last:
                yield from groups(key[:last], fp[:last], before)
            rest_key, rest = key[last:], fp[last:]
        if len(rest_key):
            yield from groups(rest_key, rest, over)

    return of_batches


def links(prints: DataFrame, max_bits: int = 2, group: int = GROUP) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``).

    Their connected components are those of all pairs at ``max_bits`` or fewer
    differing bits; of the pairs themselves only a spanning part is given.
    """
    parts = max_bits // 2 + 1
    todo = [(prints.select(F.lit(0).cast("long").alias("key"), "fp"), [(0, 64)])]
    found: DataFrame | None = None
    while todo:
        again = []
        for rows, free in todo:
            for tag, segment in enumerate(_ranges(free, parts)):
                rest = [r for r in _subtract(free, segment)]
                # Rows that agree on all but a byte are at most 2 ** 11 fingerprints: no further cut is needed.
                final = sum(hi - lo for lo, hi in rest) <= 8
                settled = (
                    _variants(rows, segment, tag)
                    .repartition("key")
                    .sortWithinPartitions("key")
                    .mapInArrow(_settle(max_bits, 1 << 30 if final else group), "key long, a long, b long")
                )
                settled = written(settled, "links")
                edges = settled.filter("a <> b").select("a", "b")
                found = edges if found is None else found.unionByName(edges)
                large = settled.filter("a = b").select("key", F.col("a").alias("fp"))
                if not final and not large.isEmpty():
                    again.append((large, rest))
        todo = again
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _subtract(free: list[tuple[int, int]], segment: list[tuple[int, int]]) -> list[tuple[int, int]]:
    gone = {b for lo, hi in segment for b in range(lo, hi)}
    out: list[tuple[int, int]] = []
    for bit in (b for lo, hi in free for b in range(lo, hi)):
        if bit not in gone:
            if out and out[-1][1] == bit:
                out[-1] = (out[-1][0], bit + 1)
            else:
                out.append((bit, bit + 1))
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges from ``a`` down to ``b`` make stars: one edge for each ``a``, and no ``b`` has an edge down."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"))))
    ends = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("low"))
    return ends.filter("down > 1 OR (down = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node on an edge.

    Alternates the large-star and small-star steps: each hangs a node's
    neighbours on the smallest of them, and together they shorten paths until
    every component is a star.  Rounds grow with the logarithm of the number
    of nodes, and each round's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = written_at(edges, "edges")
    while not _stars(edges):
        n_edges = edges.count()
        # A hub's edges are spread (join_hot): its least neighbour goes to them.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least, "a", "n", 2 * n_edges, "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = written_at(large.filter("a <> b"), "edges")
        # Each edge of large leads down from a to b.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, "a", "n", n_edges, "inner").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        small, small_path = written_at(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        drop_path(spark, path)
        drop_path(spark, large_path)
        edges, path = small, small_path
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def near_duplicates(docs: DataFrame, id_: Column | str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, group: int = GROUP) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id of the documents that can be reached
    over links, the document itself included.
    """
    rows = written(fingerprints(docs, F.col(id_) if isinstance(id_, str) else id_, text_col, words), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    part_of = components(links(prints, max_bits, group))
    part_of = prints.join(part_of, prints["fp"] == part_of["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    part_of = written(part_of, "parts")
    least = part_of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = part_of.join(least, "root").select("fp", "n", "component_id")
    return join_hot(rows, table, "fp", "n", rows.count(), "inner").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The columns and rows of ``docs``, of each group the first row only.

    First is by id, null ids last, then by the text's hash, then by all columns.
    """
    key = row_key(id_col, text_col)
    order = F.struct(F.col(id_col).isNull().alias("none"), key.alias("key"))
    groups = near_duplicates(docs, order, text_col, words, max_bits)
    first = groups.filter(F.col("id") == F.col("component_id")).groupBy(F.col("id.key").alias("key")).agg(F.count("*").alias("n"))
    return keep_rows(docs, written(first, "first"), key)


def hex_print(col: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
