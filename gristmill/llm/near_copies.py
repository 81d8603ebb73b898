"""Near-copy groups: SimHash prints by deletion variants, held against the Jaccard similarity of word shingles.

Two documents link when the sets of their shingles have a similarity of
``LEAST`` or more.  Candidates come from the 64-bit prints of the documents: the
deletion variants of :mod:`.simhash` find all prints that differ in at most
``MAX_BITS`` bits.  Prints of documents at 0.8 differ in about ten bits, which no
index over 64 bits bounds, so the rest is found by MinHash: a document has
``BANDS`` keys of ``ROWS`` minima each, and documents that share a key are
candidates too.  A pair at similarity s shares no key with probability
``(1 - s**ROWS)**BANDS``, 0.00003 at 0.8.

Equal sets are made one first.  Candidates hang on the least document of their
print or key, so they make fewer rows than documents have keys.  The components
of these edges are clusters, and the sets of a cluster meet in one place, where
every pair in it is compared whole, by counts over an index of its shingles, and
only the groups found go on: a row for each document, whatever the number of
pairs.  A cluster of more than ``GROUP`` documents (or ``SHINGLES`` shingles) is
cut into blocks, and each two of its blocks meet, so a place holds two blocks at
most and no pair is left out; sets of such a cluster move once for each other
block of it.

Defined results: a null text counts as empty; texts without words are equal; a
text with fewer words than a shingle is one shingle; case of A-Z and kind of
white space do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import give_back, join_hot, keep_rows, row_key, written
from .simhash import SEED, components, majority, shingle_hashes
from .simhash import links as print_links

WORDS = 5
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Differing bits of linked prints: all that the two segments of the index reach.
MAX_BITS = 3
#: Keys of a document, and minima of a key.
BANDS, ROWS = 20, 4
#: About so many documents, and shingles of theirs, are a block: two blocks are held at once.
GROUP = 1_024
SHINGLES = 1 << 19
#: Shingles whose minima are taken at once.
_CHUNK = 1 << 10

_RANDOM = np.random.default_rng(SEED)
_MIX, _TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_FOLD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[i : i + _CHUNK, None] ^ _MIX) * (_TIMES | np.uint64(1))).min(0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _FOLD
        out ^= out >> _SHIFT
    return out


def _signatures(words: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], np.zeros(batch.num_rows, np.uint64)
            for i, x in enumerate(batch.column(1)):
                hashes = shingle_hashes(x.as_py(), words)
                sets.append(np.unique(hashes))
                prints[i] = majority(hashes)
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
            bands = [keys(s).view(np.int64) for s in sets]
            size = pa.array([len(s) for s in sets], pa.int32())
            own = [pa.array(x.view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, size, pa.array([b if len(s) else [] for b, s in zip(bands, sets)], pa.list_(pa.int64()))], ["id", "node", "fp", "size", "bands"])

    return of_batches


def _sets(words: int):
    """The shingles of documents (``cells``, ``node``, ``text``), once for each cell."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = pa.array([shingles(x.as_py(), words).view(np.int64) for x in part.column(2)], pa.list_(pa.int64()))
                cells = part.column(0)
                at = pa.array(np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy()))
                for i in range(0, len(at), 500):
                    some = at.slice(i, 500)
                    yield pa.RecordBatch.from_arrays([cells.flatten().slice(i, 500), part.column(1).take(some), sets.take(some)], ["cell", "node", "shingles"])

    return of_batches


def _groups(nodes: np.ndarray, size: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the least of each group of similar sets to its others; ``found`` has the sets one after the other."""
    up, down = LEAST
    doc = np.repeat(np.arange(len(nodes), dtype=np.int32), size)
    _, of = np.unique(found, return_inverse=True)
    often = np.bincount(of)
    # Shingles that several sets have: each set's, and the sets of each.
    shared = often[of] > 1
    of, doc = of[shared].astype(np.int32), doc[shared]
    at = np.searchsorted(doc, np.arange(len(nodes) + 1))
    sets = doc[np.argsort(of, kind="stable")]
    often = np.where(often > 1, often, 0)
    start = np.cumsum(often) - often
    left, a, b = np.ones(len(nodes), bool), [], []
    for first in np.argsort(nodes).tolist():
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            one = todo.pop()
            own = of[at[one] : at[one + 1]]
            n = often[own]
            ends = np.cumsum(n)
            met = sets[np.repeat(start[own] - (ends - n), n) + np.arange(n.sum())]
            both = np.bincount(met, minlength=len(nodes))
            near = np.flatnonzero(left & (down * both >= up * (size[one] + size - both)))
            left[near] = False
            todo += near.tolist()
            a.append(np.full(len(near), nodes[first]))
            b.append(nodes[near])
    return np.concatenate(a), np.concatenate(b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a``, ``b`` from rows (``cell``, ``node``, ``shingles``) sorted by cell."""
    held: list[pa.RecordBatch] = []  # of one cell, which may go on in the next batch

    def out() -> tuple[np.ndarray, np.ndarray]:
        nodes, size = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in xs]) for xs in ([p.column(1) for p in held], [p.column(2).value_lengths() for p in held]))
        return _groups(nodes, size.astype(np.int64), np.concatenate([p.column(2).flatten().to_numpy(zero_copy_only=False) for p in held]))

    def links_of(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in done]), pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        cell, done = batch.column(0).to_numpy(zero_copy_only=False), []
        cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)] if len(cell) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != cell[lo]:
                done.append(out())
                held = []
            held.append(batch.slice(lo, hi - lo))
        if done:
            yield links_of(done)
    if held:
        yield links_of([out()])
    give_back()


def _sizes_fit(one: str, two: str) -> Column:
    """Whether sets of these sizes can be similar."""
    up, down = LEAST
    return down * F.least(one, two) >= up * F.greatest(one, two)


def _across(members: DataFrame, salts: int = 1) -> DataFrame:
    """Pairs of blocks (``band``, ``node``, ``size``, ``part``) under one key but of different parts, whose sizes fit."""
    one = members.select("band", F.col("node").alias("x"), F.col("size").alias("xs"), F.col("part").alias("p"), F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt"))
    two = members.select("band", F.col("node").alias("y"), F.col("size").alias("ys"), F.col("part").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = one.join(two, ["band", "salt"]).filter("x < y AND p <> q").filter(_sizes_fit("xs", "ys"))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _by_print(nodes: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` whose prints are equal (``a`` is the least) or linked (both are the least)."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")), "prints")
    equal = join_hot(nodes.select("fp", "node"), prints.filter("n > 1"), "fp", "n", nodes.count(), "inner").select("a", F.col("node").alias("b"))
    edges = written(print_links(prints.select("fp"), MAX_BITS).select(F.col("a").alias("fp"), F.col("b").alias("other")), "edges")
    table = prints.drop("n").join(edges.groupBy("fp").agg(F.count("*").alias("n")), "fp")
    linked = join_hot(edges, table, "fp", "n", edges.count(), "inner").drop("n")
    linked = linked.join(prints.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other").select("a", "b")
    return equal.unionByName(linked).filter("a <> b")


def _by_key(nodes: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` that share a key of which ``a`` is the least."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = written(bands.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"), "shared")
    met = join_hot(bands, shared, "band", "n", bands.count(), "inner")
    return met.filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def _cells(clusters: DataFrame, nodes: DataFrame, group: int) -> DataFrame:
    """``key``, ``node`` and ``cells`` (where its set is compared) of documents (``node``, ``root``) in clusters."""
    members = written(clusters.join(nodes.select("node", "size", "key"), "node"), "members")
    sums = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = written(sums.select("root", "n", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("size") / SHINGLES)).alias("blocks")), "clusters")
    block = F.xxhash64("root", F.pmod(F.xxhash64("node"), "blocks")).alias("block")
    placed = join_hot(members.drop("size"), sums, "root", "n", members.count(), "inner").select("key", "node", "blocks", block)
    cut = sums.filter("blocks > 1")
    if cut.isEmpty():
        return placed.select("key", "node", F.array("block").alias("cells"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocks = cut.select(F.col("root").alias("band"), number.alias("i")).select("band", F.xxhash64("band", "i").alias("node"), F.lit(1).alias("size"), F.col("i").alias("part"))
    pairs = _across(blocks, 32).select(F.explode(F.array("a", "b")).alias("block"), F.xxhash64("a", "b").alias("cell"))
    several = placed.join(pairs.groupBy("block").agg(F.collect_list("cell").alias("cells")), "block").select("key", "node", "cells")
    return placed.filter("blocks = 1").select("key", "node", F.array("block").alias("cells")).unionByName(several)


def links(docs: DataFrame, key: Column, nodes: DataFrame, text_col: str = "text", words: int = WORDS, group: int = GROUP) -> DataFrame:
    """Links ``a``, ``b`` whose connected components are those of all similar pairs found.

    ``nodes`` has ``node``, ``fp``, ``size``, ``key`` (of one document that has it) and ``bands``.
    """
    clusters = components(_by_print(nodes).unionByName(_by_key(nodes)))
    placed = written(_cells(clusters, nodes, group), "cells")
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")).join(placed, "key")
    rows = rows.dropDuplicates(["key"]).select("cells", "node", "text")
    sets = rows.mapInArrow(_sets(words), "cell long, node long, shingles array<long>")
    return written(sets.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long"), "links")


def _nodes(rows: DataFrame) -> DataFrame:
    """Of each distinct set of shingles its least row's ``least`` and ``key``, its print, size and keys."""
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "fp", "size", "bands")).alias("m"))
    return written(nodes.select("node", F.col("m.id").alias("least"), F.col("m.id.key").alias("key"), "m.fp", "m.size", "m.bands"), "nodes")


def _signed(docs: DataFrame, key: Column, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id`` (by which the first row is found), ``node``, ``fp``, ``size`` and ``bands`` of every row."""
    order = F.struct(F.col(id_col).isNull().alias("none"), key.alias("key"))
    rows = docs.select(order.alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"node": T.LongType(), "fp": T.LongType(), "size": T.IntegerType(), "bands": T.ArrayType(T.LongType())}
    schema = T.StructType([rows.schema["id"], *(T.StructField(k, v) for k, v in kinds.items())])
    return written(rows.mapInArrow(_signatures(words), schema), "signatures")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP) -> DataFrame:
    """The columns and rows of ``docs``, of each group the first row only.

    First is by id, null ids last, then by the text's hash, then by all columns.
    """
    key = row_key(id_col, text_col)
    rows = _signed(docs, key, id_col, text_col, words)
    nodes = _nodes(rows)
    part_of = components(links(docs, key, nodes, text_col, words, group))
    part_of = nodes.join(part_of, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    least = part_of.groupBy("root").agg(F.min("least").alias("id")).select("id")
    # How many rows have the key of a kept one: counted over the keys alone.
    first = rows.join(least, "id").groupBy(F.col("id.key").alias("key")).agg(F.count("*").alias("n"))
    return keep_rows(docs, written(first, "first"), key)
