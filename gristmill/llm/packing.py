"""Packing of token sequences: exact complements first, then best fit.

Every document's ids, with an end id, are cut into pieces of at most
``capacity`` tokens.  Which pieces share a sequence depends on their lengths
alone, of which there are at most ``capacity``, so the plan is made on the
driver from a table of length -> number of pieces: a bounded input, whatever
the size of the corpus.

The plan takes the longest piece left and looks for a single length, a pair or
a triple that fills its gap exactly, in an index of the sums of the lengths
still available: of singles their counts, of pairs a hash from each sum to the
longer lengths of its pairs, and of triples each sum as a length and a pair's
sum.  A combination is taken only if there are enough pieces of its lengths,
and one that exists is always found.  If none does, the longest piece that fits
goes in (best fit), and the search goes on for the smaller gap.  A combination found is used as often
as its lengths are available, so the plan has few combinations, each with a
number of sequences.

Pieces then learn their places without meeting: pieces of one length are
numbered over a range-partitioned table, and the plan maps (length, number) to
a sequence and an offset.

Defined results: a null text counts as empty and has the end id alone; repeated
rows are packed as rows of their own; null ids are kept; an empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .tokens import blocks, encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in blocks(batches):
            at = 0
            for size, ids in coder.encode(batch.column(1)):
                n, end = len(size), np.cumsum(size)
                raw = memoryview(np.insert(ids, end, end_id).astype("<u4")).cast("B")
                size = size + 1
                begin = np.cumsum(size) - size
                of = -(-size // capacity)
                doc = np.repeat(np.arange(n), of)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(of) - of, of)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                lo = (begin[doc] + start) * 4
                sums = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist())), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + doc)), *map(pa.array, (piece.astype(np.int32), start.astype(np.int64), length.astype(np.int64), sums))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at += n

    return of_batches


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


def _bits(bits: int) -> Iterator[int]:
    """Places of the bits that are set, from the highest."""
    while bits:
        at = bits.bit_length() - 1
        yield at
        bits ^= 1 << at


class _Sums:
    """Available lengths, and their pairs and triples by sum up to ``capacity``."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.counts, self.capacity = Counter({k: v for k, v in histogram.items() if v}), capacity
        self.single = sum(1 << x for x in self.counts)
        down = sum(1 << (capacity - x) for x in self.counts)
        #: Of each sum, a bit for the longer length of each pair.
        self.pairs: dict[int, int] = {}
        for total in range(2, capacity + 1):
            half = (total + 1) // 2
            longer = self.single & (down >> (capacity - total)) >> half << half
            if total % 2 == 0 and self.counts[half] < 2:
                longer &= ~(1 << half)
            if longer:
                self.pairs[total] = longer
        #: The sums of pairs, from the greatest.
        self.pair_sums = sum(1 << (capacity - x) for x in self.pairs)

    def _cut(self, total: int, longer: int) -> None:
        if total in self.pairs:
            self.pairs[total] &= ~(1 << longer)
            if not self.pairs[total]:
                del self.pairs[total]
                self.pair_sums &= ~(1 << (self.capacity - total))

    def use(self, combo: list[int], times: int) -> None:
        """Take pieces away, and what they leave without pieces out of the index."""
        for x, n in Counter(combo).items():
            self.counts[x] -= n * times
            if self.counts[x] < 2:
                self._cut(2 * x, x)
            if not self.counts[x]:
                del self.counts[x]
                self.single &= ~(1 << x)
                for y in self.counts:
                    self._cut(x + y, max(x, y))

    def longest(self, most: int, used: Counter) -> int:
        """The longest length up to ``most`` with a piece that is not ``used``, or 0."""
        fits = self.single & ((2 << most) - 1)
        return next((x for x in _bits(fits) if self.counts[x] > used[x]), 0)

    def pair(self, total: int, used: Counter) -> list[int] | None:
        """Two lengths of this sum, the longer as long as possible."""
        for a in _bits(self.pairs.get(total, 0)):
            b = total - a
            if self.counts[a] > used[a] and self.counts[b] > used[b] + (a == b):
                return [a, b]
        return None

    def complement(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three lengths that sum to ``gap``, beside the pieces ``used``."""
        if self.counts.get(gap, 0) > used[gap]:
            return [gap]
        if two := self.pair(gap, used):
            return two
        for a in _bits(self.single & (self.pair_sums >> (self.capacity - gap))):
            if self.counts[a] > used[a]:
                used[a] += 1
                two = self.pair(gap - a, used)
                used[a] -= 1
                if two:
                    return [a, *two]
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths, each with its number of sequences."""
    free = _Sums(histogram, capacity)
    out: list[tuple[list[int], int]] = []
    while free.counts:
        used: Counter = Counter()
        combo, gap = [], capacity
        while gap > 0:
            more = free.complement(gap, used) if combo else None
            more = more or [x for x in [free.longest(gap, used)] if x]
            if not more:
                break
            combo += more
            used.update(more)
            gap -= sum(more)
        times = min(free.counts[x] // n for x, n in used.items() if n)
        out.append((combo, times))
        free.use(combo, times)
    return out


def _slots(combos: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By (length, first number): the first sequence and the offset.

    Numbers from there to the next entry of the same length go to one sequence
    each, at the same offset.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for combo, times in combos:
        offset = 0
        for length in combo:
            rows.append(((length << 44) + taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return key, first, offset


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each length within a partition sorted by length."""
    block, last, count = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch.column(3).to_numpy()
        if not len(length):
            continue
        new = np.r_[length[0] != last, length[1:] != length[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(length)), -1))
        number = np.where(start < 0, np.arange(len(length)) + count, np.arange(len(length)) - start)
        last, count = length[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), block, np.int32)), pa.array(number)], [*batch.schema.names, "block", "number"])


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the columns of :func:`pieces`."""
    spark = rows.sparkSession
    order = ["length", "doc_id", "piece", "ids_crc32"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, PIECES + ", block int, number long")
    numbered = written(numbered, "numbered")
    # At most one row for each length and one more for each block.
    sums = sorted((r["length"], r["block"], r["n"]) for r in numbered.groupBy("length", "block").agg(F.count("*").alias("n")).collect())
    histogram: Counter = Counter()
    base = {}
    for length, block, n in sums:
        base[block, length] = histogram[length]
        histogram[length] += n
    key, first, offset = _slots(plan(histogram, capacity))
    held = spark.sparkContext.broadcast((base, key, first, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, key, first, offset = held.value
        for batch in batches:
            length, block = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            group, of = np.unique(np.stack([block.astype(np.int64), length]), axis=1, return_inverse=True)
            before = np.fromiter((base[b, n] for b, n in group.T.tolist()), np.int64, group.shape[1])
            wanted = (length << 44) + before[of.ravel()] + batch.column(6).to_numpy()
            at = np.searchsorted(key, wanted, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + wanted - key[at]), pa.array(offset[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
