"""Exact top-k search by global score histograms.

Vectors are quantized to integers, and a score is an integer inner product.
Queries and candidates are cut into blocks of bounded size, and every pass
scores each block of queries against each block of candidates, in one job.
The first pass finds the range of each query's scores; further passes count the
scores in equal bins of the range in which the query's kth score is known to
be, the counts are summed over the cluster, and the bin of the kth score
becomes the next range; when a range is one score wide, that is the kth.  A
last pass keeps what is above it and, of the ties, the smallest ids.  What is
known of each query is a row of a table in the shared folder, so the driver
holds no query, and the number of passes depends on the width of scores alone.

Of a pair of blocks only the bins are reported that can matter, those from the
kth score of the pair up, and of ties as many as can be needed, so one vector
that makes up a third of all rows costs no more than others.

Defined results: vectors that are null, hold a null or a non-finite component,
or have another number of components than the query, take no part; a query
with fewer than k candidates has all of them; every row of ``queries`` is a
query of its own, also where ids repeat, and meets every row but its own: one of
the rows with its id that score it as high as it scores itself; null ids take
no part; a score outside the range of longs is held at its ends; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Queries and candidates of a block, and components that one may hold.
QUERIES, ROWS, CELLS = 512, 2_048, 1 << 19
BINS = 1_024
#: Blocks of queries are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
_LEAST, _MOST = -(2**63), 2**63 - 1
BLOCKS = "block long, dim int, ids array<long>, flat array<double>"


def usable(col: str) -> Column:
    """A vector without nulls and with finite components only."""
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products, by doubles or longs while these hold every sum."""
    bound = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) < 2**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _blocks(rows: int):
    """Quantized vectors of one number of components, some to a block."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(at)
            for dim in np.unique(size).tolist():
                of = np.flatnonzero(size == dim)
                step = max(1, min(rows, CELLS // max(1, dim)))
                for lo in range(0, len(of), step):
                    part = of[lo : lo + step]
                    cells = np.floor(256.0 * flat[at[part][:, None] + np.arange(dim)]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dim], pa.int32()), pa.array([ids[part]], pa.list_(pa.int64())), pa.array([cells], pa.list_(pa.float64()))], ["block", "dim", "ids", "flat"])
                    number += 1

    return of_batches


def _pairs(batches: Iterator[pa.RecordBatch], state: bool) -> Iterator[tuple]:
    """(block, query ids, state of each query, candidate ids, scores) of every pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            dim = row["dim"].as_py()
            if dim != row["v_dim"].as_py():
                continue
            asked, own = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "v_ids"))
            q, v = (row[c].values.to_numpy(zero_copy_only=False).reshape(n, dim) for c, n in (("flat", len(asked)), ("v_flat", len(own))))
            known = None
            if state:
                known = np.array([[s["q"], s["low"], s["high"], s["shift"], s["wanted"]] for s in row["state"].as_py()], np.int64)
                asked, q = asked[known[:, 0]], q[known[:, 0]]
            yield row["block"].as_py(), asked, known, own, _scores(q, v)


def _table(names: list[str], block: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), block, np.int64)), *map(pa.array, columns)], names)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest score of each query, and the number of its candidates."""
    for block, asked, _, own, score in _pairs(batches, False):
        n = len(asked)
        yield _table(["block", "q", "low", "high", "n"], block, np.arange(n), score.min(1), score.max(1), np.full(n, len(own), np.int64))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores in each bin of the query's range; the last bin is for all above it."""
    for block, asked, known, _, score in _pairs(batches, True):
        q, low, high, shift, wanted = known.T
        over, under = score > high[:, None], score < low[:, None]
        # Differences of longs fit an unsigned long.
        bins = ((score.view(np.uint64) - low.view(np.uint64)[:, None]) >> shift.astype(np.uint64)[:, None]).astype(np.int64, copy=False)
        bins = np.where(over, BINS, np.where(under, BINS + 1, bins))
        counts = np.bincount((np.arange(len(asked))[:, None] * (BINS + 2) + bins).ravel(), minlength=len(asked) * (BINS + 2)).reshape(-1, BINS + 2)[:, : BINS + 1]
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        i, b = np.nonzero((counts > 0) & (above < wanted[:, None]))
        yield _table(["block", "q", "bin", "n"], block, q[i], b, counts[i, b])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All above the kth score, and of its ties those with the smallest ids."""
    for block, asked, known, own, score in _pairs(batches, True):
        q, kth, wanted = known[:, 0], known[:, 1], known[:, 4]
        order = np.argsort(own, kind="stable")
        own, score = own[order], score[:, order]
        tied = score == kth[:, None]
        tied &= tied.cumsum(1) <= wanted[:, None]
        i, c = np.nonzero((score > kth[:, None]) | tied)
        yield _table(["block", "q", "query_id", "vec_id", "score"], block, q[i], asked[i], own[c], score[i, c])


def _met(asked: DataFrame, rows: DataFrame, state: DataFrame | None, broadcast: bool) -> DataFrame:
    """Every block of queries (with its state) beside every block of candidates."""
    if state is not None:
        asked = asked.join(state.groupBy("block").agg(F.collect_list(F.struct("q", "low", "high", "shift", "wanted")).alias("state")), "block")
    others = rows.select(F.col("dim").alias("v_dim"), F.col("ids").alias("v_ids"), F.col("flat").alias("v_flat"))
    return others.crossJoin(F.broadcast(asked) if broadcast else asked)


def _shift() -> Column:
    """Bits to drop so that a range falls into ``BINS`` bins; a difference may not fit a long."""
    width = F.try_subtract("high", "low")
    bits = F.when(width.isNull(), 64).otherwise(F.length(F.bin(width)))
    return F.greatest(F.lit(0), bits - (BINS.bit_length() - 1)).cast("long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates.

    ``queries`` has the same two columns; a query meets every row of
    ``vectors`` but its own.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return written(plain.filter(F.col("vec_id").isNotNull() & usable("vector")).mapInArrow(_blocks(size), BLOCKS), name)

    asked, rows = blocks(queries, block, "queries"), blocks(vectors, ROWS, "rows")
    n_bytes = asked.agg(F.sum(F.lit(8) * (F.size("flat") + F.size("ids")).cast("long"))).first()[0] or 0
    small = n_bytes <= broadcast_bytes
    ranges = _met(asked, rows, None, small).mapInArrow(_ranges, "block long, q long, low long, high long, n long")
    ranges = ranges.groupBy("block", "q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # One more than k, as a query also meets itself.
    state = written(ranges.select("block", "q", "low", "high", F.least("n", F.lit(k + 1)).alias("wanted")).withColumn("shift", _shift()), "state")
    while not (todo := state.filter("low < high")).isEmpty():
        counts = _met(asked, rows, todo, small).mapInArrow(_histogram, "block long, q long, bin long, n long").groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "q").orderBy(F.desc("bin"))
        at = counts.withColumn("seen", F.sum("n").over(down)).join(todo, ["block", "q"]).filter((F.col("seen") >= F.col("wanted")) & (F.col("seen") - F.col("n") < F.col("wanted")))
        # Widths may not fit a long, their ends do.
        width = F.pow(F.lit(2.0), F.col("shift")).cast("decimal(20,0)")
        low = F.col("low").cast("decimal(20,0)") + F.col("bin").cast("decimal(18,0)") * width
        high = F.least(F.col("high").cast("decimal(38,0)"), (low + width - 1).cast("decimal(38,0)"))
        narrow = at.select("block", "q", low.cast("long").alias("low"), high.cast("long").alias("high"), "wanted").withColumn("shift", _shift())
        state = written(state.filter("low >= high").unionByName(narrow), "state")
    found = _met(asked, rows, state, small).mapInArrow(_hits, "block long, q long, query_id long, vec_id long, score long")
    own = written(asked.mapInArrow(_own, "block long, q long, own long"), "own")
    found = found.join(own, ["block", "q"])
    # The query's own row is the one of its id and score, once.
    same = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    nth = Window.partitionBy("block", "q", "vec_id", "score").orderBy(F.lit(1))
    found = found.withColumn("nth", F.row_number().over(nth)).filter(~same | (F.col("nth") > 1))
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score of each query with itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, dim = len(batch.column(2)[i]), batch.column(1)[i].as_py()
            q = batch.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(n, dim)
            score = np.array([_scores(x[None, :], x[None, :])[0, 0] for x in q], np.int64)
            yield _table(["block", "q", "own"], batch.column(0)[i].as_py(), np.arange(n), score)
