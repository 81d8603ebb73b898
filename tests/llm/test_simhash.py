import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import simhash
from gristmill.llm.catalog import op1_simhash_near_dedup

from ..conftest import SMALL
from .helpers import EDGES, components, documents


def slow_fingerprint(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition():
    rng = random.Random(1)
    texts = EDGES[:6] + EDGES[8:] + ["".join(rng.choice("aB \n\té,") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def planted(spark, rng, n):
    """Fingerprints in chains and clusters around some centres."""
    prints = {0}
    for _ in range(n):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(at)
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
    return sorted(prints)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
@pytest.mark.parametrize("group", [2, 2048])
def test_groups_by_brute_force(spark, max_bits, group):
    prints = planted(spark, random.Random(max_bits), 25)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df, max_bits, group)
    found = {(r.a, r.b) for r in edges.collect()}
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits
    order = sorted(range(len(prints)), key=lambda i: signed[i])
    ranked = [signed[i] for i in order]
    wanted = components(len(ranked), lambda i, j: ((ranked[i] ^ ranked[j]) & (2**64 - 1)).bit_count() <= max_bits)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [roots.get(p, p) for p in ranked] == [ranked[i] for i in wanted]


def test_dense_group_makes_few_links(spark):
    base, bits = random.Random(3).getrandbits(62), [1 << b for b in range(0, 60, 3)]
    prints = {base} | {base ^ a for a in bits} | {base ^ a ^ b for a in bits for b in bits if a != b}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for group in (8, 2048):
        edges = simhash.links(df, 2, group)
        assert {r.root for r in simhash.components(edges).collect()} == {min(prints)}
        assert edges.count() < 40 * len(prints)


def test_crowded_variants_across_batches():
    """The last rows of one crowded key come in the batch that the next one fills."""
    keys = [[1] * 6, [1] * 2 + [2] * 6, [2] * 3 + [3] * 2, [3] * 1]
    prints = iter(range(0, 10_000, 7))
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([next(prints) for _ in k], pa.int64())], ["key", "fp"]) for k in keys]
    out = pa.Table.from_batches(simhash._settle(2, 4)(iter(batches))).to_pylist()
    again = [(r["key"], r["a"]) for r in out if r["a"] == r["b"]]
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert sorted(again) == [(k, fp) for k, fp in rows if k < 3]


def test_long_chain(spark):
    """A path of 200 nodes, joined in a scrambled order."""
    nodes = list(range(0, 2000, 10))
    random.Random(4).shuffle(nodes)
    df = spark.createDataFrame([(min(p), max(p)) for p in zip(nodes, nodes[1:])], "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}


def test_no_links(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert simhash.components(df).count() == 0


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    ids = sorted(prints)
    roots = components(len(ids), lambda i, j: (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_near_dedup(spark, SMALL).collect()}
    assert found == {d: (f"{prints[d]:016x}", ids[r]) for d, r in zip(ids, roots)}


def test_odd_rows(spark):
    ids = list(range(len(EDGES)))
    ids[0], ids[1] = None, 7
    df = documents(spark, EDGES, ids)
    rows = simhash.near_duplicates(df.unionByName(df)).collect()
    assert len(rows) == 2 * len(EDGES)
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(df.filter("doc_id IS NULL")).collect()] == [None]


def test_keep_first(spark):
    texts = ["a b c d", "A b c d", "quite another text here", None, "", "a b c d"]
    df = documents(spark, texts, [5, 3, 9, None, None, 3])
    rows = simhash.keep_first(df.unionByName(df))
    assert rows.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in rows.collect()) in ([(-1, ""), (3, "A b c d"), (9, texts[2])], [(-1, ""), (3, "a b c d"), (9, texts[2])])
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_hot_fingerprint(spark):
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text for all of these")).otherwise(F.concat(F.lit("text number "), "id", F.lit(" "), F.md5(F.col("id").cast("string")))).alias("text"))
    rows = simhash.near_duplicates(df)
    assert rows.count() == 6_000
    assert rows.filter("component_id = 0").count() >= 2_000


