import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import near_copies

from ..conftest import SMALL
from .helpers import EDGES, components, documents
from .test_simhash import slow_fingerprint


def slow_shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(texts):
    """Places of the texts that stay, in order of place."""
    sets = [slow_shingles(t) for t in texts]
    roots = components(len(sets), lambda i, j: similar(sets[i], sets[j]))
    return [i for i, r in enumerate(roots) if i == r]


@pytest.mark.parametrize("group", [near_copies.GROUP, 1])
def test_near_copies_by_brute_force(spark, group):
    rng = random.Random(11)
    texts = EDGES[:6] + EDGES[8:]
    for n in [6, 30, 100, 300] * 6:
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 500)) for _ in range(n)]
        for _ in range(4):  # chains of copies on both sides of the bound
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, max(1, n // 30))):
                words[rng.randrange(n)] = f"new{rng.random()}"
    rng.shuffle(texts)
    df = documents(spark, texts)
    rows = near_copies.keep_first(df.unionByName(df), group=group).collect()
    assert sorted(r.doc_id for r in rows) == kept(texts)


def test_stage_drops_near_copies_at_many_bits(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 10_000)}" for _ in range(400)]
    near, far = list(words), list(words)
    for i in range(0, 400, 50):
        near[i] = f"n{i}"
    for i in range(0, 400, 12):
        far[i] = f"f{i}"
    texts = [" ".join(x) for x in (words, near, far)]
    assert kept(texts) == [0, 2]
    docs = documents(spark, texts)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == [0, 2]


def test_stage_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    wanted = [list(texts)[i] for i in kept(list(texts.values()))]
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == wanted


def test_of_equal_ids_and_texts_the_least_row_stays(spark):
    df = documents(spark, ["a b c"] * 3 + ["d"], [1, 1, 1, 2]).withColumn("lang", F.element_at(F.array(F.lit("fr"), F.lit("de")), (F.rand(3) * 2).cast("int") + 1))
    df = spark.createDataFrame(df.collect(), df.schema)
    langs = sorted(r.lang for r in df.filter("doc_id = 1").collect())
    kept_rows = near_copies.keep_first(df).collect()
    assert sorted((r.doc_id, r.lang) for r in kept_rows)[0] == (1, langs[0]) and len(kept_rows) == 2


def test_pairs_across_groups(spark):
    rows = [(1, 50, 5), (1, 11, 1), (1, 10, 1), (1, 30, 3), (1, 51, 5), (2, 7, 1), (2, 6, 2)]
    df = spark.createDataFrame(rows, "band long, node long, part long").withColumn("size", F.lit(7))
    wanted = {(a, b) for k, a, p in rows for j, b, q in rows if k == j and a < b and p != q}
    for salts in (1, 4):
        assert {tuple(r) for r in near_copies._across(df, salts).collect()} == wanted
    sizes = spark.createDataFrame([(1, 1, 1, 7), (1, 2, 2, 8), (1, 3, 3, 9), (1, 4, 4, 10)], "band long, node long, part long, size int")
    assert {tuple(r) for r in near_copies._across(sizes).collect()} == {(1, 2), (2, 3), (2, 4), (3, 4)}


def test_null_ids(spark):
    df = documents(spark, ["a b c", "A  b c", None, "", "d"], [None, 4, None, 2, None])
    assert sorted((r.doc_id or -1, r.text or "") for r in near_copies.keep_first(df).collect()) == [(-1, "d"), (2, ""), (4, "A  b c")]
    assert near_copies.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_similar_sets_share_a_key(share):
    rng, missed = np.random.default_rng(7), 0
    for _ in range(2_000):
        both = rng.integers(0, 1 << 64, int(100 * share), np.uint64)
        one, two = np.array_split(rng.integers(0, 1 << 64, 100 - len(both), np.uint64), 2)
        a, b = (near_copies.keys(np.concatenate([both, x])) for x in (one, two))
        missed += not (a == b).any()
    assert missed <= 2


def test_prints_link_without_keys(spark):
    """Near copies by deletion variants alone; equal prints of unlike texts stay apart."""
    rng, texts = random.Random(13), []
    for n in (40, 200, 600) * 4:
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(n)]
        for _ in range(4):
            texts.append(" ".join(words))
            words = [*words, f"end{rng.random()}"]
        texts.append(texts[-1].upper())
    for _ in range(3):
        texts.append("word " * 3_000 + " ".join(f"w{rng.randint(0, 10_000)}" for _ in range(100)))
    texts += [None, "", "one"]
    sets, prints = [slow_shingles(t) for t in texts], [slow_fingerprint(t, 5) for t in texts]
    linked = [[(prints[i] ^ prints[j]).bit_count() <= 3 for j in range(len(texts))] for i in range(len(texts))]
    assert linked[-6][-5] and not similar(sets[-6], sets[-5])
    wanted = components(len(texts), lambda i, j: linked[i][j] and similar(sets[i], sets[j]))
    assert len(set(wanted)) < len(texts) - 30
    docs = documents(spark, texts)
    key = near_copies.row_key("doc_id", "text")
    rows = near_copies._signed(docs, key, "doc_id", "text", near_copies.WORDS)
    nodes = near_copies._nodes(rows).withColumn("bands", F.array().cast("array<long>"))
    found = near_copies.components(near_copies.links(docs, key, nodes))
    root = {r.node: r.root for r in found.collect()}
    got: dict = {}
    for r in rows.collect():
        assert r.fp & (2**64 - 1) == prints[r.id.key.id]
        got.setdefault(root.get(r.node, r.node), []).append(r.id.key.id)
    assert sorted(map(sorted, got.values())) == sorted([i for i, r in enumerate(wanted) if r == x] for x in set(wanted))


def mostly_alike(rng, n, kept_words=0.97):
    """Texts with parts of one text, many pairs of them candidates and few of them near copies."""
    base = [f"w{i}" for i in range(150)]
    return [" ".join(w if rng.random() < kept_words else f"x{rng.random()}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("shingles", [1 << 19, 2_000])
def test_unlike_candidates_make_no_pairs_of_documents(spark, monkeypatch, shingles):
    texts, across, made = mostly_alike(random.Random(14), 90), near_copies._across, []

    def counted(*args):
        found = across(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_across", counted)
    monkeypatch.setattr(near_copies, "SHINGLES", shingles, raising=False)
    wanted = kept(texts)
    assert 10 < len(wanted) < 80
    assert sorted(r.doc_id for r in near_copies.keep_first(documents(spark, texts)).collect()) == wanted
    assert sum(made) < len(texts)


def test_cells_that_span_batches():
    rng, cells, sets = random.Random(15), [], []
    for cell in range(30):
        for t in mostly_alike(rng, rng.choice([1, 2, 3, 40])):
            cells.append(cell)
            sets.append(near_copies.shingles(t).view(np.int64))
    nodes = [rng.randrange(-(2**63), 2**63) for _ in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cell", "node", "shingles"])
    shingle_sets = [set(x.tolist()) for x in sets]
    roots = components(len(sets), lambda i, j: cells[i] == cells[j] and similar(shingle_sets[i], shingle_sets[j]))
    wanted = sorted(sorted(nodes[i] for i, r in enumerate(roots) if r == x) for x in set(roots))
    for size in (1, 7, len(sets)):
        group = {n: [n] for n in nodes}
        batches = (batch.slice(i, size) for i in range(0, len(sets), size))
        for out in near_copies._compare(batches):
            for a, b in zip(*(x.to_pylist() for x in out.columns)):
                group[a].append(b)
                del group[b]
        assert sorted(map(sorted, group.values())) == wanted
