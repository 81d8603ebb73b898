import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import language_id

from ..conftest import SMALL
from .helpers import documents


def test_letters_stay_when_nothing_is_learned(spark):
    docs = documents(spark, ["some words", "12 34", None, "", "other words"]).withColumn("lang", F.lit(None).cast("string"))
    assert not language_id.train(docs).families
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()) == [0, 4]


def _model(rng):
    weights = rng.normal(size=(language_id.BUCKETS, 4)).astype(np.float32)
    return language_id.Model((("a", "b"), ("c",)), ((-1, 0, 0), (-1, 1, 1), (0, 0, 1)), weights[:, :3], np.array([0.1, -0.2, 0.3]))


@pytest.mark.parametrize("block", [5, 40, 1 << 17])
def test_scores_by_parts(monkeypatch, block):
    """Long texts are scored part by part, with every n-gram across the cuts."""
    rng = np.random.default_rng(3)
    texts = ["", "x", "1" * 50, "1" * 50 + "z", "Ünï 🙂 𝔘 " * 9] + ["".join(rng.choice(list("abcXYZ é1 \n"), n)) for n in [*range(1, 30), 99, 300]]
    model = _model(rng)
    monkeypatch.setattr(language_id, "_BLOCK", block)
    margins, letters = model.scores(texts)
    assert np.allclose(margins, language_id.features(texts) @ model.weights + model.bias, atol=1e-5)
    assert letters.tolist() == [any(c.isalpha() for c in x) for x in texts]


def test_scores_hold_a_bounded_part_of_the_texts():
    model = _model(np.random.default_rng(4))
    texts = ["some words of a text " * 100_000] + ["of another " * 200] * 1_000
    model.scores(["a"])  # makes the table of letters
    tracemalloc.start()
    model.scores(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000
