"""Memory of a worker's passes over texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontam, textkit, toxicity


def _searched(column):
    return list(decontam._searched(decontam.Index([1], [b"one item of the benchmark that no text holds"], 0.05), column))


def _scored(column):
    return toxicity._scored(toxicity.OrdinalModel(np.ones(1 << toxicity.BITS), np.array([0.0])), column)


@pytest.mark.parametrize("read, most", [(_searched, 80), (_scored, 80)])
def test_a_pass_holds_a_piece_and_not_the_batch(read, most):
    column = pa.array([" ".join(f"w{(k * j) % 5000}" for j in range(600)) for k in range(4000)])
    textkit._powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    tracemalloc.start()
    try:
        read(column)
        assert tracemalloc.get_traced_memory()[1] < most * 1e6
    finally:
        tracemalloc.stop()


def test_scores_are_those_of_the_whole_batch():
    model = toxicity.OrdinalModel(np.random.default_rng(0).normal(size=1 << toxicity.BITS), np.array([0.0, 1.0]))
    column = pa.array(["a b c", None, "", "x y " * 400_000, "...", "q r a a"] * 3)
    rows, features = toxicity._features(column)
    scores, said = toxicity._scored(model, column)
    assert np.array_equal(scores, model.score(rows, features, len(column)))
    assert np.array_equal(said, np.bincount(rows, minlength=len(column)) > 0)
