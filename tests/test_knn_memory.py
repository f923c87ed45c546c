"""What a search holds goes by its questions, whatever the chunks."""

import tracemalloc

import numpy as np
from test_knn import brute_force, frames, rows

from citemill.operators import knn


def unit(rng, n):
    vectors = rng.normal(size=(n, 16))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_products_are_taken_in_small_blocks():
    """8192 questions, the most that are broadcast, against 5000 chunks, of which 1000 are one vector."""
    rng = np.random.default_rng(1)
    asked, held = unit(rng, 8192), unit(rng, 5000)
    held[::5] = held[0]
    best = knn._Best(asked, 2 + np.arange(8192) % 19)
    tracemalloc.start()
    best.add(held, np.arange(5000)[::-1].copy())
    question, distance, ids = best.result()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One product of all questions with 4096 chunks alone has 268 MB.
    assert peak < 200 << 20
    for q in range(0, 8192, 997):
        every = np.maximum(np.round(1 - held @ asked[q], 9), 0.0)
        order = np.lexsort((np.arange(5000)[::-1], every))[: 2 + q % 19]
        assert ids[question == q].tolist() == np.arange(5000)[::-1][order].tolist()
        assert np.allclose(distance[question == q], every[order], atol=2e-9)


def test_candidates_do_not_multiply_with_cells(spark, monkeypatch):
    """Chunks of all cells pass one task, which gives out a question's best rows once."""
    asked, held, questions, chunks = frames(spark, 8, 30, 600, copies=200)
    seen = []
    ranked = knn._ranked
    monkeypatch.setattr(knn, "_ranked", lambda candidates: seen.append(candidates.count()) or ranked(candidates))
    assert rows(knn.nearest_by_cells(questions, chunks, cells=30)) == brute_force(asked, held)
    assert seen == [sum(2 * k for *_, k in asked)]
