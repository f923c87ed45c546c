import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.operators import knn
from citemill.operators.vectors import cosine_distance, embed


def brute_force(questions, chunks):
    out = []
    for q, qv, k in questions:
        ranked = sorted(
            (max(round(1 - float(np.dot(qv, cv)) / (np.linalg.norm(qv) * np.linalg.norm(cv)), 9), 0.0), c)
            for c, cv in chunks
        )
        out += [(q, c, rank) for rank, (_, c) in enumerate(ranked[:2 * k], 1)]
    return sorted(out)


def frames(spark, seed, n_questions, n_chunks, copies, as_text=False):
    """Clustered vectors; ``copies`` chunks share one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))

    def draw(n):
        return (centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32)

    vectors = draw(n_chunks)
    vectors[:copies] = vectors[0]
    asked = [(i, v.astype(float).tolist(), 1 + i % 10) for i, v in enumerate(draw(n_questions))]
    asked[0] = (0, vectors[0].astype(float).tolist(), 10)
    held = [(f"c{i}" if as_text else i, v.astype(float).tolist()) for i, v in enumerate(vectors)]
    kind = "string" if as_text else "bigint"
    return (
        asked,
        held,
        spark.createDataFrame(asked, "query_id bigint, embedding array<float>, top_k int"),
        spark.createDataFrame(held, f"chunk_id {kind}, embedding array<float>").repartition(5),
    )


def rows(found):
    return sorted((r.query_id, r.chunk_id, r.rank) for r in found.collect())


@pytest.mark.parametrize("as_text", [False, True])
def test_broadcast_search_is_exact(spark, as_text):
    asked, held, questions, chunks = frames(spark, 1, 40, 900, copies=300, as_text=as_text)
    assert rows(knn.nearest_chunks(questions, chunks)) == brute_force(asked, held)


@pytest.mark.parametrize("cells, chunk_rows, question_rows", [(4, 50, 7), (30, 40, 1000), (64, 10_000, 9)])
def test_cell_search_is_exact(spark, cells, chunk_rows, question_rows):
    """Also with one vector held by a third of all chunks, and many small blocks."""
    asked, held, questions, chunks = frames(spark, 2, 30, 600, copies=200)
    found = knn.nearest_by_cells(
        questions, chunks, cells=cells, chunk_block_rows=chunk_rows, question_block_rows=question_rows
    )
    assert rows(found) == brute_force(asked, held)


def test_question_set_over_the_limit_goes_by_cells(spark, monkeypatch):
    asked, held, questions, chunks = frames(spark, 3, 20, 200, copies=3)
    assert knn.small_question_set(questions, max_questions=19) is None
    assert knn.small_question_set(questions, max_bytes=100) is None
    assert knn.small_question_set(questions).num_rows == 20
    monkeypatch.setattr(knn, "small_question_set", lambda _: None)
    assert rows(knn.nearest_chunks(questions, chunks)) == brute_force(asked, held)


def test_fewer_chunks_than_asked_for(spark):
    asked, held, questions, chunks = frames(spark, 4, 12, 5, copies=1)
    want = brute_force(asked, held)
    assert rows(knn.nearest_chunks(questions, chunks)) == want
    assert rows(knn.nearest_by_cells(questions, chunks, cells=3)) == want


def test_nothing_to_search(spark):
    _, _, questions, chunks = frames(spark, 5, 12, 5, copies=1)
    assert knn.nearest_chunks(questions, chunks.limit(0)).count() == 0
    assert knn.nearest_by_cells(questions, chunks.limit(0)).count() == 0
    assert knn.nearest_chunks(questions.limit(0), chunks).count() == 0


def test_clustered_vectors_prune_cells(spark):
    _, _, questions, chunks = frames(spark, 6, 30, 3000, copies=1)
    pivots = knn.pick_pivots(chunks, 64)
    stats = knn.assign_cells(chunks, pivots).groupBy("cell").agg(
        F.min("radius").alias("near"), F.max("radius").alias("far")
    ).collect()
    near, far = np.full(64, np.inf), np.full(64, -np.inf)
    for row in stats:
        near[row.cell], far[row.cell] = row.near, row.far
    visited = knn._visits(questions, pivots, near, far, None).agg(F.avg(F.size("cells"))).first()[0]
    assert visited < 48


def test_probing_all_cells_is_exact_and_fewer_lose_little(spark):
    _, _, questions, chunks = frames(spark, 7, 30, 2000, copies=1)
    exact = knn.nearest_chunks(questions, chunks)
    everything = knn.nearest_in_probed_cells(questions, chunks, cells=16, probes=16)
    assert knn.recall(everything, exact).first().recall == 1.0
    some = knn.nearest_in_probed_cells(questions, chunks, cells=16, probes=6)
    assert knn.recall(some, exact).first().recall > 0.8


def test_embedder_gives_unit_vectors(spark):
    texts = spark.createDataFrame([(1, "Wear gloves"), (2, "wear GLOVES!"), (3, "\n"), (4, "acid spill")], "i int, text string")
    vectors = embed(texts)
    lengths = vectors.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(abs(row[0] - 1) < 1e-6 for row in lengths)
    pair = vectors.alias("a").join(vectors.alias("b"), F.expr("a.i = 1 AND b.i IN (2, 4)"))
    found = {r.i: r.d for r in pair.select(F.col("b.i").alias("i"), cosine_distance(F.col("a.embedding"), F.col("b.embedding")).alias("d")).collect()}
    assert abs(found[2]) < 1e-6 and found[4] > 0.5
