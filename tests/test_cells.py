from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from newslake.operators import cells, search
from test_search import brute_force, rows, tables, vectors  # noqa: F401


@pytest.mark.parametrize(("n_cells", "k", "block"), [(1, 8, 10_000), (7, 8, 10_000), (40, 3, 5), (400, 8, 16)])
def test_exact_search_by_cell_with_ties(spark, vectors, n_cells, k, block):  # noqa: F811
    q, c = tables(spark, vectors)
    index = cells.build_cells(c, n_cells)
    assert index.sizes.sum() == 300
    found = cells.search_cells(index, q, k, probes=2, exact=True, question_block=block, chunk_block=block)
    assert rows(found) == brute_force(vectors, k)


def test_a_hot_cell_is_cut_into_blocks(spark, vectors):  # noqa: F811
    """A third of the chunks are copies, so one cell holds them all; each of its blocks stays small."""
    q, c = tables(spark, vectors)
    index = cells.build_cells(c, 20)
    assert index.sizes.max() >= 100
    cut = cells.search_cells(index, q, 8, probes=20, question_block=4, chunk_block=8)
    assert rows(cut) == brute_force(vectors, 8)


def test_distant_cells_are_not_read(spark):
    draw = np.random.default_rng(3)
    centres = np.eye(10)
    points = np.repeat(centres, 30, axis=0) + draw.normal(scale=0.02, size=(300, 10))
    q, c = tables(spark, (centres[:5], points))
    index = cells.build_cells(c, 10)
    known = cells._Cells(index.centroids, index.sizes, index.radii, cells._grouped(index, 1))
    asked = np.asarray([r["embedding"] for r in q.collect()])
    near = cells._wanted(asked, None, known, 1, 8).sum()
    rest = cells._wanted(asked, np.full(5, 0.01), known, 1, 8).sum()
    assert near == 5 and rest == 0
    assert rows(cells.search_cells(index, q, 8, probes=1, exact=True)) == brute_force((centres[:5], points), 8)


def test_probes_reach_the_wanted_recall(spark):
    draw = np.random.default_rng(5)
    some = draw.normal(size=(400, 24)).astype(np.float32)
    q, c = tables(spark, (some[:150], some))
    index = cells.build_cells(c, 20)
    probes = cells.probes_for(index, q, sample_rows=60)
    assert 1 < probes < 20
    both = cells.recall(cells.search_cells(index, q, probes=probes), search.top_k(q, c)).first()
    assert both["n_found"] >= 0.85 * both["n_wanted"]


def test_empty_tables_and_rows_without_vector(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("z", [])], "question_id STRING, embedding ARRAY<FLOAT>")
    c = spark.createDataFrame(
        [("x", "t", [1.0, 0.0]), ("y", "t", None), ("z", "t", [])], "chunk_id STRING, type STRING, embedding ARRAY<FLOAT>"
    )
    for exact in (True, False):
        assert [(r[0], r[2]) for r in cells.search_cells(cells.build_cells(c), q, exact=exact).collect()] == [("a", "x")]
        assert cells.search_cells(cells.build_cells(c), q.where("false"), exact=exact).count() == 0
        assert cells.search_cells(cells.build_cells(c.where("false")), q, exact=exact).count() == 0


@pytest.mark.parametrize("reached", [False, True])
def test_memory_of_a_group_does_not_grow_with_the_cells(reached):
    """A task of 16,384 questions looks at all centroids, some rows at a time, and keeps what it is told of its group."""
    draw, n, peaks = np.random.default_rng(8), 16_384, []
    points = draw.normal(size=(n, 4))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), 4).cast(pa.list_(pa.float64()))
    questions = pa.table({"question_id": pa.array([f"q{i}" for i in range(n)]), "embedding": vectors})
    if reached:
        questions = questions.append_column("reached", pa.array(np.full(n, 0.5)))
    schema = pa.schema([("question_id", pa.string()), ("chunk_id", pa.string()), ("distance", pa.float64())])
    for size in (50, 1000):
        known = cells._Cells(draw.normal(size=(size, 4)), np.full(size, 100), np.ones(size), np.zeros(size, np.int64))
        chunks = pa.table({
            "chunk_id": pa.array([f"c{i}" for i in range(200)]), "embedding": vectors[:200],
            "cell": pa.array(np.arange(200) // 100, pa.int32()),
        })
        tracemalloc.start()
        try:
            cells._group_search(known, 8, 8, schema)(questions, chunks)
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] - peaks[0] < 60e6


def test_blocks_of_rows_tell_the_same_cells(monkeypatch):
    draw = np.random.default_rng(6)
    rows, centroids, sizes = draw.normal(size=(90, 5)), draw.normal(size=(30, 5)), np.arange(30) % 4
    known = cells._Cells(centroids, sizes, np.full(30, 0.5), np.zeros(30, np.int64))
    reached, some = np.where(np.arange(90) % 7 == 0, np.nan, 0.4), np.array([2, 3, 17])
    whole = [cells._wanted(rows, r, known, 3, 8) for r in (None, reached)]
    nearest = cells._nearest_cell(rows, centroids)
    monkeypatch.setattr(cells, "CELL_DISTANCES", 200)
    for r, want in zip((None, reached), whole):
        assert (cells._wanted(rows, r, known, 3, 8) == want).all()
        assert (cells._wanted(rows, r, known, 3, 8, some) == want[:, some]).all()
    assert all(np.allclose(a, b) for a, b in zip(cells._nearest_cell(rows, centroids), nearest))
