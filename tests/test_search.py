from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslake.operators import search
from newslake.operators.neighbours import neighbour_chunks, neighbour_ids
from newslake.operators.vectorise import fit_idf, normalise_vectors, pair_similarity, sparse_terms, vectorise
from newslake.functions.vectors import DIMS

QUESTIONS = "question_id STRING, embedding ARRAY<FLOAT>"
CHUNKS = "chunk_id STRING, type STRING, embedding ARRAY<FLOAT>"


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    questions = draw.normal(size=(37, 12)).astype(np.float32)
    chunks = draw.normal(size=(300, 12)).astype(np.float32)
    # A third of all chunks are copies of one vector, which is also the best answer to question 0.
    chunks[::3] = chunks[0]
    questions[0] = chunks[0]
    return questions, chunks


def tables(spark, vectors, parts=5):
    questions, chunks = vectors
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(questions)], QUESTIONS)
    kinds = ("batch", "online", "chat")
    c = spark.createDataFrame([(f"c{i}", kinds[i % 3], v.tolist()) for i, v in enumerate(chunks)], CHUNKS)
    return q, c.repartition(parts)


def brute_force(vectors, k, keep=lambda i: True):
    questions, chunks = (v.astype(np.float64) for v in vectors)
    out = set()
    for i, q in enumerate(questions):
        d = 1 - chunks @ q / (np.linalg.norm(chunks, axis=1) * np.linalg.norm(q))
        order = sorted((round(float(x), 6) + 0.0, f"c{j}") for j, x in enumerate(d) if keep(j))[:k]
        out |= {(f"q{i}", r, c, x) for r, (x, c) in enumerate(order, 1)}
    return out


def rows(df):
    return {tuple(r) for r in df.select("question_id", "rank", "chunk_id", "distance").collect()}


@pytest.mark.parametrize("k", [1, 8])
def test_broadcast_search_is_exact_with_ties(spark, vectors, k):
    q, c = tables(spark, vectors)
    assert rows(search.top_k(q, c, k)) == brute_force(vectors, k)


@pytest.mark.parametrize(("slice_bytes", "bound_parts"), [(1000, None), (400, 3), (1 << 20, 2), (1 << 20, 300)])
def test_sliced_and_bounded_search_is_exact_with_ties(spark, vectors, slice_bytes, bound_parts):
    q, c = tables(spark, vectors)
    got = search.top_k(q, c, 8, slice_bytes=slice_bytes, bound_parts=bound_parts)
    assert rows(got) == brute_force(vectors, 8)


def test_small_tiles(spark, vectors):
    best = search._Best(vectors[0].astype(np.float64) / np.linalg.norm(vectors[0], axis=1, keepdims=True), 3)
    old, search.TILE = search.TILE, 16
    try:
        ids = np.array([f"c{i}" for i in range(300)])
        unit = vectors[1].astype(np.float64) / np.linalg.norm(vectors[1], axis=1, keepdims=True)
        for part in np.array_split(np.random.default_rng(1).permutation(300), 7):
            best.add(ids[part], unit[part])
    finally:
        search.TILE = old
    want = {(f"q{q}", c, x) for q, _, c, x in ((a[1:], b, c, x) for a, b, c, x in brute_force(vectors, 3))}
    assert {(f"q{q}", c, float(d)) for q, c, d in zip(best.q, best.ids, best.distance)} == {
        (q, c, x) for q, c, x in want
    }


def test_search_of_one_type(spark, vectors):
    q, c = tables(spark, vectors)
    got = search.top_k_of_type(q, c, "online", 4)
    assert rows(got) == brute_force(vectors, 4, keep=lambda i: i % 3 == 1)


def test_rows_without_vector_are_left_out(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("z", [])], QUESTIONS)
    c = spark.createDataFrame([("x", "t", [1.0, 0.0]), ("y", "t", None), ("z", "t", [])], CHUNKS)
    for size in (1 << 20, 1):
        got = search.top_k(q, c, 2, slice_bytes=size)
        assert [(r["question_id"], r["chunk_id"]) for r in got.collect()] == [("a", "x")]


def test_approximate_search_finds_a_subset_in_bounded_cells(spark, vectors):
    q, c = tables(spark, vectors)
    whole = rows(search.top_k_approximate(q, c, dims=12, k=8, tables=8, bits=3))
    cells = rows(search.top_k_approximate(q, c, dims=12, k=8, tables=8, bits=3, question_block=3, chunk_block=5))
    assert cells == whole
    exact = {(a, c, d) for a, _, c, d in brute_force(vectors, 8)}
    found = {(a, c, d) for a, _, c, d in whole}
    assert len(found & exact) / len(exact) > 0.7
    assert {c for a, _, c, _ in whole if a == "q0"} == {c for a, c, _ in exact if a == "q0"}


def test_fetch_drops_missing_keys(spark):
    keys = spark.createDataFrame([("q", "a"), ("r", "a"), ("q", "zz")], "question_id STRING, chunk_id STRING")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id STRING, content STRING")
    got = sorted((r["question_id"], r["content"]) for r in search.fetch(keys, chunks, ["chunk_id"]).collect())
    assert got == [("q", "A"), ("r", "A")]


def test_neighbours(spark):
    hits = spark.createDataFrame(
        [("q", 1, "a-0"), ("q", 2, "a-2"), ("q", 3, "b"), ("q", 4, "c-5"), ("p", 1, "hn-12-3"), ("p", 2, "hn-12-4")],
        "question_id STRING, rank INT, chunk_id STRING",
    )
    got = {(r["question_id"], r["pos"], r["chunk_id"]) for r in neighbour_ids(hits).collect()}
    # a-1 is wanted by two hits, at its first place; hits themselves and negative indexes are left out.
    assert got == {("q", 3, "a-1"), ("q", 5, "a-3"), ("p", 2, "hn-12-2"), ("p", 5, "hn-12-5")}
    chunks = spark.createDataFrame(
        [("a", 1, "a-1", "text"), ("a", 9, "a-9", "x")], "article_id STRING, chunk_index INT, chunk_id STRING, content STRING"
    )
    found = neighbour_chunks(hits, chunks).collect()
    assert [(r["chunk_id"], r["content"], r["distance"]) for r in found] == [("a-1", "text", None)]


def test_hashed_vectors(spark):
    texts = spark.createDataFrame(
        [(1, "Spark spark joins"), (2, "joins, joins!"), (3, ""), (4, None)], "id INT, content STRING"
    )
    idf = fit_idf(texts)
    assert idf.count() == DIMS and idf.agg(F.max("df")).first()[0] == 2
    got = {r["id"]: np.array(r["embedding"]) for r in vectorise(texts, idf).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and not got[3].any() and not got[4].any()
    assert np.count_nonzero(got[2]) == 1 and np.count_nonzero(got[1]) == 2
    assert got[1] @ got[2] > 0
    rows = sparse_terms(vectorise(texts, idf), "id").collect()
    assert len(rows) == 3


def test_normalise_and_pairs(spark):
    table = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [0.0, 0.0])], "id INT, embedding ARRAY<DOUBLE>")
    unit = normalise_vectors(table)
    assert [r["embedding"] for r in unit.orderBy("id").collect()] == [[0.6, 0.8], [0.8, 0.6], [0.0, 0.0]]
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "left_id INT, right_id INT")
    assert [round(r["similarity"], 6) for r in pair_similarity(pairs, unit, "id").collect()] == [0.96]


def test_chunk_side_is_not_shuffled_before_the_partial_ranking(spark, vectors):
    q, c = tables(spark, vectors)
    plan = search.top_k(q, c, 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.index("WindowGroupLimit") < plan.index("MapInArrow")


def test_few_pairs_are_ordered_once_a_question_has_a_limit(monkeypatch):
    draw = np.random.default_rng(9)
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (draw.normal(size=(n, 16)) for n in (40, 6400))]
    monkeypatch.setattr(search, "TILE", 64)
    ordered, partition = [], np.partition
    monkeypatch.setattr(search.np, "partition", lambda d, *a, **b: ordered.append(d.size) or partition(d, *a, **b))
    best = search._Best(unit[0], 4)
    best.add(np.arange(6400), unit[1])
    assert sum(ordered) <= 0.1 * 40 * 6400
    want = np.argsort(np.round(1 - unit[0] @ unit[1].T, 6), axis=1, kind="stable")[:, :4]
    assert best.ids.reshape(40, 4).tolist() == want.tolist()


def test_memory_of_a_search_is_bounded_by_a_tile():
    """Of every question only its ``k`` rows are held; what is merged is of one tile."""
    draw, peaks = np.random.default_rng(10), []
    rows = draw.normal(size=(12_000, 8))
    ids = np.array([f"chunk-{i}" for i in range(len(rows))])
    for size in (4_000, 32_000):
        best = search._Best(draw.normal(size=(size, 8)), 8)
        tracemalloc.start()
        try:
            best.add(ids, rows)
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] - peaks[0] < 60e6


def test_a_full_slice_of_questions_takes_little_memory():
    draw, dims, k = np.random.default_rng(11), 64, 8
    n = min(search.SLICE_BYTES // (8 * dims), getattr(search, "SLICE_FINDS", 1 << 62) // k)
    questions, rows = draw.normal(size=(n, dims)), draw.normal(size=(4096, dims))
    ids = np.array([f"a{i:07d}-{i % 4}" for i in range(len(rows))])
    best = search._Best(questions, k)
    tracemalloc.start()
    try:
        for a in range(0, len(ids), 2048):
            best.add(ids[a:a + 2048], rows[a:a + 2048])
        for _ in best.found():
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert questions.nbytes + peak < 80e6


def test_slices_are_bounded_by_their_finds_too(spark, vectors, monkeypatch):
    q, c = tables(spark, vectors)
    sizes, scan = [], search._scan
    monkeypatch.setattr(search, "_scan", lambda chunks, ids, *rest: sizes.append(len(ids)) or scan(chunks, ids, *rest))
    assert rows(search.top_k(q, c, 8, slice_finds=100)) == brute_force(vectors, 8)
    assert len(sizes) == 3 and sum(sizes) == 37


def test_questions_without_a_time_see_all_chunks(monkeypatch):
    draw = np.random.default_rng(12)
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (draw.normal(size=(n, 6)) for n in (9, 900))]
    monkeypatch.setattr(search, "TILE", 50)
    asked_at = np.where(np.arange(9) % 3 == 0, np.nan, 450.0)
    best = search._Best(unit[0], 3, asked_at=asked_at)
    best.add(np.arange(900), unit[1], np.arange(900))
    d = np.round(1 - unit[0] @ unit[1].T, 6)
    d[np.arange(9) % 3 != 0, 450:] = np.inf
    assert best.ids.reshape(9, 3).tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()
