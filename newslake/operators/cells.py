"""An inverted file over vectors: chunks stored by cell, searched cell by cell, approximately or exactly.

The centroids are fitted on a bounded sample by grouped aggregation; every chunk is then assigned and stored by its cell. A
question probes its nearest cells. The exact search goes on from there: the k-th best distance so far, and for each
cell the distance of its centroid and its radius, tell by the triangle inequality which other cells can hold a
better chunk; only those are read.

Small cells are read in groups, so that a question moves once for many of them; a task scores each cell of its group
for the questions that want it, and has a bounded number of chunks and questions however many a cell has. No question
passes the driver; centroids do, at most ``MAX_CELLS`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newslake.operators.search import (
    CHAT_HITS,
    CHUNK_BLOCK,
    DISTANCE_DIGITS,
    QUESTION_BLOCK,
    _Best,
    _block,
    _each,
    _emit,
    _filled,
    _ids,
    _matrix,
    _narrow,
    _ranked,
    _result_schema,
)
from newslake.session import materialise

SAMPLE_ROWS = 1 << 18  # chunks the centroids are fitted on, about
MAX_CELLS = 4096
ROUNDS = 3
PROBES = 8
TARGET_RECALL = 0.9
CALIBRATION_ROWS = 1024  # questions that are searched exactly to choose the number of probes
CELL_DISTANCES = 1 << 19  # of rows to centroids that are held at a time
# Distances are compared after rounding, and bounds are floating point.
SLACK = 2 * 10.0 ** -DISTANCE_DIGITS


@dataclass(frozen=True)
class CellIndex:
    """``chunks``: ``chunk_id embedding cell`` stored by cell. The rest is one entry per cell."""

    chunks: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean, of rows to centroids."""
    squared = (rows * rows).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2.0 * rows @ centroids.T
    return np.sqrt(np.maximum(squared, 0.0))


def _blocks(n: int, centroids: np.ndarray) -> Iterator[slice]:
    """``n`` rows in blocks of about ``CELL_DISTANCES`` distances to the centroids."""
    step = max(1, CELL_DISTANCES // max(1, len(centroids)))
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def _cell_sums(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            batch = _filled(batch)
            if batch.num_rows:
                rows = _matrix(batch.column("embedding"))
                cell, _ = _nearest_cell(rows, centroids)
                n += np.bincount(cell, minlength=len(n))
                np.add.at(total, cell, rows)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(n[met]), pa.array(total[met].tolist(), pa.list_(pa.float64()))], ["cell", "n", "total"]
        )

    return add


def fit_centroids(
    vectors: DataFrame, id_column: str, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS
) -> np.ndarray:
    """At most ``cells`` centroids of unit vectors.

    The sample is drawn by the hash of the ids, so it is the same in every run. It starts from the vectors with the
    smallest hashes; then each round adds up the sample's vectors by nearest centroid.
    """
    hashed = _narrow(vectors, id_column).where(F.size("embedding") > 0).select(
        "embedding", F.xxhash64(F.lit(7), F.col(id_column).cast("string")).alias("h")
    )
    n = max(1, vectors.count())
    sample = materialise(hashed.where(F.pmod("h", F.lit(n)) < sample_rows), "sample")
    first = sample.orderBy("h", "embedding").limit(cells).toArrow()
    centroids = _matrix(first["embedding"])
    for _ in range(rounds):
        sums = sample.select("embedding").mapInArrow(_cell_sums(centroids), "cell INT, n BIGINT, total ARRAY<DOUBLE>")
        whole = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
        add = lambda s, t: F.zip_with(s, t, lambda x, y: x + y)
        mean = F.aggregate(F.slice("totals", 2, F.size("totals")), F.element_at("totals", 1), add)
        centroids = centroids.copy()
        for row in whole.select("cell", "n", mean.alias("total")).toLocalIterator():
            centroids[row["cell"]] = np.array(row["total"]) / row["n"]
    return centroids


def _nearest_cell(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of every row, and its distance."""
    cell, away = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    for part in _blocks(len(rows), centroids):
        distance = _distances(rows[part], centroids)
        cell[part] = distance.argmin(axis=1)
        away[part] = distance[np.arange(len(distance)), cell[part]]
    return cell, away


def _assigned(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _filled(batch)
            if batch.num_rows:
                cell, away = _nearest_cell(_matrix(batch.column("embedding")), centroids)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"]
                )

    return assign


def build_cells(chunks: DataFrame, cells: int | None = None, id_column: str = "chunk_id", **fit) -> CellIndex:
    """The index of a chunk table: written once, sorted by cell, read by any number of searches.

    Without ``cells`` their number is the root of the number of chunks.
    """
    narrow = _narrow(chunks, id_column)
    n = chunks.count()
    cells = min(MAX_CELLS, cells or math.ceil(math.sqrt(max(n, 1))))
    centroids = fit_centroids(chunks, id_column, cells, **fit)
    kind, element = (narrow.schema[c].dataType.simpleString() for c in (id_column, "embedding"))
    if not len(centroids):
        empty = chunks.sparkSession.createDataFrame([], f"{id_column} {kind}, embedding {element}, cell INT")
        return CellIndex(empty, np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0))
    placed = narrow.mapInArrow(_assigned(centroids), f"{id_column} {kind}, embedding {element}, cell INT, away DOUBLE")
    by_cell = placed.repartitionByRange("cell", F.xxhash64(F.col(id_column).cast("string"))).sortWithinPartitions("cell")
    stored = materialise(by_cell, "cells")
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for row in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        sizes[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    return CellIndex(stored.drop("away"), centroids, sizes, radii)


def _nearest(away: np.ndarray, sizes: np.ndarray, probes: int, k: int) -> np.ndarray:
    """Which cells each question probes: the nearest ``probes`` with chunks, and on until they hold ``k`` chunks."""
    away = np.where(sizes > 0, away, np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    wanted = (np.arange(away.shape[1]) < probes) | (before < k)
    out = np.zeros(away.shape, dtype=bool)
    np.put_along_axis(out, order, wanted, axis=1)
    return out & (sizes > 0)


def _wanted(
    rows: np.ndarray, reached: np.ndarray | None, index: "_Cells", probes: int, k: int, cells: np.ndarray | None = None
) -> np.ndarray:
    """Which cells, or which of ``cells``, each question reads: its nearest, or with ``reached`` the others that may
    hold a better chunk. Only the answer is held for all questions."""
    out = np.zeros((len(rows), len(index.centroids) if cells is None else len(cells)), dtype=bool)
    for part in _blocks(len(rows), index.centroids):
        found = _wanted_of(rows[part], None if reached is None else reached[part], index, probes, k)
        out[part] = found if cells is None else found[:, cells]
    return out


def _wanted_of(rows: np.ndarray, reached: np.ndarray | None, index: "_Cells", probes: int, k: int) -> np.ndarray:
    away = _distances(rows, index.centroids)
    near = _nearest(away, index.sizes, probes, k)
    if reached is None:
        return near
    reach = np.sqrt(2.0 * (np.where(np.isnan(reached), np.inf, reached) + SLACK))
    return ~near & (index.sizes > 0) & (away - index.radii <= reach[:, None])


@dataclass(frozen=True)
class _Cells:
    """What tasks know of the cells. ``group``: cells that are small lie together in one group of ``chunk_block`` rows."""

    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    group: np.ndarray


def _grouped(index: CellIndex, chunk_block: int) -> np.ndarray:
    """Cells in runs of about ``chunk_block`` chunks, so that a question moves once for many cells."""
    return (np.cumsum(index.sizes) - index.sizes) // chunk_block


def _reached(batch) -> np.ndarray | None:
    names = batch.schema.names
    return np.asarray(batch.column("reached").to_numpy(), dtype=float) if "reached" in names else None


def _probing(cells: _Cells, probes: int, k: int):
    """Rows of questions to a row for each group of cells that they read from."""
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = _filled(whole)
            for a in range(0, whole.num_rows, 1024):
                table = pa.Table.from_batches([whole.slice(a, 1024)])
                wanted = _wanted(_matrix(table["embedding"]), _reached(table), cells, probes, k)
                q, cell = np.nonzero(wanted)
                pairs = np.unique(np.stack([q, cells.group[cell]], axis=1), axis=0)
                if len(pairs):
                    (kept,) = table.take(pa.array(pairs[:, 0])).combine_chunks().to_batches()
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pairs[:, 1], pa.int32())], [*kept.schema.names, "grp"])

    return probe


def _group_search(cells: _Cells, probes: int, k: int, schema: pa.Schema):
    """Questions meet the cells of a group; each cell is scored for the questions that want it."""
    def search(questions: pa.Table, chunks: pa.Table) -> pa.Table:
        questions, chunks = _filled(questions), _filled(chunks)
        if not questions.num_rows or not chunks.num_rows:
            return schema.empty_table()
        asked = _matrix(questions["embedding"])
        best = _Best(asked, k, _reached_limits(questions))
        ids, rows, cell = _ids(chunks["chunk_id"]), _matrix(chunks["embedding"]), chunks["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        met = np.unique(cell)  # those of the group
        wanted = _wanted(asked, _reached(questions), cells, probes, k, met)
        for i, part in enumerate(np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)):
            some = np.flatnonzero(wanted[:, i])
            if len(some):
                best.add(ids[part], rows[part], some=some)
        return pa.Table.from_batches(list(_emit(best, _ids(questions["question_id"]), schema)), schema)

    return search


def _reached_limits(questions: pa.Table) -> np.ndarray | None:
    reached = _reached(questions)
    return None if reached is None else np.where(np.isnan(reached), np.inf, reached)


def _searched(index: CellIndex, questions: DataFrame, k: int, probes: int, question_block: int, chunk_block: int) -> DataFrame:
    """Candidates of the wanted cells. Groups of cells are read by tasks of at most about ``chunk_block`` chunks and
    ``question_block`` questions; a cell that is larger is cut."""
    spark = questions.sparkSession
    cells = _Cells(index.centroids, index.sizes, index.radii, _grouped(index, chunk_block))
    ddl, schema = _result_schema(questions, index.chunks)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in questions.schema)
    probing = materialise(questions.mapInArrow(_probing(cells, probes, k), f"{columns}, grp INT"), "probes")
    held = {}
    for group, n in zip(cells.group.tolist(), index.sizes.tolist()):
        held[group] = held.get(group, 0) + n
    sizes = spark.createDataFrame(
        [(g, -(-n // (2 * chunk_block))) for g, n in held.items() if n], "grp INT, c_blocks INT"
    )
    asked = probing.groupBy("grp").agg(F.ceil(F.count("*") / question_block).cast("int").alias("q_blocks"))
    groups = F.broadcast(materialise(sizes.join(asked, "grp"), "probed"))  # at most MAX_CELLS rows
    group_of = F.element_at(F.lit(cells.group.tolist()), F.col("cell") + 1).cast("int")
    left = probing.join(groups, "grp").withColumns({
        "qb": _block("question_id", F.col("q_blocks")), "cb": _each(F.col("c_blocks")),
    })
    right = index.chunks.withColumn("grp", group_of).join(groups, "grp").withColumns({
        "cb": _block("chunk_id", F.col("c_blocks")), "qb": _each(F.col("q_blocks")),
    })
    key, drop = ["grp", "qb", "cb"], ["q_blocks", "c_blocks"]
    met = left.drop(*drop).groupBy(*key).cogroup(right.drop(*drop).groupBy(*key))
    return met.applyInArrow(_group_search(cells, probes, k, schema), ddl)


def search_cells(
    index: CellIndex,
    questions: DataFrame,
    k: int = CHAT_HITS,
    probes: int = PROBES,
    exact: bool = False,
    question_block: int = QUESTION_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """``(question_id, rank, chunk_id, distance)``: the best of the probed cells, or with ``exact`` of all cells."""
    questions = materialise(_narrow(questions, "question_id"), "questions")
    if not len(index.centroids):
        kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("question_id", questions), ("chunk_id", index.chunks))}
        return questions.sparkSession.createDataFrame(
            [], f"question_id {kinds['question_id']}, rank INT, chunk_id {kinds['chunk_id']}, distance DOUBLE"
        )
    near = _searched(index, questions, k, probes, question_block, chunk_block)
    first = _ranked(near, k)
    if not exact:
        return first
    first = materialise(first, "first-hits")
    reached = first.where(F.col("rank") == k).select("question_id", F.col("distance").alias("reached"))
    asked = questions.join(reached, "question_id", "left")
    more = _searched(index, asked, k, probes, question_block, chunk_block)
    return _ranked(first.drop("rank").unionByName(more), k)


def probes_for(
    index: CellIndex, questions: DataFrame, k: int = CHAT_HITS, target: float = TARGET_RECALL, sample_rows: int = CALIBRATION_ROWS
) -> int:
    """How many nearest cells hold at least ``target`` of the exact hits of a sample of the questions.

    At most about ``sample_rows`` questions, drawn by the hash of their ids, are searched exactly; the share is of
    their hits, and a margin for the sample's own error is added to the target.
    """
    n = max(1, questions.count())
    some = questions.where(F.pmod(F.xxhash64(F.lit(11), F.col("question_id").cast("string")), F.lit(n)) < sample_rows)
    some = materialise(_narrow(some, "question_id"), "calibration")
    hits = search_cells(index, some, k, exact=True).join(index.chunks.select("chunk_id", "cell"), "chunk_id")
    found = hits.join(some, "question_id").select("embedding", "cell").toArrow()  # k rows a question at most
    if not found.num_rows:
        return PROBES
    cell, rows = found["cell"].to_numpy(), _matrix(found["embedding"])
    rank = np.zeros(len(cell), dtype=np.int64)
    for part in _blocks(len(cell), index.centroids):
        away = np.where(index.sizes > 0, _distances(rows[part], index.centroids), np.inf)
        place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
        rank[part] = place[np.arange(len(place)), cell[part]]
    wanted = min(1.0, target + math.sqrt(target * (1 - target) / len(cell)) + 0.01)
    return int(np.quantile(rank, wanted, method="higher")) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(n_wanted, n_found)`` over all questions: hits of an exact search, and those of them that were found."""
    key = ["question_id", "chunk_id"]
    both = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return both.agg(F.count("*").alias("n_wanted"), F.count("hit").alias("n_found"))
