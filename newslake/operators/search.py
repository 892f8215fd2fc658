"""Nearest chunks for a whole table of questions.

Vectors are scored as matrix products over Arrow batches and only the ``k`` best per question leave a
task: no pair of question and chunk ever becomes a row. Ranks are by cosine distance rounded to
``DISTANCE_DIGITS`` digits, then by chunk id, so they do not depend on summation order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newslake.operators.ranking import first_per_group
from newslake.session import materialise

DISTANCE_DIGITS = 6
SLICE_BYTES = 16 << 20  # of question vectors that the driver and every task hold at a time
SLICE_FINDS = 1 << 18  # rows of questions of a slice that a task holds, about
QUESTION_BLOCK = 16_384
CHUNK_BLOCK = 16_384
TILE = 1024
SCORED_CELLS = 1 << 19  # of pairs of vectors that are scored at a time
# Over the error of a product of unit vectors in single precision (dimensions * 2^-24) and the rounding of a distance.
SCREEN_SLACK = 1e-3

# Result sizes of the searches.
CHAT_HITS = 8
ONLINE_HITS = 4
HISTORY_HITS = 3


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Row vectors at unit length; zero vectors stay zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _Best:
    """The ``k`` best chunks per question seen so far.

    Questions lie in tiles of their own, each with its finds, so that what a merge sorts is bounded by a tile. Once a
    question has a limit, products in single precision, less their largest error, tell which chunks can be within it;
    only those are scored in double precision.
    """

    def __init__(
        self, questions: np.ndarray, k: int, bounds: np.ndarray | None = None, asked_at: np.ndarray | None = None
    ):
        """``bounds``: distances that the k-th best of each question is known not to exceed. ``asked_at``: times, for
        chunks that come with the time they were stored at; a question sees those stored before it."""
        self.questions, self.k, self.asked_at = questions, k, asked_at
        self.limit = np.full(len(questions), np.inf) if bounds is None else bounds.copy()
        self.size = TILE
        tiles = range(-(-len(questions) // self.size))
        self.held: list[tuple[np.ndarray, ...] | None] = [None for _ in tiles]
        self.pending: list[list[tuple[np.ndarray, ...]]] = [[] for _ in tiles]

    def add(
        self, ids: np.ndarray, rows: np.ndarray, stored_at: np.ndarray | None = None, some: np.ndarray | None = None
    ) -> None:
        """Score rows for all questions, or for ``some`` of them, in order."""
        by = np.argsort(ids, kind="stable")
        ids, rows = ids[by], rows[by]
        stored_at = None if stored_at is None else stored_at[by]
        rough = rows.astype(np.float32)
        some = np.arange(len(self.questions)) if some is None else some
        for part in np.split(some, np.flatnonzero(np.diff(some // self.size)) + 1):
            if not len(part):
                continue
            whole = len(part) == part[-1] + 1 - part[0]  # then the questions are seen in place
            t, asked = part[0] // self.size, self.questions[part[0]:part[-1] + 1] if whole else self.questions[part]
            rough_asked = asked.astype(np.float32)
            for a in range(0, len(ids), TILE):
                cut = slice(a, a + TILE)
                times = None if stored_at is None else stored_at[cut]
                found = self._tile(part, asked, rough_asked, ids[cut], rows[cut], rough[cut], times)
                if len(found[0]):
                    self.pending[t].append(found)
                if sum(len(f[0]) for f in self.pending[t]) > self.k * self.size:
                    self._merge(t)

    def _merge(self, t: int) -> None:
        """Finds of a tile of questions, cut to the best."""
        if not self.pending[t]:
            return
        parts = self.pending[t] if self.held[t] is None else [self.held[t], *self.pending[t]]
        q, distance, ids = (np.concatenate(column) for column in zip(*parts))
        by = np.lexsort((ids, distance, q))
        first = np.searchsorted(q[by], q[by], side="left")
        by = by[np.arange(len(by)) - first < self.k]
        q, distance, ids = q[by], distance[by], ids[by]
        start = t * self.size
        full = np.bincount(q - start, minlength=min(self.size, len(self.limit) - start)) == self.k
        last = np.searchsorted(q, start + np.flatnonzero(full), side="right") - 1
        at = start + np.flatnonzero(full)
        self.limit[at] = np.minimum(self.limit[at], distance[last])
        self.held[t], self.pending[t] = (q, distance, ids), []

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Question, distance and id of the best, a tile of questions at a time."""
        for t in range(len(self.held)):
            self._merge(t)
            if self.held[t] is not None:
                yield self.held[t]

    def _column(self, i: int) -> np.ndarray | None:
        parts = [part[i] for part in self.found()]
        return np.concatenate(parts) if parts else None

    q, distance, ids = (property(lambda self, i=i: self._column(i)) for i in range(3))

    def _tile(
        self,
        some: np.ndarray,
        asked: np.ndarray,
        rough_asked: np.ndarray,
        ids: np.ndarray,
        rows: np.ndarray,
        rough: np.ndarray,
        stored_at: np.ndarray | None,
    ) -> tuple[np.ndarray, ...]:
        """Rows that may enter the best of a question; ties at the edge go to the lowest ids."""
        limit, few = self.limit[some], 8 * self.k * len(some)
        if stored_at is not None and stored_at.max() < np.fmin.reduce(self.asked_at[some]):
            stored_at = None  # all were stored before
        if not np.isinf(limit).all():
            near = rough_asked @ rough.T >= (1.0 - limit - SCREEN_SLACK).astype(np.float32)[:, None]
            if stored_at is not None and np.count_nonzero(near) > few:
                near &= ~(stored_at >= self.asked_at[some, None])  # without a time, a question sees all
            if np.count_nonzero(near) <= few:
                q, c = np.divmod(np.flatnonzero(near), len(ids))
                if stored_at is not None:
                    before = ~(stored_at[c] >= self.asked_at[some[q]])
                    q, c = q[before], c[before]
                d = np.empty(len(q))
                step = max(1, SCORED_CELLS // rows.shape[1])
                for a in range(0, len(q), step):
                    one, two = asked[q[a:a + step]], rows[c[a:a + step]]
                    d[a:a + step] = np.round(1.0 - np.einsum("ij,ij->i", one, two), DISTANCE_DIGITS) + 0.0
                kept = d <= limit[q]
                return some[q[kept]], d[kept], ids[c[kept]]
        d = asked @ rows.T
        np.round(np.subtract(1.0, d, out=d), DISTANCE_DIGITS, out=d)
        d += 0.0
        if stored_at is not None:
            d[stored_at >= self.asked_at[some, None]] = np.inf
        if d.shape[1] >= self.k:
            limit = np.fmin(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            self.limit[some] = limit
        below = d <= limit[:, None]
        if below.sum() > 4 * self.k * len(d):
            tie = d == limit[:, None]
            below &= ~tie | (np.cumsum(tie, axis=1, dtype=np.int32) <= self.k)
        q, c = np.nonzero(below & np.isfinite(d))
        return some[q], d[q, c], ids[c]


def _emit(best: _Best, question_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for q, distance, ids in best.found():
        columns = [question_ids[q], ids, distance]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.tolist(), type=f.type) for c, f in zip(columns, schema)], schema=schema
        )


def _result_schema(questions: DataFrame, chunks: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    q, c = questions.schema["question_id"].dataType, chunks.schema["chunk_id"].dataType
    ddl = f"question_id {q.simpleString()}, chunk_id {c.simpleString()}, distance double"
    return ddl, pa.schema([
        ("question_id", to_arrow_type(q)), ("chunk_id", to_arrow_type(c)), ("distance", pa.float64()),
    ])


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = [F.col("distance"), F.col("chunk_id")]
    return first_per_group(candidates, ["question_id"], order, k, rank="rank").select(
        "question_id", "rank", "chunk_id", "distance"
    )


def _narrow(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(id_column, "embedding")


def _filled(batch):
    """Rows with a vector. Done here, as a Spark filter would evaluate a computed vector a second time."""
    return batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch["embedding"]), 0), 0))


def _part(df: DataFrame, id_column: str, parts: int, k: int) -> DataFrame:
    return df.where(_block(id_column, F.lit(parts)) == k) if parts > 1 else df


def top_k(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = CHAT_HITS,
    slice_bytes: int = SLICE_BYTES,
    bound_parts: int | None = None,
    slice_finds: int = SLICE_FINDS,
) -> DataFrame:
    """``(question_id, rank, chunk_id, distance)``: the exact ``k`` nearest chunks of every question.

    The questions are written once and taken in slices of about ``slice_bytes`` of vectors, by their size on record,
    and ``slice_finds`` rows of results; each slice is sent to the tasks that scan the chunks, and no chunk is ever
    shuffled. Where there are several slices, the vectors of the chunks are written once and scanned from there. A task
    emits at most ``k`` rows per question. Where the chunks have very many splits, ``bound_parts`` cuts that down: any ``k`` distances
    bound the k-th best from above, so a first scan over one part in so many of the chunks gives bounds, and the
    second emits only rows within them. The result is the same.
    """
    questions, chunks = _narrow(questions, "question_id"), _narrow(chunks, "chunk_id")
    ddl, schema = _result_schema(questions, chunks)
    questions = materialise(questions, "questions")
    n, dims = questions.agg(F.count("*"), F.max(F.size("embedding"))).first()
    slices = max(1, -(-n * 8 * max(dims or 0, 1) // slice_bytes), -(-n * k // slice_finds))
    chunks = materialise(chunks, "chunks") if slices > 1 else chunks
    found = None
    for i in range(slices):
        part = _filled(_part(questions, "question_id", slices, i).toArrow())
        ids, matrix = _ids(part["question_id"]), _matrix(part["embedding"])
        bounds = None
        if bound_parts and len(ids):
            some = _scan(_part(chunks, "chunk_id", bound_parts, 0), ids, matrix, None, k, ddl, schema)
            reached = _ranked(some, k).where(F.col("rank") == k).select("question_id", "distance").toArrow()
            of = dict(zip(_ids(reached["question_id"]).tolist(), reached["distance"].to_pylist()))
            bounds = np.array([of.get(x, np.inf) for x in ids.tolist()])
        scanned = _scan(chunks, ids, matrix, bounds, k, ddl, schema)
        found = scanned if found is None else found.unionByName(scanned)
    return _ranked(found, k)


def _scan(
    chunks: DataFrame, ids: np.ndarray, matrix: np.ndarray, bounds: np.ndarray | None, k: int, ddl: str, schema: pa.Schema
) -> DataFrame:
    """Candidates of each task for one slice of the questions."""
    sent = chunks.sparkSession.sparkContext.broadcast((ids, matrix, bounds))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, vectors, limits = sent.value
        best = _Best(vectors, k, limits)
        for batch in batches:
            batch = _filled(batch)
            if batch.num_rows and len(question_ids):
                best.add(_ids(batch.column("chunk_id")), _matrix(batch.column("embedding")))
        yield from _emit(best, question_ids, schema)

    return chunks.mapInArrow(scan, ddl)


def _cell_search(k: int, schema: pa.Schema):
    def search(questions: pa.Table, chunks: pa.Table) -> pa.Table:
        questions, chunks = _filled(questions), _filled(chunks)
        if not questions.num_rows or not chunks.num_rows:
            return schema.empty_table()
        best = _Best(_matrix(questions["embedding"]), k)
        best.add(_ids(chunks["chunk_id"]), _matrix(chunks["embedding"]))
        return pa.Table.from_batches(list(_emit(best, _ids(questions["question_id"]), schema)), schema)

    return search


def _met(questions: DataFrame, chunks: DataFrame, cell: list[str], k: int) -> DataFrame:
    """Score the questions and chunks of each cell. The caller bounds the cells."""
    ddl, schema = _result_schema(questions, chunks)
    return questions.groupBy(*cell).cogroup(chunks.groupBy(*cell)).applyInArrow(_cell_search(k, schema), ddl)


def _block(id_column: str, blocks) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column).cast("string")), blocks).cast("int")


def _each(blocks) -> Column:
    return F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))


def top_k_of_type(questions: DataFrame, chunks: DataFrame, kind: str, k: int, **tuning) -> DataFrame:
    """As ``top_k`` over the chunks of one type; the filter reaches the scan before any scoring."""
    return top_k(questions, chunks.where(F.col("type") == kind), k, **tuning)


def plane_sign(table: int, bit: int, dim: int) -> float:
    """Component of a random +-1 hyperplane, by rule, so that every engine can rebuild it."""
    return 1.0 if hashlib.md5(f"{table}:{bit}:{dim}".encode()).hexdigest()[0] < "8" else -1.0


def with_buckets(vectors: DataFrame, id_column: str, dims: int, tables: int, bits: int) -> DataFrame:
    """One row per vector and hash table: ``bucket`` holds the sides of ``bits`` random hyperplanes."""
    planes = np.array(
        [[plane_sign(t, b, j) for j in range(dims)] for t in range(tables) for b in range(bits)]
    )
    weights = 2 ** np.arange(bits)
    kind = vectors.schema[id_column].dataType.simpleString()

    def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _filled(batch)
            if not batch.num_rows:
                continue
            side = (_matrix(batch.column("embedding")) @ planes.T >= 0).reshape(batch.num_rows, tables, bits)
            buckets = (side * weights).sum(axis=2).astype(np.int32)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "buckets"])

    kept = _narrow(vectors, id_column)
    element = kept.schema["embedding"].dataType.simpleString()
    hashed = kept.mapInArrow(hash_batches, f"{id_column} {kind}, embedding {element}, buckets array<int>")
    return hashed.select(id_column, "embedding", F.posexplode("buckets").alias("tab", "bucket"))


def top_k_approximate(
    questions: DataFrame,
    chunks: DataFrame,
    dims: int,
    k: int = CHAT_HITS,
    tables: int = 8,
    bits: int = 6,
    question_block: int = QUESTION_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """Nearest chunks among those that share a hash bucket with the question in any table.

    A bucket that holds many rows, of either side, is cut into cells of bounded size, and each cell sends
    only the ``k`` best per question. The bucket counts have at most ``tables * 2 ** bits`` rows.
    """
    left = with_buckets(questions, "question_id", dims, tables, bits)
    right = with_buckets(chunks, "chunk_id", dims, tables, bits)
    key = ["tab", "bucket"]
    q_cells = left.groupBy(*key).agg(F.ceil(F.count("*") / question_block).alias("q_blocks"))
    c_cells = right.groupBy(*key).agg(F.ceil(F.count("*") / chunk_block).alias("c_blocks"))
    cells = F.broadcast(q_cells.join(c_cells, key))
    left = left.join(cells, key).withColumn("qb", _block("question_id", F.col("q_blocks"))).withColumn(
        "cb", _each(F.col("c_blocks"))
    )
    right = right.join(cells, key).withColumn("cb", _block("chunk_id", F.col("c_blocks"))).withColumn(
        "qb", _each(F.col("q_blocks"))
    )
    drop = ("q_blocks", "c_blocks")
    found = _met(left.drop(*drop), right.drop(*drop), [*key, "qb", "cb"], k)
    # A chunk may be found in several tables.
    return _ranked(found.groupBy("question_id", "chunk_id").agg(F.min("distance").alias("distance")), k)


def fetch(keys: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with the columns of their chunks; keys without a chunk are silently absent.

    The large side meets each wanted key once, so a chunk that many questions want is moved once.
    """
    found = chunks.join(keys.select(*on).distinct(), on, "left_semi")
    return keys.join(found, on)
