"""Exact centroid clustering by Shallot search, in integers.

A component x becomes floor(scale * x). Each vector carries its centroid, its second-nearest centroid, and two
bounds: one above the distance to the first, one below the distance to every other. A round moves the bounds by the
centroids' steps. A vector whose bounds still part is left alone. Any other one measures its two remembered
centroids, starts from the closer one, and walks that centroid's neighbours in order of distance; by the triangle
inequality none beyond (distance to the start + distance to the second best) can matter, and this ball shrinks
whenever a better second turns up. Bounds are floating point, with slack; whatever they don't rule out is compared in
squared integer distances, ties to the smaller number. So the result is that of the plain search.

Every round is one narrow pass over the vectors: a task writes its vectors with their new state, and ``k`` rows of
sums, which Spark adds up. Only centroids (``k`` rows) pass the driver. Rounds are written to the shared folder and
only the last two exist at a time.

Cases: a vector of another length, or with a component that is null, not finite or at least ``LARGEST`` in size (its
squared distances might not fit a long) is left out. Null and repeated ids are vectors like others; equal hashes are
ordered by components. With fewer vectors than ``k`` there are fewer centroids; an empty table gives an empty result.
The result has the id and the columns of the search; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.llm.common import table
from newslake.session import new_folder, remove

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
LARGEST = 1 << 27  # of an integer component
SLACK = 1e-9
STATE = "integers array<int>, near int, second int, upper double, lower double, distance long"
SUMS = "cluster int, n long, total array<long>"


@dataclass
class Ball:
    """Centroids with their distances to each other, sorted per centroid."""

    centroids: np.ndarray  # k x dims, long
    order: np.ndarray  # k x (k - 1): the others, nearest first
    gap: np.ndarray  # k x (k - 1): their distances
    step: np.ndarray  # how far each centroid has just moved
    others: np.ndarray  # the longest step among the others

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> "Ball":
        k = len(centroids)
        apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).astype(float))
        np.fill_diagonal(apart, -1.0)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        step = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float))
        others = np.array([np.delete(step, j).max(initial=0.0) for j in range(k)])
        return cls(centroids, order, np.take_along_axis(apart, order, axis=1), step, others)

    def squared(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        away = rows - self.centroids[numbers]
        return np.einsum("ij,ij->i", away, away)

    def search(
        self, rows: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The state after the centroids' last step: first and second centroid, and the bounds."""
        if len(self.centroids) == 1:
            return near * 0, near * 0, upper * 0, lower * 0
        near, second = near.copy(), second.copy()
        upper, lower = upper + self.step[near], np.maximum(lower - self.others[near], 0.0)
        bound = np.maximum(lower, self.gap[near, 0] / 2)
        open_ = np.flatnonzero(~(upper * (1 + SLACK) + SLACK < bound))
        exact = self.squared(rows[open_], near[open_])
        upper[open_] = np.sqrt(exact)
        still = ~(upper[open_] * (1 + SLACK) + SLACK < bound[open_])
        at, d1 = open_[still], exact[still]
        if len(at):
            near[at], second[at], upper[at], lower[at] = self._walk(rows[at], near[at], second[at], d1)
        return near, second, upper, lower

    def _walk(self, rows, near, second, d1):
        d2 = self.squared(rows, second)
        swap = (d2 < d1) | ((d2 == d1) & (second < near))
        near, second = np.where(swap, second, near), np.where(swap, near, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, reach = near.copy(), np.sqrt(d1)
        left = np.arange(len(rows))
        for rank in range(self.order.shape[1]):
            inside = self.gap[start[left], rank] * (1 - SLACK) <= reach[left] + np.sqrt(d2[left]) + SLACK
            left = left[inside]
            if not len(left):
                break
            j = self.order[start[left], rank]
            d = self.squared(rows[left], j)
            known = (j == near[left]) | (j == second[left])
            first = ~known & ((d < d1[left]) | ((d == d1[left]) & (j < near[left])))
            second_best = ~known & ~first & ((d < d2[left]) | ((d == d2[left]) & (j < second[left])))
            a, b = left[first], left[second_best]
            second[a], d2[a] = near[a], d1[a]
            near[a], d1[a] = j[first], d[first]
            second[b], d2[b] = j[second_best], d[second_best]
        return near, second, np.sqrt(d1), np.sqrt(d2)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), type=kind))


def _assign(ball: Ball, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round in a task: every vector with its new state, then the sums of its vectors by centroid."""
    k = len(ball.centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, squares = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            rows = _matrix(batch.column("integers"), dims)
            state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "second", "upper", "lower")]
            near, second, upper, lower = ball.search(rows, *state)
            distance = ball.squared(rows, near)
            np.add.at(total, near, rows)
            n += np.bincount(near, minlength=k)
            np.add.at(squares, near, distance)
            nothing = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column("integers"), pa.array(near, pa.int32()), pa.array(second, pa.int32()),
                    pa.array(upper), pa.array(lower), pa.array(distance, pa.int64()), *nothing,
                ],
                [batch.schema.names[0], *STATE_NAMES, *SUM_NAMES],
            )
        met = np.flatnonzero(n)
        if len(met):
            nothing = [pa.nulls(len(met), t) for t in STATE_TYPES]
            total = np.concatenate([total, squares[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(met), id_type), *nothing,
                    pa.array(met, pa.int32()), pa.array(n[met], pa.int64()), _lists(total[met], pa.int64()),
                ],
                [batch.schema.names[0], *STATE_NAMES, *SUM_NAMES],
            )

    return assign


STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]
STATE_TYPES = [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
SUM_NAMES = [part.split()[0] for part in SUMS.split(", ")]


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """``vec_id integers`` of the vectors that count."""
    e = F.col(embedding)
    inside = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    kept = vectors.select(vec_id, embedding).where((F.size(e) == dims) & inside)
    return kept.select(
        vec_id, F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("integers")
    )


def first_centroids(integers: DataFrame, vec_id: str, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest digests of their ids, in that order: ``k`` rows."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    rows = integers.select(digest.alias("digest"), "integers").orderBy("digest", "integers").limit(k).collect()
    return np.array([r["integers"] for r in rows], dtype=np.int64)


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and sums by centroid, added up in Spark."""
    rows = state.where("cluster IS NOT NULL")
    n = rows.groupBy("cluster").agg(F.sum("n").alias("n"))
    total = rows.select("cluster", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    lists = total.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("total"))
    return {r["cluster"]: (r["n"], [x["x"] for x in r["total"]]) for r in n.join(lists, "cluster").collect()}


def _moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Floors of the means; an empty centroid stays."""
    out = centroids.copy()
    for j, (n, total) in sums.items():
        out[j] = [x // n for x in total[:-1]]
    return out


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    dims: int = DIMS,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """``vec_id cluster distance cluster_inertia inertia centroid centroid_sha256`` of every vector that counts."""
    spark = vectors.sparkSession
    folders: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        folders.append(new_folder(spark, "vectors"))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    state = written(integer_vectors(vectors, vec_id, embedding, dims, scale))
    kind = state.schema[vec_id].dataType.simpleString()
    centroids = first_centroids(state, vec_id, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{vec_id} {kind}, {RESULT}")
    blank = [F.lit(0), F.lit(min(1, len(centroids) - 1)), F.lit(float("inf")), F.lit(0.0)]
    state = state.select("*", *[c.alias(name) for c, name in zip(blank, STATE_NAMES[1:5])])
    before = None
    for _ in range(rounds + 1):
        ball = Ball.of(centroids, before)
        columns = [vec_id, *STATE_NAMES[:5]]
        state = written(state.select(*columns).mapInArrow(_assign(ball, dims), f"{vec_id} {kind}, {STATE}, {SUMS}"))
        remove(spark, folders.pop(0))
        sums = _sums(state)
        before, centroids = centroids, _moved(centroids, sums)
        state = state.where("integers IS NOT NULL")
    return _reported(spark, state.select(vec_id, F.col("near").alias("cluster"), "distance"), before, sums)


RESULT = (
    "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
)


def _reported(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray, sums: dict) -> DataFrame:
    """``assigned`` with what holds for its cluster: a table of ``k`` rows."""
    inertia = sum(total[-1] for _, total in sums.values())
    rows = [
        (
            j, total[-1], inertia, centroids[j].tolist(),
            hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest(),
        )
        for j, (_, total) in sums.items()
    ]
    of = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    )
    names = [c for c in assigned.columns if c != "cluster"]
    return assigned.join(F.broadcast(of), "cluster").select(names[0], "cluster", *names[1:], *of.columns[1:])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql(rounds: int = ROUNDS) -> str:
    parts = [
        f"""v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE len(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS j, c FROM v
  ORDER BY sha256('{SEED}' || vec_id) LIMIT {CENTROIDS}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
  SELECT vec_id, v.c, j, list_sum(list_transform(list_zip(v.c, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v CROSS JOIN c{i} m
), a{i} AS MATERIALIZED (
  SELECT vec_id, c, j, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT m.j, coalesce(t.c, m.c) AS c
  FROM c{i} m LEFT JOIN (
    SELECT j, list(x ORDER BY pos) AS c
    FROM (SELECT j, pos, floor(sum(c[pos])::DOUBLE / count(*))::BIGINT AS x
          FROM a{i}, range(1, {DIMS + 1}) AS r(pos) GROUP BY j, pos)
    GROUP BY j
  ) t ON t.j = m.j
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.j = a.j
"""


SQL = _sql()
