"""Text to vectors: hashed, idf-weighted, unit-length term vectors, and operations on vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newslake.functions.once import computed_once
from newslake.functions.vectors import DIMS, dot, term_cells, terms, unit, weigh_terms


def fit_idf(texts: DataFrame, text: str = "content", dims: int = DIMS) -> DataFrame:
    """``(dim, df, idf)``: ``dims`` rows, however large the corpus.

    One scan. Every task sends ``dims`` partial counts and its number of texts, no text and no term.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            cells = np.unique(term_cells(batch.column(0), dims))
            df += np.bincount(cells % dims, minlength=dims)
            n += batch.num_rows
        columns = [np.arange(dims, dtype=np.int32), df, np.full(dims, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "df", "n"])

    partial = texts.select(terms(F.col(text))).mapInArrow(count, "dim INT, df BIGINT, n BIGINT")
    total = partial.groupBy("dim").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return total.select("dim", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def vectorise(texts: DataFrame, idf: DataFrame, text: str = "content", dims: int = DIMS) -> DataFrame:
    """Add ``embedding``: term frequency times idf per dimension, at unit length.

    The model is the idf table, ``dims`` rows at most, and is read to the driver as a Spark ML model would
    be. The texts see one narrow pass: they are cut into terms in the JVM, then hashed, counted and weighted per Arrow batch.
    """
    weights = [0.0] * dims
    for row in idf.select("dim", "idf").collect():
        weights[row["dim"]] = row["idf"]
    return texts.withColumn("embedding", computed_once(weigh_terms(terms(F.col(text)), weights)))


def sparse_terms(vectors: DataFrame, id_column: str) -> DataFrame:
    """``(id, dim, weight)`` of the non-zero components."""
    rows = vectors.select(id_column, F.posexplode("embedding").alias("dim", "weight"))
    return rows.where(F.col("weight") != 0)


def normalise_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, id_column: str) -> DataFrame:
    """``similarity`` (dot product of unit vectors) of each requested pair ``(left_id, right_id)``."""
    left = vectors.select(F.col(id_column).alias("left_id"), F.col("embedding").alias("_left"))
    right = vectors.select(F.col(id_column).alias("right_id"), F.col("embedding").alias("_right"))
    both = pairs.join(left, "left_id").join(right, "right_id")
    return both.withColumn("similarity", dot(F.col("_left"), F.col("_right"))).drop("_left", "_right")
