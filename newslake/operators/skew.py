"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 1000  # a key is hot above 1/1000 of the rows, so at most 1000 keys can be hot
HOT_FLOOR = 100_000  # and only if it has at least this many rows
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int, floor: int = HOT_FLOOR) -> DataFrame:
    """Keys with more than ``total / HOT_SHARE`` rows: fewer than ``HOT_SHARE``, whatever the data."""
    return counts.where((F.col(n) > total / HOT_SHARE) & (F.col(n) >= floor)).select(key, F.lit(True).alias("_hot"))


def anti_join_salted(
    left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, salts: int = SALTS
) -> DataFrame:
    """Rows of ``left`` whose ``key`` is not in ``right``.

    Rows of a hot key are spread over ``salts`` join keys by ``spread``; the few hot rows of ``right``
    are repeated to match. Broadcasting ``hot`` is safe by its bound.
    """
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = (
        right.select(key).join(F.broadcast(hot), key, "left").select(key, F.explode(every).alias("_salt"))
    )
    return salted_left.join(salted_right, [key, "_salt"], "left_anti").drop("_salt")
