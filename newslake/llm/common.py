"""What the operators share: reading, row identity, hashing and host names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.session import prepare

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"
KEY = ["_k1", "_k2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def two_hashes(*parts: Column) -> list[Column]:
    """Two 64-bit hashes of ``parts``, null and empty told apart."""
    told = [x for c in parts for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *told).alias(name) for seed, name in zip((17, 4242), KEY)]


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """Adds a key that is the same for repeated rows and differs otherwise.

    Ids may be null or repeated, so no operator relies on them. The key is a function of the row, so a
    task that runs again gets the same one.
    """
    return df.select("*", *two_hashes(*[F.col(c) for c in columns]))


def own_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under names that no operator uses, and those names by the old ones."""
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def under_own_names(
    df: DataFrame, results: list[str], run: Callable[[DataFrame, dict[str, str]], DataFrame]
) -> DataFrame:
    """``run`` on ``df`` under names of its own, so that no column of the input can clash with the operator's; then
    the input's columns under their names and the results. An input column with the name of a result gives way."""
    plain, names = own_names(df)
    out = run(plain, names)
    return out.select(*[F.col(own).alias(c) for c, own in names.items() if c not in results], *results)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def blank_words(c: Column) -> Column:
    """Words between blanks: tab to carriage return, and space."""
    return F.array_remove(F.split(F.translate(c, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def without_lines(lines: str, dropped: str) -> Column:
    """The text of the array column ``lines`` without the positions in ``dropped``; work linear in the lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


BROADCAST_BYTES = 64 << 20


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", column: str = "text"
) -> DataFrame:
    """``doc_id text label`` (or another ``column`` than the text) of the rows of ``docs`` with a label; of several labels of an id the largest counts.

    Labels below ``BROADCAST_BYTES`` by their count are sent to the texts; otherwise both are shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(
        F.max(label).cast("int").alias("label")
    )
    small = 32 * labels.count() <= BROADCAST_BYTES
    return docs.select(doc_id, column).join(F.broadcast(known) if small else known, doc_id)
