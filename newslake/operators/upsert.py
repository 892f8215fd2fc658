"""Upsert of chunk records by id: the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.operators.ranking import first_per_group
from newslake.session import exists, materialise, new_folder, remove, work_of_a_run

BUCKETS = 64  # of a chunk table; a bucket should be a few GB


def latest_per_chunk(updates: DataFrame, order: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """Last record per chunk id within one batch; copies are cut down before the shuffle."""
    newest = [F.col(c).desc() for c in order]
    return first_per_group(updates, ["chunk_id"], newest, 1, rank="_rank").drop("_rank")


def upsert_chunks(
    existing: DataFrame,
    updates: DataFrame,
    order: tuple[str, ...] = ("fetched_at",),
    replace_articles: bool = False,
) -> DataFrame:
    """``existing`` with ``updates`` inserted or put in place of records of the same id.

    Existing rows are only filtered against the ids of the batch, never sorted or regrouped. Chunks beyond
    the end of an article that became shorter stay, unless ``replace_articles`` is set.
    """
    batch = latest_per_chunk(updates, order)
    key = "article_id" if replace_articles else "chunk_id"
    kept = existing.join(batch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(batch)


def write_snapshot(chunks: DataFrame, table: str) -> str:
    """Write a whole new snapshot below ``table`` and return its path.

    Files are grouped by ``type``, the column that searches filter on. The snapshot being read is never
    overwritten; a reader moves on by opening the new path.
    """
    folder = new_folder(chunks.sparkSession, "snapshot").rsplit("/", 1)[1]
    path = f"{table.rstrip('/')}/{folder}"
    chunks.write.partitionBy("type").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_bucket(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, a hash of ``article_id``: all chunks of an article share one."""
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(buckets)).cast("int"))


def read_buckets(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table)


def unchanged_left_out(updates: DataFrame, table: DataFrame) -> DataFrame:
    """Records that the table doesn't hold as they are. Only ids and digests of the table's touched buckets move.

    The digests are compared, not joined on, so updates that lie by chunk id do not move either.
    """
    columns = sorted(c for c in updates.columns if c in table.columns)
    digest = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]).alias("_digest")
    new, held = updates.select("*", digest).alias("new"), table.select("chunk_id", digest).alias("held")
    same = F.col("new._digest").bitwiseXOR(F.col("held._digest")) == 0
    left = new.join(held, (F.col("new.chunk_id") == F.col("held.chunk_id")) & same, "left_anti")
    return left.drop("_digest").select(*updates.columns)


def upsert_buckets(
    updates: DataFrame,
    table: str,
    order: tuple[str, ...] = ("fetched_at",),
    buckets: int = BUCKETS,
    staged: str | None = None,
) -> list[int]:
    """Upsert into a chunk table of Parquet files partitioned by ``bucket``; returns the buckets it rewrote.

    Only buckets of articles in ``updates`` are read and, by dynamic partition overwrite, replaced; the files of all
    others stay. Records that the table holds unchanged are left out first, so the same updates again touch nothing.
    The new buckets are written to ``staged`` and then put in place: a run that failed in between goes on from
    there, so a folder for each set of updates makes the upsert repeatable at any point.
    """
    spark = updates.sparkSession
    own = staged is None
    staged = staged or new_folder(spark, "buckets")
    if not exists(spark, f"{staged}/_SUCCESS"):
        batch = with_bucket(latest_per_chunk(updates, order), buckets)
        with work_of_a_run(spark, "upsert"):
            if exists(spark, table):
                ids = with_bucket(updates.select("article_id"), buckets)
                named = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
                held = read_buckets(spark, table).where(F.col("bucket").isin(named))
                batch = materialise(unchanged_left_out(batch, held), "changed")  # read three times
                touched = F.broadcast(batch.select("bucket").distinct())
                kept = held.join(touched, "bucket", "left_semi").join(batch.select("chunk_id"), "chunk_id", "left_anti")
                batch = kept.select(*batch.columns).unionByName(batch)
            batch.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    merged = spark.read.schema(with_bucket(updates, buckets).schema).parquet(staged)
    touched = sorted(r["bucket"] for r in merged.select("bucket").distinct().collect())
    if touched:
        # The staged files hold a bucket each, so no row has to move again.
        by_bucket = merged.write.mode("overwrite").partitionBy("bucket")
        by_bucket.option("partitionOverwriteMode", "dynamic").parquet(table)
    if own:
        remove(spark, staged)
    return touched
