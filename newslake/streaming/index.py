"""Incremental index: every micro-batch of articles is upserted into the chunk table.

The table is Parquet, partitioned by a hash of the article, and any Spark reader can read it. Each micro-batch is
deduped, cut into chunk records and checked against the table: records that it holds unchanged go, and the others
replace or join those of their buckets. Buckets without new records keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from newslake.operators.chunking import chunk_records
from newslake.operators.dedupe import dedupe
from newslake.operators.upsert import BUCKETS, upsert_buckets
from newslake.session import materialise, remove, work_of_a_run


def batch_records(articles: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Deduped chunk records of one micro-batch."""
    return chunk_records(dedupe(articles), F.col(fetched_at))


def start_index(articles: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert each micro-batch into ``table``.

    The source is read once for each batch; what a batch needs on the way is written and goes when it ends. Its new
    buckets are staged under its number next to the checkpoint, so a batch that is run again after a failure, even one
    that had begun to replace buckets, ends in the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = f"{checkpoint}/staged/batch={number}"
        with work_of_a_run(spark, "micro-batch"):
            records = materialise(batch_records(materialise(batch, "landed")), "records")
            upsert_buckets(records, table, buckets=buckets, staged=staged)
        remove(spark, f"{checkpoint}/staged/batch={number - 1}")

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
