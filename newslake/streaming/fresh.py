"""Stream of fresh articles: each id once within the freshness window, late ones dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over parquet files; ``path`` may be a folder, a file or a glob pattern."""
    if "*" not in path and "[" not in path:
        # A pattern that matches the path itself: the source takes no single file by its plain name.
        path = path[:-1] + f"[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def fresh_stream(articles: DataFrame, window: str = "7 days", key: str = "article_id", time: str = "date") -> DataFrame:
    """First arrival of every id; state is dropped when the window has passed."""
    return articles.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available into parquet files, exactly once, and return the finished query."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
