from __future__ import annotations

import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newslake.operators import upsert
from newslake.schemas import article_columns
from newslake.streaming import fresh, index, trending

START = datetime(2024, 1, 1)
ARTICLE = "article_id STRING, date TIMESTAMP, tag STRING"


def write_files(spark, path, batches, schema=ARTICLE):
    """One file per batch, in order of modification."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def day(n, hours=0):
    return START + timedelta(days=n, hours=hours)


def test_fresh_articles_once_and_late_ones_dropped(spark, tmp_path):
    path = write_files(spark, tmp_path / "in", [
        [("a", day(0), "x"), ("b", day(1), "x"), ("a", day(0, 1), "x")],
        [("a", day(2), "x"), ("c", day(20), "x")],
        [("c", day(20, 1), "x")],
        # The watermark stands at day 13 and has been applied: d is too old, e is in time, a may come again.
        [("d", day(5), "x"), ("e", day(14), "x"), ("a", day(21), "x")],
    ])
    schema = spark.read.parquet(path).schema
    stream = fresh.fresh_stream(fresh.file_stream(spark, path, schema, files_per_trigger=1))
    fresh.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(r["article_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a", "a", "b", "c", "e"]
    # A second run continues from the state and finds nothing new.
    fresh.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_trending_equals_the_batch_twin_over_closed_windows(spark, tmp_path):
    batches = [[(str(i), day(b * 5 + i % 5, i), "x" if i % 3 else "y") for i in range(20)] for b in range(3)]
    path = write_files(spark, tmp_path / "in", batches)
    rows = spark.read.parquet(path)
    stream = trending.trending_stream(fresh.file_stream(spark, path, rows.schema, files_per_trigger=1), "date", "tag")
    fresh.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    last = rows.agg(F.max("date").alias("d")).scalar()
    twin = trending.trending_counts(rows, "date", "tag").where(F.col("window_end") <= last - F.expr("INTERVAL 1 DAY"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in twin.collect()} and got


RAW = "seq BIGINT, url STRING, source STRING, title STRING, content STRING, fetched_at TIMESTAMP"


def test_index_upserts_every_batch(spark, tmp_path):
    path = write_files(spark, tmp_path / "in", [
        [(1, "u1", "s", "a", "first version", day(0)), (2, "u1", "s", "b", "copy by url", day(0)), (3, "u2", "s", "c", "other", day(0))],
        [(4, "u1", "s", "a", "second version", day(1))],
    ], RAW)
    stream = fresh.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    columns = article_columns(
        article_id=F.md5("url"), title=F.col("title"), source=F.col("source"), content=F.col("content"), url=F.col("url"), type=F.lit("online")
    )
    articles = stream.select("seq", *columns, "fetched_at")
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    index.start_index(articles, table, state).awaitTermination()
    got = {r["url"]: (r["content"], r["fetched_at"]) for r in upsert.read_buckets(spark, table).collect()}
    assert got == {"u1": ("second version", day(1)), "u2": ("other", day(0))}
    index.start_index(articles, table, state).awaitTermination()
    assert upsert.read_buckets(spark, table).count() == 2
    # An article that is known as it is touches nothing; one that changed replaces its chunks.
    files = sorted(spark.read.parquet(table).inputFiles())
    write_files(spark, tmp_path / "in", [[(6, "u1", "s", "a", "second version", day(1))]], RAW)
    index.start_index(articles, table, state).awaitTermination()
    assert sorted(spark.read.parquet(table).inputFiles()) == files
    write_files(spark, tmp_path / "in", [[(5, "u2", "s", "c", "changed later", day(2))]], RAW)
    index.start_index(articles, table, state).awaitTermination()
    got = {r["url"]: r["content"] for r in upsert.read_buckets(spark, table).collect()}
    assert got == {"u1": "second version", "u2": "changed later"}


def test_a_batch_that_failed_while_buckets_were_replaced_is_repeated(spark, tmp_path):
    schema = "chunk_id STRING, article_id STRING, content STRING, fetched_at TIMESTAMP"
    first = [(f"a{i}-0", f"a{i}", "old", day(0)) for i in range(40)]
    table, staged = str(tmp_path / "table"), str(tmp_path / "staged")
    upsert.upsert_buckets(spark.createDataFrame(first, schema), table, buckets=8)
    updates = spark.createDataFrame([(f"a{i}-0", f"a{i}", "new", day(1)) for i in range(3)], schema)
    touched = upsert.upsert_buckets(updates, table, buckets=8, staged=staged)
    shutil.rmtree(f"{table}/bucket={touched[0]}")  # as if the run had ended between two buckets
    assert upsert.upsert_buckets(updates, table, buckets=8, staged=staged) == touched
    got = {r["article_id"]: r["content"] for r in upsert.read_buckets(spark, table).collect()}
    assert got == {f"a{i}": "new" if i < 3 else "old" for i in range(40)}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    schema = "chunk_id STRING, article_id STRING, content STRING, fetched_at TIMESTAMP"
    rows = [(f"a{i}-{j}", f"a{i}", "old", day(0)) for i in range(60) for j in range(2)]
    table = str(tmp_path / "table")
    upsert.upsert_buckets(spark.createDataFrame(rows, schema), table, buckets=16)
    before = set(spark.read.parquet(table).inputFiles())
    updates = spark.createDataFrame([("a1-0", "a1", "new", day(1)), ("a1-9", "a1", "more", day(1)), ("a1-0", "a1", "late", day(0))], schema)
    (bucket,) = upsert.upsert_buckets(updates, table, buckets=16)
    after = set(spark.read.parquet(table).inputFiles())
    assert {f for f in before | after if f not in before & after} and all(f"bucket={bucket}/" in f for f in before ^ after)
    assert upsert.upsert_buckets(updates.where("content != 'late'"), table, buckets=16) == []
    assert set(spark.read.parquet(table).inputFiles()) == after
    got = {r["chunk_id"]: r["content"] for r in upsert.read_buckets(spark, table).collect()}
    assert got == {r[0]: "old" for r in rows} | {"a1-0": "new", "a1-9": "more"}
    scan = spark.read.parquet(table).where(F.col("bucket").isin([bucket]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or f"(bucket#" in scan


def test_updates_are_made_few_times(spark, tmp_path):
    """An upsert reads its updates for the buckets' numbers and for the records, whatever it does with them."""
    schema = "chunk_id STRING, article_id STRING, content STRING, fetched_at TIMESTAMP"
    when = datetime(2024, 6, 1)
    rows = [(f"a{i}-0", f"a{i}", f"text {i}", when) for i in range(40)]
    table = str(tmp_path / "table")
    upsert.upsert_buckets(spark.createDataFrame(rows, schema), table, buckets=4)
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    changed = spark.createDataFrame([(c, a, t + " again", w) for c, a, t, w in rows[::2]], schema)
    assert upsert.upsert_buckets(changed.mapInArrow(seen, schema), table, buckets=4) == [0, 1, 2, 3]
    assert made.value <= 2 * 20
    got = {r["chunk_id"]: r["content"] for r in upsert.read_buckets(spark, table).collect()}
    assert got == {f"a{i}-0": f"text {i}" + " again" * (i % 2 == 0) for i in range(40)}
