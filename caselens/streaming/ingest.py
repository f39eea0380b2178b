"""Streams of rows: deduplication by content, counts by window, and an index kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.scratch import written


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = 4) -> DataFrame:
    """The Parquet table ``name`` in ``folder`` as a stream of its files. ``files_per_batch`` None: all that are there
    make one batch, in which no row is late, so what a backfill gives does not depend on how files part the rows."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{folder}/{name}.parquet*")


def first_by_content(rows: DataFrame, at: str, content: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each content; a repeat within ``delay`` of it is dropped, state older than that is let go."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(content)


def windowed_counts(rows: DataFrame, at: str, keys: list[str], value: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and their sum per window and keys; a window is given out once ``delay`` has passed after its end."""
    grouped = rows.withWatermark(at, delay).groupBy(F.window(at, size), *keys)
    return grouped.agg(F.count("*").alias("rows"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("start"), *keys, "rows", "total")


def drained(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a Parquet table, and reads it: the batch form for tests and
    backfills."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def index_updater(path: str, schema, key: str, content: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the published index at ``path`` (rows of ``schema``): rows whose key is new or whose
    content changed replace the old ones, and counts of each change are appended to ``path``/counts. Readers see the index
    before or after a batch; a batch that runs again after it was published changes nothing."""
    from caselens.operators.incremental import diff, first_per_content, merged
    from caselens.sources import published

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number + 1 <= published.version(spark, path):
            return
        new = written(first_per_content(batch, F.col(key), [F.desc(content)]), "batch")
        old = published.read_published(spark, path, schema)
        changes = diff(old.join(new.select(key), key, "left_semi"), new, key, content)
        counted = changes.groupBy("change").agg(F.count("*").alias("rows"))
        counted = written(counted, "counts")
        rest = old.join(new.select(key), key, "left_anti")
        published.publish(rest.unionByName(merged(old, new, key, content).select(rest.columns)), path, number=number + 1)
        counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return update
