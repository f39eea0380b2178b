"""What several operators share: scratch tables in the cluster's shared folder and distributed running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.scratch import scratch_path, shared_dir, written

__all__ = ["block_starts", "bounded_batches", "bucket_count", "keep_rows", "running_total", "scratch_path", "shared_dir", "written"]

#: Blocks that one super-block of ``running_total`` holds.
BLOCKS_PER_SUPER = 512
#: The setting of the rows of an Arrow batch, and its default.
BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the rows of an Arrow batch for the session, and so what a Python worker holds of long texts and their results at a
    time; a session in which the caller has set it is left as it is. A batch's bytes alone (64 MB) are not enough: Python's
    texts and what is made of them take several times these."""
    if spark.conf.get(BATCH_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, str(rows))


def bucket_count(rows: int, per_bucket: int = 1024) -> int:
    """Buckets that keep about ``per_bucket`` rows each, however many rows there are."""
    return max(1, -(-rows // per_bucket))


def block_starts(blocks: DataFrame, part: list[str], block: str, value: str, out: str, levels: int = 3) -> DataFrame:
    """For rows (``part``, ``block``, ``value``), one per block and none null, adds ``out``: the sum of ``value`` over the
    lower blocks of the same ``part``. Blocks lie in super-blocks, and these in larger ones, over ``levels`` levels: a
    window holds ``BLOCKS_PER_SUPER`` rows, or those of the highest level. ``blocks`` is read at each level, so it is best
    a written table. An empty table stays empty."""
    before = (Window.unboundedPreceding, -1)
    if levels == 1:
        over = Window.partitionBy(*(part or [F.lit(0)])).orderBy(block).rowsBetween(*before)
        return blocks.withColumn(out, F.coalesce(F.sum(value).over(over), F.lit(0)))
    sup, base = f"_super{levels}", f"_base{levels}"
    blocks = blocks.withColumn(sup, F.floor(F.col(block) / BLOCKS_PER_SUPER))
    supers = blocks.groupBy(*part, sup).agg(F.sum(value).alias("_sum"))
    supers = block_starts(supers, part, sup, "_sum", base, levels - 1).drop("_sum")
    inner = Window.partitionBy(*part, sup).orderBy(block).rowsBetween(*before)
    blocks = blocks.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return blocks.join(supers, [*part, sup]).withColumn(out, F.col(base) + F.col("_in")).drop(sup, base, "_in")


def running_total(df: DataFrame, part: list[str], block: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the same ``part`` that come earlier in the order
    (``block``, ``order``). Only (``part``, ``block``) groups are ordered within a task, so a hot ``part`` is
    spread over its blocks. ``part`` and ``block`` must not be null; ``order`` must be unique in a block."""
    blocks = written(df.groupBy(*part, block).agg(F.sum(value).alias("_sum")), "blocks")
    starts = block_starts(blocks, part, block, "_sum", "_start").drop("_sum")
    w = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(starts, [*part, block]).withColumn(out, F.col("_start") + F.col("_before")).drop("_start", "_before")


def keep_rows(docs: DataFrame, found: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, digest, kept; written) keeps, in their own columns. ``digest`` is the
    expression that gave found's column. Of rows that repeat a kept doc_id and digest one stays; a null doc_id is
    matched like any other."""
    found = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "kept")
    ids = found.groupBy("_id").agg(F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("_out"), F.count("*").alias("_rows"))
    gone = ids.filter("_out = _rows")
    clean = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    several = ids.filter("_rows > 1 and _out < _rows")
    if several.isEmpty():
        return clean
    single = clean.join(several, clean["doc_id"].eqNullSafe(several["_id"]), "left_anti")
    both = clean.join(several, clean["doc_id"].eqNullSafe(several["_id"]), "left_semi").select(F.struct("*").alias("row"), "doc_id", digest.alias("_d"))
    kept = found.filter("kept")
    both = both.join(kept, both["doc_id"].eqNullSafe(kept["_id"]) & (both["_d"] == kept["_digest"]), "left_semi")
    return single.unionByName(both.dropDuplicates(["doc_id", "_d"]).select("row.*"))
