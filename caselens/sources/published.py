"""Indexes as published snapshots: readers see the old one or the new one, never a half.

An index is a folder with two tables. ``snapshots/<name>`` holds the rows of one write, by the parts (such as products) that the
write gives; ``pointers`` is a log of small files that says which snapshot a part is read from. A write puts its rows
down first and appends its pointers, one file, last: a write that fails before leaves snapshots that nothing points to,
and the last good index. Parts that a write does not give keep their pointers, so nothing else is written again.

Defined cases: rows without a part have the part ``Default``; an empty write publishes nothing new unless the parts to be
replaced are named, which then are empty; of two writers at a time the one of the greater version, then name, is read for each part; a
missing index reads as no rows of the given schema.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.operators.replies import product_folder

POINTER = "part string, version long, snapshot string"


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/pointers")
    except AnalysisException:  # there is none yet
        return spark.createDataFrame([], POINTER)


def current(spark: SparkSession, path: str) -> DataFrame:
    """(part, version, snapshot): where each part of the index is read from; snapshot is null for one that was emptied."""
    latest = F.max_by(F.struct("version", "snapshot"), F.struct("version", F.coalesce("snapshot", F.lit(""))))
    return _pointers(spark, path).groupBy("part").agg(latest.alias("_l")).select("part", "_l.version", "_l.snapshot")


def version(spark: SparkSession, path: str) -> int:
    """The version that was published last; 0 if none was."""
    return _pointers(spark, path).agg(F.max("version")).first()[0] or 0


def publish(rows: DataFrame, path: str, part: str | None = None, failures: int = 0, number: int | None = None, replace: list[str] | None = None) -> bool:
    """Publishes ``rows`` as the new content of their parts, named by the column ``part`` (safe as a folder's name; None: one part), and of
    those that ``replace`` names. Where something failed on the way and there is an index already, that one stays and False is
    given. ``number`` is the version; one that was published before is not written again, so a retried batch changes
    nothing."""
    spark = rows.sparkSession
    last = version(spark, path)
    if failures and last or number is not None and number <= last:
        return False
    number = last + 1 if number is None else number
    name = f"{number:012d}-{uuid.uuid4().hex}"
    folder = product_folder(F.col(part)) if part else F.lit("Default")
    rows.withColumn("_part", folder).write.partitionBy("_part").mode("errorifexists").parquet(f"{path}/snapshots/{name}")
    try:
        parts = spark.read.parquet(f"{path}/snapshots/{name}").select(F.col("_part").cast("string").alias("part")).distinct()
    except AnalysisException:  # no rows, no files
        parts = spark.createDataFrame([], "part string")
    pointers = parts.select("part", F.lit(number).cast("long").alias("version"), F.lit(name).alias("snapshot"))
    if replace:
        given = spark.createDataFrame([(p,) for p in replace], "_p string").select(product_folder(F.col("_p")).alias("part"))
        pointers = pointers.unionByName(given.join(parts, "part", "left_anti").select("part", F.lit(number).cast("long").alias("version"), F.lit(None).cast("string").alias("snapshot")))
    pointers.coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return True


def read_published(spark: SparkSession, path: str, schema, parts: list[str] | None = None) -> DataFrame:
    """The rows of the index, or of some parts of it, in the columns of ``schema``."""
    found = current(spark, path).filter("snapshot IS NOT NULL")
    if parts is not None:
        wanted = spark.createDataFrame([(p,) for p in parts], "_p string").select(product_folder(F.col("_p")).alias("part"))
        found = found.join(wanted, "part", "left_semi")
    by: dict[str, list[str]] = {}
    for r in found.collect():  # one row a part
        by.setdefault(r.snapshot, []).append(r.part)
    out = spark.createDataFrame([], schema)
    for name, own in sorted(by.items()):
        rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("_part", T.StringType())])).parquet(f"{path}/snapshots/{name}")
        out = out.unionByName(rows.filter(F.col("_part").isin(own)).drop("_part"))
    return out


def unread(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """Of the names of snapshots those that no part is read from, which may be removed once no reader holds them."""
    held = {r.snapshot for r in current(spark, path).collect()}
    return sorted(set(names) - held)
