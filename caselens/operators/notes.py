"""Notes of a case: logs of segments, each under a header that was appended with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import section_lines

# The beginning of a header, what is before its time, the line after a segment, and the times' formats.
HEADER, MARK, SEPARATOR = "*****追記部_", "追記部_", "-" * 50
TIMES = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm"]


def header_time(header: Column) -> Column:
    """The time in a header, up to its bracket; null if there is none."""
    found = F.trim(F.regexp_extract(header, rf"{MARK}([^(]*)", 1))
    return F.coalesce(*(F.try_to_timestamp(found, F.lit(f)) for f in TIMES), F.try_to_timestamp(F.nullif(found, F.lit(""))))


def entry(time: Column, status: Column, body: Column) -> Column:
    """A segment as it is appended to a note: header, trimmed body and separator."""
    header = F.concat(F.lit(HEADER), F.date_format(time, TIMES[0]), F.lit("("), status, F.lit(")******"))
    return F.concat_ws("\n", header, F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(SEPARATOR))


def appended(notes: DataFrame, additions: DataFrame, key: str) -> DataFrame:
    """(key, text): ``notes`` with the ``additions`` (key, time, status, body) of each below it, by time and status; a
    note that was not there begins with them."""
    each = additions.select(key, F.struct("time", "status", entry(F.col("time"), F.col("status"), F.col("body")).alias("entry")).alias("_e"))
    new = each.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_e")), lambda x: x["entry"]), "\n").alias("_new"))
    both = notes.select(key, F.regexp_replace("text", r"[\r\n]+$", "").alias("_old")).join(new, key, "full_outer")
    return both.select(key, F.concat_ws("\n", F.nullif("_old", F.lit("")), "_new").alias("text"))


def segments(notes: DataFrame, key: str) -> DataFrame:
    """(key, index, header, body, time) of the segments of each note (key, text): lines before the first header are one
    without, separators go, and so do blank lines at the end of a body. A blank note has none."""
    given = notes.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    parts = section_lines(given, key, lambda line: F.when(line.startswith(HEADER), F.rtrim(line)))
    kept = F.filter("lines", lambda x, i: (F.trim(x) != SEPARATOR) & (F.col("title").isNull() | (i > 0)))
    parts = parts.withColumn("lines", kept).filter(F.col("title").isNotNull() | (F.size("lines") > 0))
    last = F.array_max(F.transform("lines", lambda x, i: F.when(F.regexp_replace(x, r"\s", "") != "", i + 1).otherwise(0)))
    body = F.array_join(F.slice("lines", F.lit(1), F.coalesce(last, F.lit(0))), "\n")
    first = F.min("section").over(Window.partitionBy(key))  # 1 where nothing was before the first header
    return parts.select(
        key, (F.col("section") - first).alias("index"), F.coalesce("title", F.lit("")).alias("header"), body.alias("body"), header_time(F.col("title")).alias("time")
    )


def ordered(rows: DataFrame, key: str) -> DataFrame:
    """``segments`` with their place from 1: those with a time from the newest, then the others as they stand."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("time"), F.when(F.col("time").isNull(), F.col("index")).otherwise(-F.col("index")))
    return rows.withColumn("place", F.row_number().over(w))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """One segment of each note: with a body before those without, then the newest, then the last."""
    solid = F.regexp_replace("body", r"\s", "") != ""
    best = F.max_by(F.struct("index", "header", "body", "time"), F.struct(solid.alias("solid"), F.col("time"), F.col("index")))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")
