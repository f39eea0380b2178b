"""The registered streams over a table of many files that are not in the order of time."""

import datetime
import random

from pyspark.sql import functions as F

from caselens import catalog

START = datetime.datetime(2024, 1, 1)


def events(spark, folder):
    """100 days of events, ten files in shuffled order of time, with all contents in all of them."""
    days = list(range(0, 100, 10))
    random.Random(8).shuffle(days)
    rows = []
    for at in days:
        part = [(START + datetime.timedelta(days=at + k, hours=h), k % 3, "view" if h % 2 else "buy", 1.5) for k in range(10) for h in (1, 8, 15, 22)]
        rows += part
        frame = spark.createDataFrame(part, "ts timestamp, user_id long, event_type string, value double")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return rows


def test_windows_do_not_depend_on_files(spark, tmp_path):
    rows = events(spark, tmp_path)
    end = max(r[0] for r in rows) - datetime.timedelta(hours=1)
    want = {}
    for ts, _, kind, value in rows:
        if datetime.datetime(ts.year, ts.month, ts.day) + datetime.timedelta(days=1) <= end:
            n, total = want.get((f"{ts:%Y-%m-%d}", kind), (0, 0.0))
            want[f"{ts:%Y-%m-%d}", kind] = (n + 1, total + value)
    got = catalog.queries()["stream_windows"](spark, str(tmp_path)).collect()
    assert {(r["day"], r["event_type"]): (r["rows"], r["total"]) for r in got} == want and len(got) == len(want)


def test_first_by_content_does_not_depend_on_files(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = catalog.queries()["stream_first_by_content"](spark, str(tmp_path)).select(F.struct("user_id", "event_type").alias("r")).collect()
    assert sorted((r[0][0], r[0][1]) for r in got) == sorted({r[1:3] for r in rows})
