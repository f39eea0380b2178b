"""Published indexes: readers see whole snapshots only."""

import pytest
from pyspark.sql import functions as F

from caselens.sources import published
from caselens.streaming import ingest

SCHEMA = "product string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def read(spark, path, parts=None):
    return sorted((r.product or "", r.n) for r in published.read_published(spark, path, SCHEMA, parts).collect())


def test_parts_are_replaced_and_others_stay(spark, tmp_path):
    path = f"{tmp_path}/i"
    assert read(spark, path) == [] and published.version(spark, path) == 0
    assert published.publish(rows(spark, ("QAC", 1), ("a/b:c", 2), (None, 3)), path, "product")
    assert published.publish(rows(spark, ("QAC", 10), ("x [1] = 50%", 4)), path, "product")
    assert read(spark, path) == [("", 3), ("QAC", 10), ("a/b:c", 2), ("x [1] = 50%", 4)] and read(spark, path, ["a/b:c", "none"]) == [("a/b:c", 2)]
    versions = {r.part: r.version for r in published.current(spark, path).collect()}
    assert sorted(versions.values()) == [1, 1, 2, 2] and versions["QAC"] == 2 and all("/" not in p and ":" not in p for p in versions)
    assert published.publish(rows(spark), path, "product", replace=["QAC"]) and read(spark, path, ["QAC"]) == [] and len(read(spark, path)) == 3


def test_a_write_that_fails_midway_leaves_the_last_good_index(spark, tmp_path):
    path = f"{tmp_path}/i"
    published.publish(rows(spark, ("a", 1), ("b", 2)), path, "product")
    bad = rows(spark, ("a", 10), ("b", 20)).repartition(2, "product").withColumn("n", F.when(F.col("product") == "b", F.raise_error(F.lit("disk full")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="disk full"):
        published.publish(bad, path, "product")
    assert read(spark, path) == [("a", 1), ("b", 2)] and published.version(spark, path) == 1
    assert published.publish(rows(spark, ("a", 100)), path, "product") and read(spark, path) == [("a", 100), ("b", 2)]


def test_the_pointers_fail_and_the_old_index_is_read(spark, tmp_path, monkeypatch):
    """The rows of a new snapshot are down, but its pointer is not: nothing of it is read."""
    path = f"{tmp_path}/i"
    published.publish(rows(spark, ("a", 1)), path, "product")
    monkeypatch.setattr(published, "POINTER", "part string, version long, snapshot string")
    rows(spark, ("a", 2)).withColumn("_part", F.lit("a")).write.partitionBy("_part").parquet(f"{path}/snapshots/000000000002-lost")
    assert read(spark, path) == [("a", 1)] and published.unread(spark, path, ["000000000002-lost"]) == ["000000000002-lost"]


def test_failures_keep_the_last_good_index(spark, tmp_path):
    path = f"{tmp_path}/i"
    assert published.publish(rows(spark, ("a", 1)), path, failures=3), "there is none yet"
    assert not published.publish(rows(spark, ("a", 2)), path, failures=1) and read(spark, path) == [("a", 1)]
    assert published.publish(rows(spark, ("a", 2)), path, failures=0) and read(spark, path) == [("a", 2)]


def test_a_version_is_published_once(spark, tmp_path):
    path = f"{tmp_path}/i"
    assert published.publish(rows(spark, ("a", 1)), path, number=5) and not published.publish(rows(spark, ("a", 2)), path, number=5)
    assert not published.publish(rows(spark, ("a", 2)), path, number=4) and read(spark, path) == [("a", 1)]


def test_index_updater(spark, tmp_path):
    """A stream keeps an index: counts of each batch, and a batch that runs again changes nothing."""
    path, schema = f"{tmp_path}/i", "key string, content string, cost int"
    update = ingest.index_updater(path, schema, "key", "content")
    batch = lambda *values: spark.createDataFrame(list(values), schema)
    index = lambda: sorted(tuple(r) for r in published.read_published(spark, path, schema).collect())
    update(batch(("a", "1", 1), ("b", "1", 1), ("b", "1", 1)), 0)
    update(batch(("a", "2", 9), ("b", "1", 9), ("c", "1", 9)), 1)
    want = [("a", "2", 9), ("b", "1", 1), ("c", "1", 9)]
    assert index() == want
    update(batch(("a", "3", 0), ("z", "1", 0)), 1)
    assert index() == want, "the batch was published before"
    counts = {(r.batch, r.change): r.rows for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {(0, "added"): 2, (1, "changed"): 1, (1, "unchanged"): 1, (1, "added"): 1}


def test_index_updater_in_a_stream(spark, tmp_path):
    source, path, schema = f"{tmp_path}/in", f"{tmp_path}/i", "key string, content string"
    spark.createDataFrame([("a", "1"), ("b", "1")], schema).coalesce(1).write.parquet(source)
    run = lambda: spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(ingest.index_updater(path, schema, "key", "content")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("b", "2"), ("c", "1")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(tuple(r) for r in published.read_published(spark, path, schema).collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
