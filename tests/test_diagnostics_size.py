"""Diagnostics of official pages count a product's chunks once for all queries that ask for the same features."""

import time

from pyspark.sql import functions as F

from caselens.operators import sources


def found(spark, queries, indexed):
    results = spark.createDataFrame([], "query_id long, source_type string, selected boolean, state string, title string, text string, url string, matched_terms array<string>")
    index = indexed.groupBy("product").agg(F.count("*").alias("chunks"), F.lit(0).alias("fetch_failures"))
    return sources.official_diagnostics(queries, results, index, indexed)


def test_many_queries_over_many_chunks_of_one_feature(spark):
    n = 40_000
    queries = spark.range(n).selectExpr("id query_id", "'A' product", "1L document_urls", "cast(null as array<string>) target_versions", "array('F') features")
    indexed = spark.range(n).selectExpr("'A' product", "id chunk_id", "'F' feature")
    began = time.perf_counter()
    got = found(spark, queries, indexed).agg(F.min("feature_matches"), F.max("feature_matches"), F.count("*")).first()
    assert tuple(got) == (n, n, n) and time.perf_counter() - began < 60


def test_chunks_of_several_features_count_once(spark):
    asks = [(1, "A", ["F", "G", "F"]), (2, "A", ["G"]), (3, "B", ["F", "G"]), (4, None, ["F"]), (5, "A", None), (6, "A", ["X", None]), (7, "A", ["G", "F"])]
    queries = spark.createDataFrame([(q, p, 1, None, f) for q, p, f in asks], "query_id long, product string, document_urls long, target_versions array<string>, features array<string>")
    indexed = spark.createDataFrame([("A", 1, "F"), ("A", 1, "G"), ("A", 1, "G"), ("A", 2, "F"), ("A", 3, None), ("B", 1, "F"), (None, 9, "F")], "product string, chunk_id long, feature string")
    got = {r["query_id"]: r["feature_matches"] for r in found(spark, queries, indexed).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 2}
