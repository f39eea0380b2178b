"""Metrics of searches rest on the pairs before the first expected document alone, and are those of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from caselens.operators import evaluation, retrieval, scoring


def test_pairs_behind_the_expected_document_stay_in_the_tasks(spark):
    texts = [(d, c, " ".join(["alpha"] * (d % 7) + ["beta"] * (d % 3) + ["gamma"] * c + ["filler"] * 5)) for d in range(60) for c in range(2)]
    chunks = spark.createDataFrame(texts, "document_id long, chunk_index int, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma alpha"), (3, "none")], "query_id long, query string")
    expected = spark.createDataFrame([(1, 13), (1, 6), (2, 3)], "query_id long, document_id long")
    index = retrieval.indexed(chunks)
    every = [s.select(F.lit(n).alias("search_method"), "query_id", "document_id", "score") for n, s in (("bm25", retrieval.bm25(index, queries)), ("keyword", retrieval.keyword(index, queries)))]
    some = scoring.document_scores(index, queries, ("bm25", "keyword"), 5, expected)
    rows = lambda s: sorted(map(tuple, evaluation.scored_metrics(s, expected, queries, [1, 3, 5], ["search_method"]).collect()))
    assert rows(some) == rows(every[0].unionByName(every[1]))
    none = scoring.document_scores(index, queries, ("bm25",), 5, expected.filter("false"))
    assert none.groupBy("query_id").agg(F.countDistinct("document_id").alias("n")).agg(F.max("n")).first()[0] <= 5 * none.rdd.getNumPartitions()


def test_best_row_of_each_document():
    best = scoring.Best(1, 2, documents=True)
    best.add(np.array([[3.0], [2.0], [1.0]]), [np.array([7, 7, 8])])
    best.add(np.array([[2.5], [0.5]]), [np.array([8, 9])])
    assert best.rows[2].tolist() == [7, 8] and best.rows[1].tolist() == [3.0, 2.5]
