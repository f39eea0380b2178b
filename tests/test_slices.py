"""Scores are held in slices of bounded size, whatever the numbers of rows and queries."""

import numpy as np

from caselens.operators import retrieval, scoring


def test_slices_cover_all_rows_within_the_bound():
    for rows, queries in ((10_000, 4096), (10_000, 200), (7, 1 << 24), (0, 5), (3, 0)):
        parts = list(scoring.slices(rows, queries))
        assert [i for p in parts for i in range(rows)[p]] == list(range(rows))
        assert all((p.stop - p.start) * queries <= scoring.CELLS or p.stop - p.start == 1 for p in parts)


def test_nearest_of_many_queries_is_that_of_brute_force(spark):
    made = np.random.default_rng(7).normal(size=(1500, 4)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id long, vector array<double>").coalesce(1)
    queries = df.filter("id < 1200").withColumnRenamed("id", "query_id")  # one batch is two slices
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.nearest(df, queries, 3).collect()}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    scores = np.round(unit[:1200] @ unit.T, 6)
    for q in range(0, 1200, 97):
        order = np.lexsort((np.arange(1500), -scores[q]))[:3]
        assert [got[q, n + 1] for n in range(3)] == list(order)
