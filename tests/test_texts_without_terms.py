"""Tasks that get no text with a term, or none that is asked for, find nothing and do not fail."""

import numpy as np

from caselens.operators import retrieval, scoring


def test_texts_without_terms_are_zero_vectors():
    assert scoring.Hashed().vectors(scoring.Counted(["", ""])).tolist() == np.zeros((2, 256)).tolist()


def test_terms_that_cancel_are_found_by_no_vector(spark):
    """Two terms of one place and opposite signs: a vector of length zero has the cosine 0, as in the reference."""
    hashed = scoring.Hashed()
    assert hashed.place("ja")[0] == hashed.place("osci")[0] and hashed.place("ja")[1] == -hashed.place("osci")[1]
    chunks = spark.createDataFrame([(1, 0, "ja osci"), (2, 0, "ja"), (3, 0, "..."), (4, 0, None)], "document_id long, chunk_index int, text string").repartition(8)
    queries = spark.createDataFrame([(7, "ja")], "query_id long, query string")
    found = retrieval.lists(retrieval.indexed(chunks), queries, {"bm25": 5, "cosine": 5})
    assert [(r["document_id"], r["score"]) for r in found["cosine"].collect()] == [(2, 1.0)]
    assert sorted(r["document_id"] for r in found["bm25"].collect()) == [1, 2]
