"""Operators on small rows made by hand."""

from pyspark.sql import functions as F

from caselens.operators import cases, chunking, evaluation, facts, incremental, quality, retrieval, selection
from test_stated_rows import CANDIDATE

CHUNKS = "document_id long, chunk_index int, text string"


def test_fixed_chunks_cover_and_overlap(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.fixed_chunks(docs, "doc_id", 4, 1).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows][:3] == ["abcd", "defg", "ghij"] and {r["doc_id"] for r in rows} == {1}
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_headings_begin_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# First\nbody\n## Second\nmore")], "doc_id long, text string")
    rows = chunking.heading_chunks(docs, "doc_id").orderBy("chunk_index").collect()
    assert [(r["section_title"], r["text"].splitlines()[-1]) for r in rows] == [(None, "intro"), ("First", "body"), ("Second", "more")]


def test_search_orders(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma"), (2, 0, "alpha alpha alpha"), (3, 0, "delta")], CHUNKS)
    ask = lambda q: spark.createDataFrame([(7, q)], "query_id long, query string")
    best = lambda scores: [r["document_id"] for r in retrieval.ranked(scores, 3).orderBy("rank").collect()]
    assert best(retrieval.bm25(chunks, ask("alpha"))) == [2, 1]  # repeated terms first
    assert best(retrieval.keyword(chunks, ask("alpha beta")))[0] == 1  # the more complete match first
    assert best(retrieval.bm25(chunks, ask("nothing here"))) == []


def test_chunks_are_cut_in_one_pass(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000)) + "é😀"
    docs = spark.createDataFrame([(1, text), (2, "x" * 14_000)], "doc_id long, text string")
    rows = chunking.fixed_chunks(docs, "doc_id", 120, 50).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == [text[i * 70 : i * 70 + 120] for i in range(len(rows))] and rows[-1]["text"].endswith("é😀")
    many = chunking.fixed_chunks(docs, "doc_id", 2, 1)  # a document of over 10,000 chunks keeps its own id
    assert many.filter("doc_id = 2").count() == 13_999
    ask = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    vectors = spark.createDataFrame([(5, 12_345, [1.0, 0.0]), (6, 2, [0.0, 1.0])], "document_id long, chunk_index long, vector array<double>")
    best = retrieval.nearest(vectors, ask, 1, ids=("document_id", "chunk_index")).first()
    assert (best["document_id"], best["chunk_index"]) == (5, 12_345)


def test_metrics_look_at_the_whole_ranking(spark):
    scores = spark.createDataFrame([(1, d, c, 1.0 - 0.001 * d) for d in range(120) for c in (0, 1)], "query_id long, document_id long, chunk_index int, score double")
    expected, queries = spark.createDataFrame([(1, 99)], "query_id long, document_id long"), spark.createDataFrame([(1,)], "query_id long")
    row = evaluation.scored_metrics(scores, expected, queries, [3]).first()
    assert (row["reciprocal_rank"], row["recall_at_k"], row["returned_document_count"]) == (1 / 100, 0.0, 3)


def test_selection_without_candidates(spark):
    empty = spark.createDataFrame([], CANDIDATE)
    required = spark.createDataFrame([("q", ["A"])], "query_id string, required_coverage array<string>")
    assert selection.coverage_selection(empty, required).count() == 0


def test_two_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "y"), (5, None, "y"), (6, None, None), (7, "c", "y")], "n int, a string, b string")
    assert [r["n"] for r in cases.two_key_dedup(rows, "a", "b", "n").orderBy("n").collect()] == [1, 5, 6]


def test_nearest_vectors_and_fusion(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<double>")
    rows = retrieval.nearest(vectors, queries, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 1.0), (3, 0.707107)]
    left = spark.createDataFrame([(9, 1, 0, 1), (9, 2, 0, 2)], "query_id long, document_id long, chunk_index int, rank int")
    right = spark.createDataFrame([(9, 2, 0, 1)], left.schema)
    assert {r["document_id"]: r["score"] for r in retrieval.fused(left, right).collect()} == {1: round(1 / 61, 6), 2: round(1 / 61 + 1 / 62, 6)}


def test_metrics_of_a_query_without_results_count(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3)], "query_id long, document_id long, rank int")
    expected = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, document_id long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    row = evaluation.summary(evaluation.query_metrics(ranked, expected, queries, [2]), []).first()
    assert (row["query_count"], row["mrr"], row["mean_recall_at_k"], row["mean_precision_at_k"]) == (2, 0.25, 0.5, 0.25)


def test_index_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None)], "id string, hash string")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("d", None)], "id string, hash string")
    assert {r[0]: r[1] for r in incremental.diff(old, new, "id", "hash").collect()} == {"a": "changed", "b": "deleted", "c": "added", "d": "unchanged"}


def test_fingerprint_does_not_depend_on_order(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (3, "x")], "k long, m string")
    prints = [tuple(r)[1:] for r in incremental.fingerprint(rows, ["k"], F.col("m")).orderBy("k").collect()]
    assert prints[0] == prints[1] != prints[2]


def test_facts_resolve_by_confidence_then_version(spark):
    rows = spark.createDataFrame([("v", "1.2", 0.9), ("v", "1.10", 0.9), ("p", "80", 0.5), ("p", "80", 0.4)], "key string, value string, confidence double")
    got = {r["key"]: (r["value"], r["status"]) for r in facts.resolved(rows).collect()}
    assert got == {"v": ("1.10", "Conflict"), "p": ("80", "Confirmed")}


def test_case_tables(spark):
    rows = spark.createDataFrame([("a", "open", "2024-01-01"), ("a", "closed", "2024-02-01"), ("b", "open", "2024-03-01")], "company string, status string, updated string")
    got = {r["company"]: (r["total"], r["open"], r["stale"]) for r in cases.status_summary(rows, "company", F.col("status") == "open", "updated", "2024-03-02").collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 1, 0)}
    empty = cases.pivot_with_total(rows.limit(0), "company", "status", ["open", "closed"]).collect()
    assert len(empty) == 1 and empty[0]["total"] == 0


def test_nearest_in_time_prefers_the_later_of_equals(spark):
    left = spark.createDataFrame([("k", 1, "2024-01-02 00:00:00"), ("z", 2, "2024-01-02 00:00:00")], "k string, l long, at string")
    right = spark.createDataFrame([("k", 5, "2024-01-01 00:00:00"), ("k", 6, "2024-01-03 00:00:00")], "k string, r long, at2 string")
    got = {r["l"]: r["r"] for r in cases.nearest_in_time(left, right, "k", "l", "at", "r", "at2").collect()}
    assert got == {1: 6, 2: None}


def test_versions(spark):
    rows = spark.createDataFrame([("1.2", "1.2"), ("1.2.1", "v1.2.9"), ("1.2", "2.0"), ("1.2", None), (None, "1.0")], "r string, a string")
    got = [r[0] for r in rows.select(selection.version_status(F.col("r"), F.col("a"))).collect()]
    assert got == ["exact", "near", "mismatch", "unknown", "not_requested"]


def test_unsupported_claim_blocks_an_answer(spark):
    rows = spark.createDataFrame([(1, "Use --force on port 8080.", ["port 8080"], "q"), (2, "Set port 8080.", ["port 8080"], "q")], "id long, answer string, evidence array<string>, question string")
    rows = rows.withColumn("insufficient_reasons", F.array().cast("array<string>"))
    got = {r["id"]: (r["unsupported_claims"], r["decision"] == "Blocked") for r in quality.evaluated(rows).collect()}
    assert got == {1: (1, True), 2: (0, False)}
