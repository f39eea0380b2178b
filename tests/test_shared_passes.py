"""Searches that share one pass, and steps under all searches that look at each text once."""

from pyspark.sql import functions as F

from caselens.functions.text import PLAIN, fold, nfkc_casefold, plain
from caselens.operators import coverage, retrieval, scoring

TEXTS = ["Der große Baum\nund ein Haus", "ＡＢＣ ﬁne", "plain words here", "naïve Œuvre “x”", "設定を確認 abc", "Ⅳ part", "", None, "\u212a kelvin"]


def made(spark):
    words = ["der", "baum", "haus", "und", "portal", "build", "x1", "設定"]
    rows = [(i // 3, i % 3, " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 9)), ["en", "de", None][i % 3], ["web", "news"][i % 2]) for i in range(90)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, text string, product string, version string")
    queries = spark.createDataFrame([(1, "der baum portal"), (2, "build x1 haus haus"), (3, "設定"), (4, "zzzz")], "query_id long, query string")
    return retrieval.indexed(chunks, columns=("product", "version")), queries


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["document_id"], r["chunk_index"], r["score"]) for r in df.collect())


def test_one_pass_gives_the_lists_of_each_search(spark):
    index, queries = made(spark)
    found = retrieval.lists(index, queries, {"bm25": 7, "keyword": 5, "cosine": 6})
    for name, top in (("bm25", 7), ("keyword", 5), ("cosine", 6)):
        every = scoring.scored(index, queries, (name,)).withColumnRenamed(name, "score")
        assert rows_of(found[name]) == rows_of(retrieval.ranked(every, top))
    candidates = retrieval.searches(index, queries, 3)
    assert list(candidates) == list(retrieval.SEARCHES)
    assert rows_of(retrieval.RERANKERS["lexical"](candidates["hybrid"], index, queries, 3)) == rows_of(retrieval.search(index, queries, 3, "hybrid", "lexical"))


def test_filter_modes_inside_the_pass_are_those_of_the_joins(spark):
    index, queries = made(spark)
    wanted = spark.createDataFrame([(1, "EN ", None), (2, "de", "Web"), (3, None, "news"), (4, "en", "web")], "query_id long, product string, version string")
    found = scoring.leading(index, queries, {"bm25": 4}, retrieval.passes(wanted), ("product", "version"))
    scores = retrieval.bm25(index, queries)
    for mode in retrieval.FILTER_MODES:
        want = retrieval.ranked(retrieval.filtered(scores, index, wanted, mode), 4)
        assert rows_of(retrieval.ranked(found.filter(F.col("filter_mode") == mode), 4)) == rows_of(want)


def test_folding_without_a_look_at_ascii_is_exact(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert "x00" not in PLAIN
    for r in df.select("t", fold(F.col("t")).alias("a"), nfkc_casefold("t").alias("b"), plain(F.col("t")).alias("p")).collect():
        assert r["a"] == r["b"] and (r["t"] is None or r["p"] == (r["t"] not in ("ＡＢＣ ﬁne", "Ⅳ part", "\u212a kelvin")))


def test_group_coverage_folds_a_text_once(spark):
    df = spark.createDataFrame([("a", "Validate BUILD portal --x"), ("a", None), ("b", "nothing")], "k string, t string")
    found = coverage.group_coverage(df, ["k"], "t")
    assert {r["k"]: r["coverage"] for r in found.collect()} == {"a": ["Execution", "Option", "Options", "UploadProcedure", "ValidateVerification", "Verification"], "b": []}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("nfkc_casefold") <= 2
