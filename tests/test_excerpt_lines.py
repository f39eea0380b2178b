"""The lines of an excerpt lose the spaces around them, and no digits."""

from pyspark.sql import functions as F

from caselens.operators import evidence, sentences


def test_lines_are_trimmed(spark):
    df = spark.createDataFrame([(1, " a b \n 1 c 1\r\n  \n20"), (2, "0 first 0"), (3, None)], "id long, t string")
    assert {r["id"]: r["e"] for r in df.select("id", evidence.excerpt(F.col("t")).alias("e")).collect()} == {1: "a b 1 c 1 20", 2: "0 first 0", 3: ""}


def test_sentences_keep_their_digits(spark):
    df = spark.createDataFrame([("It is 0.  1 next is 1。2つ目は 2", )], "t string")
    assert df.select(sentences.sentences_of(F.col("t"))).first()[0] == ["It is 0.", "1 next is 1。", "2つ目は 2"]
