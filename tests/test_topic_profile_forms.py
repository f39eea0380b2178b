"""Profiles of documents keep ß, as their SQL does, and fold a text once whatever the number of aliases."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from caselens.operators import topics
from caselens.plans import ranking


def test_sharp_s_ends_a_word(spark, tmp_path):
    rows = [(1, "ein undß hier"), (2, "ein undss hier"), (3, "Ein Und"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.products for r in ranking.topic_profiles(spark, str(tmp_path)).collect()} == {1: "Und", 2: "", 3: "Und", 4: ""}


def test_a_text_is_folded_once(spark):
    said = io.StringIO()
    with redirect_stdout(said):
        spark.createDataFrame([("x",)], "t string").select(topics.profile(F.col("t"), {"products": {"A": ["b", "c"]}}).operations.alias("o")).explain()
    assert said.getvalue().count(r"\x00-\x7f") <= 3
