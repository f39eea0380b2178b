"""A profile has the parts that are wanted, and nothing is looked for beside them."""

from pyspark.sql import functions as F

from caselens.operators import topics
from caselens.plans import ranking


def test_only_wanted_parts_are_looked_for(spark):
    rows = spark.createDataFrame([("how to configure the theme --force",), ("other; the",), ("",), (None,)], "text string")
    catalog = {"products": {"The": ["the"]}}
    some = rows.select(topics.profile(F.col("text"), catalog, wanted=("products", "intents")).alias("p"))
    assert some.select("p.*").columns == ["products", "intents"]
    every = rows.select(topics.profile(F.col("text"), catalog).alias("p"))
    assert every.select("p.*").columns == ["products", "components", "features", "objects", "operations", "intents", "entities"]
    assert [tuple(r.p[c] for c in ("products", "intents")) for r in every.collect()] == [tuple(r.p) for r in some.collect()]


def test_topic_profiles_looks_for_no_entities(spark, tmp_path):
    spark.createDataFrame([(1, "the run")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = ranking.topic_profiles(spark, str(tmp_path))
    assert "qacli(?:" not in found._jdf.queryExecution().optimizedPlan().toString() and found.first()["operations"] == "Execution"
