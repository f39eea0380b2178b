"""Sentences of one text that tie by score and size: the one that sorts first is taken, as the query's SQL orders them."""

from caselens.operators import sentences


def test_tied_sentences_go_by_text(spark):
    rows = [("q", 0, "OfficialDoc", "Once the word zeta. Once the word beta. Once the word long beta.", ["word"], None)]
    frame = spark.createDataFrame(rows, "query_id string, source_index int, source_type string, text string, terms array<string>, excluded array<string>")
    assert sentences.best_sentences(frame).first().sentence == "Once the word beta."
