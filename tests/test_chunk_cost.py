"""The ways of chunking cost time in proportion to a text: parts are not looked up by place in arrays that are computed anew for each."""

import time

from caselens.functions.text import chunk_texts
from caselens.operators import chunking


def seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def grows(spark, make, unit: str, lines: int) -> float:
    """How much longer a text of 8 times as many units takes, after both have run once."""
    sizes = [spark.createDataFrame([(1, unit * n)], "id long, text string") for n in (lines, 8 * lines)]
    for df in sizes:
        seconds(make(df))
    return seconds(make(sizes[1])) / seconds(make(sizes[0]))


def test_fixed_chunks_take_time_in_proportion(spark):
    assert grows(spark, lambda df: df.select(chunk_texts(df["text"], 1200, 120)), "some words of a text\n" * 3, 4000) < 24


def test_sections_take_time_in_proportion(spark):
    assert grows(spark, lambda df: chunking.section_lines(df, "id", chunking.heading_title), "a line\n", 500) < 24


def test_structured_chunks_take_time_in_proportion(spark):
    assert grows(spark, lambda df: chunking.structured_chunks(df, "id"), "原因\na line\n", 250) < 24


def plain(text: str, maximum: int, overlap: int) -> list[str]:
    out, at = [], 0
    while text and (not out or at - (maximum - overlap) + maximum < len(text)):
        out.append(text[at : at + maximum])
        at += maximum - overlap
    return out


def test_chunks_are_those_of_a_plain_loop(spark):
    texts = ["", "a", "0123456789" * 2, "0123456789" * 3, "0123456789" * 3 + "x", "\U0001f600é\n" * 17]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    for maximum, overlap in ((20, 2), (20, 0), (20, 10), (20, 15), (7, 3)):
        got = {r[0]: r[1] for r in df.select("id", chunk_texts(df["text"], maximum, overlap)).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain(t, maximum, overlap), (maximum, overlap, t)
        assert not got[99]
