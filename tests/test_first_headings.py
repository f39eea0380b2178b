"""The first line of a document is the only heading of ``heading_chunks``, as its SQL has it, whatever the lines are."""

import duckdb
import pytest

from caselens import catalog

TEXTS = ["", "   ", "\nfoo bar", " \n### foo bar", "abc\n### heading here\nmore", "abc\n  ## two\nrest ##\nend", "### x", "###", "abc def ###", "質問\nabc\n質問\nmore", "abc\r\ndef\rghi", "abc\u2028d ##", "\u00a0abc def\u00a0", "\tlead\nx" * 400, None]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("headings"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_only_first_lines_are_headings(spark, made):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{made}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, chunk_index, section_title, n_chars FROM ({catalog.oracle_sql()['heading_chunks']})").fetchall()
    got = [(r["doc_id"], r["chunk_index"], r["section_title"], r["n_chars"]) for r in catalog.queries()["heading_chunks"](spark, made).collect()]
    assert sorted(got) == sorted(want) and len(want) > len({r[0] for r in want})
