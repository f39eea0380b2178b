"""Every query of the library with a SQL form, beside DuckDB on the driver's smallest tables, where they are at hand."""

import math
import os
from glob import glob

import pytest

from caselens import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, list):
        return str([plain(v) for v in value])
    return f"{float(value):.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs


#: Queries without SQL, with what each row of theirs must satisfy.
RULES = {
    "coverage_selection": "pick between 1 and 5 and quality between 0.3 and 1",
    "question_selection": "pick between 1 and 3 and score <= 1",
    "budget_selection": "used <= 2500 and pick >= 1",
    "topic_ranking": "final_score between 0 and 1 and topic_score between 0 and 1",
    "answer_quality": "decision in ('CustomerReady', 'NeedsReview', 'InsufficientEvidence', 'Blocked') and grounding between 0 and 1",
}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rules_without_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    found = catalog.queries()[name](spark, DATA)
    assert found.count() > 0 and found.filter(f"not ({RULES[name]})").count() == 0
