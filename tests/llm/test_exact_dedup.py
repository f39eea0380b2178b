import hashlib
import random
from collections import Counter

from caselens.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string"


def plain(text):
    return hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()).hexdigest()


def test_summary_keeps_frequent_items():
    rng = random.Random(3)
    items = ["hot"] * 400 + [f"x{rng.randrange(300)}" for _ in range(600)]
    rng.shuffle(items)
    kept = {}
    for i in range(0, 1000, 50):
        kept = exact_dedup.merge_counters(kept, Counter(items[i : i + 50]), 8)
    assert len(kept) <= 8 and 400 - 1000 / 8 <= kept["hot"] <= 400


def test_groups(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Aa", "aA", "É", "é", "", None, f"own {i}"])) for i in range(300)] + [(i, "HOT") for i in range(300, 700)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    best, size = {}, Counter(plain(t) for _, t in rows)
    for i, t in rows:
        best[plain(t)] = max(i, best.get(plain(t), -1))
    for counters in (2, 8, 512):
        got = {tuple(r) for r in exact_dedup.report(docs, counters).collect()}
        assert got == {(i, best[plain(t)], size[plain(t)], best[plain(t)] == i, plain(t)) for i, t in rows}
    kept = exact_dedup.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values()) and kept.columns == docs.columns


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "A"), (3, "B"), (None, "c"), (None, "C")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.report(docs).collect()) == [
        (0, 2, False), (0, 2, True), (2, 3, False), (2, 3, False), (2, 3, True), (3, 2, False), (3, 2, True),
    ]
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in exact_dedup.deduplicate(docs).collect()) == [(0, "c"), (2, "a"), (3, "b")]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.report(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0
