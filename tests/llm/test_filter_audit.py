"""The audit beside a plain replay, document by document."""

import re
from itertools import permutations

from caselens.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(row, rows):
    doc_id, text, _ = row
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows),
    }


def plain(rows, labels):
    out = {}
    flags = [failed(r, rows) for r in rows]
    has = lambda i, k: any(x[0] is not None and x[0] == i and x[k] == 1 for x in labels)
    for part in {r[2] or "" for r in rows}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c = dict.fromkeys(COUNTS, 0)
                for row, flag in zip(rows, flags, strict=True):
                    if (row[2] or "") != part:
                        continue
                    earlier, here = any(flag[x] for x in order[: step - 1]), flag[f]
                    removed = here and not earlier
                    c["kept"] += not earlier and not here
                    c["removed"] += removed
                    c["redundant"] += here and earlier
                    c["unique_fails"] += here and sum(flag.values()) == 1
                    c["good_lost"] += removed and has(row[0], 1)
                    c["toxic_lost"] += removed and has(row[0], 2)
                out[part, "".join(order), step] = c
        for f in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k]["removed"] for k in mine)
            for k in mine:
                out[k]["shapley"] = total
    return out


def prose(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


ROWS = [
    (1, prose(60), "a"), (2, prose(60), "b"), (2, prose(60), "b"), (None, prose(60), "a"), (3, prose(10), None), (4, None, ""), (5, "", "a"), (6, " \t\x0b\x0c\r\n", "a"),
    (7, "x " * 80, "b"), (8, prose(64) + " # " + "x " * 40, "a"), (9, "ABC " * 60, "b"), (10, prose(49, 100), "a"), (11, prose(50, 100), "a"), (12, "É" * 20 + "A", "b"),
    (13, prose(65) + " x" * 36, "a"), (14, prose(64) + " x" * 35, "a"), (15, prose(60) + " |", "b"), (15, prose(60), "a"), (16, prose(3000) * 40, "a"), (0, "ABC " * 60, "a"),
]
KNOWN = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, 1), (5, 1, None), (7, 0, 0), (7, 1, 0), (8, 1, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1)]


def result(df):
    return {(r.part, r.filter_order, r.step): {c: r[c] for c in COUNTS} for r in df.collect()}


def test_all_orders(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], DOCS + ", step int, part string")
    labels = spark.createDataFrame(KNOWN, LABELS)
    got = filter_audit.report(docs, labels)
    assert got.count() == 3 * 600 and result(got) == plain(ROWS, KNOWN)


def test_flags_of_texts(spark):
    rows = spark.createDataFrame(ROWS, DOCS).select("doc_id", "text", "source", filter_audit.text_flags(filter_audit.F.coalesce("text", filter_audit.F.lit(""))).alias("bits")).collect()
    for r in rows:
        want = failed((r.doc_id, r.text, r.source), [])
        assert r.bits == sum(filter_audit.FILTERS[f] for f in "ABCD" if want[f]), r


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.report(docs, labels).collect() == []
    got = result(filter_audit.report(spark.createDataFrame(ROWS, DOCS), labels))
    assert got == plain(ROWS, [])
