"""Names found by a catalog of aliases: both plans beside a plain version."""

import random
import unicodedata

from caselens.operators import aliases

TEXT = "id long, text string"


def comparable(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def stands(text, alias):
    at = text.find(alias)
    inside = lambda c: c.isascii() and c.isalnum()
    bounded = inside(alias[0]) and inside(alias[-1])
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(alias) : at + len(alias) + 1]
        if not bounded or not (before and inside(before)) and not (after and inside(after)):
            return True
        at = text.find(alias, at + 1)
    return False


def plain(rows, catalog, itself=True):
    out = []
    for key, text in rows:
        found = set()
        for d, name, alias in catalog:
            for a in [alias, name] if itself else [alias]:
                if d is not None and name is not None and comparable(a) and stands(comparable(text), comparable(a)):
                    found.add((d, name))
        out += [(key, *f) for f in found]
    return sorted(out, key=str)


CATALOG = [
    ("products", "QAC", "ＱＡＣ"), ("products", "Helix", "helix  qac"), ("features", "Stream", "ストリーム"), ("features", "Straße", "strasse"), ("features", "Stream", None), ("features", "Blank", " "),
    ("components", "C++", "c++"), ("components", "Dash", "dash board"), (None, "x", "y"), ("objects", None, "y"), ("objects", "é", "é"), ("objects", "a", "a"), ("objects", "Long", "one two three four five six seven"),
]
TEXTS = [
    (1, "ＱＡＣ の設定"), (2, "qacs and xqac"), (3, "helix\n qac!"), (4, "新ストリーム機能"), (5, "STRASSE straße"), (6, "c++x c++"), (7, "Dash  Board,"), (8, None), (8, ""), (None, "a QAC é"), (9, "qac" * 50), (9, "qac" * 50),
    (10, "one two three four five six seven"), (11, "ones two three four five six seven"), (12, "x" * 100_000 + " qac"), (13, "éa aé"),
]


def frames(spark, texts, catalog):
    return spark.createDataFrame([(*t, "n") for t in texts], TEXT + ", name string"), spark.createDataFrame([(*c, 1) for c in catalog], aliases.CATALOG + ", id int")


def found(rows):
    return sorted(((r.id, r.dimension, r.name) for r in rows.collect()), key=str)


def test_both_plans(spark):
    rows, catalog = frames(spark, TEXTS, CATALOG)
    for itself in (True, False):
        want = plain(TEXTS, CATALOG, itself)
        assert found(aliases.mentions(rows, "id", "text", catalog, itself)) == want
        assert found(aliases.mentions(rows.filter("id <> 12 OR id IS NULL"), "id", "text", catalog, itself, most=0)) == [w for w in want if w[0] != 12]


def test_random_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab é1") for _ in range(n))
    catalog = [("d", f"n{i}", word(rng.randint(1, 9))) for i in range(150)]
    texts = [(i, word(rng.randint(0, 40))) for i in range(60)]
    rows, table = frames(spark, texts, catalog)
    want = plain(texts, catalog)
    assert found(aliases.mentions(rows, "id", "text", table)) == want == found(aliases.mentions(rows, "id", "text", table, most=10))


def test_the_plan_does_not_grow_with_the_catalog(spark):
    rows = frames(spark, TEXTS, CATALOG)[0]
    plans = []
    for n in (3, 3000):
        catalog = spark.createDataFrame([("d", f"n{i}", f"alias {i}") for i in range(n)], aliases.CATALOG)
        plans.append(aliases.mentions(rows, "id", "text", catalog)._jdf.queryExecution().analyzed().treeString().count("\n"))
    assert plans[0] == plans[1]


def test_profiles(spark):
    rows, catalog = frames(spark, [(1, "qac and ストリーム"), (2, "none"), (3, None)], CATALOG)
    got = {r.id: (r.products, r.features) for r in aliases.profiled(rows, "id", "text", catalog, ["products", "features"]).collect()}
    assert got == {1: (["QAC"], ["Stream"]), 2: ([], []), 3: ([], [])}


def test_empty(spark):
    rows, catalog = frames(spark, TEXTS, CATALOG)
    assert found(aliases.mentions(rows, "id", "text", catalog.filter("false"))) == []
    assert found(aliases.mentions(rows.filter("false"), "id", "text", catalog)) == []
    assert found(aliases.mentions(rows.filter("false"), "id", "text", catalog, most=0)) == []
