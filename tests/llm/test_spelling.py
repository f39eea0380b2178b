"""Spelling variants beside a plain version over all pairs of words."""

import random
from zlib import crc32

from caselens.llm import spelling
from caselens.llm.common import written

SCHEMA = "doc_id long, text string"


def plain_words(rows):
    out = {}
    for doc_id, text in rows:
        run, marked = "", []
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                marked.append(run)
                run = ""
        for run in marked:
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """word: (form, root, n, n_near, form_n)"""
    form, out = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out[w] = len(close)
    found = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, n, out[w], counts[form[w]] if form[w] else None)
    return found


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed, words, alphabet="abé", long=9):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, long))) for _ in range(words)]
    return [(i, " ".join(rng.choice(pool[: 1 + int(len(pool) * rng.random() ** 2)]) for _ in range(60))) for i in range(50)]


def test_documents(spark):
    rows = texts(1, 200) + [(None, "hello hello hello helo, Hello HELLO! hella hella hella"), (7, None), (8, ""), (9, "a×b " * 3), (9, "a×b " * 3)]
    rows += [(100 + i, "Überschuß überschuß überschuß übershcuß don't naïveté naïveté’s naïveté") for i in range(200)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA + ", word string")
    assert result(spelling.report(docs)) == plain(plain_words(rows))


def test_frequent_segments_are_cut_again(spark):
    """With few letters nearly all keys are frequent: all cuts down to one code point are taken, none loses or repeats a pair."""
    counts = plain_words(texts(2, 400, "ab", 8) + [(-1, "ab" * 5000 + " " + "ab" * 5000 + "b " + "ab" * 5000 + " " + "ab" * 5000)])
    vocabulary = written(spark.createDataFrame(list(counts.items()), "word string, n long"), "vocabulary")
    want = sorted(tuple(sorted((a, b))) for a in counts for b in counts if a < b and near(a, b))
    for pairs in (0, 1, 50, spelling.PAIRS):
        got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(vocabulary, pairs).collect())
        assert got == want, pairs


def test_chains_and_ties(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc", "bbccc"]
    counts = {w: 3 * 2**i for i, w in enumerate(chain)} | {"zzzzz": 9, "zzzzy": 18, "zzzzx": 18, "lonely": 5}
    vocabulary = written(spark.createDataFrame(list(counts.items()), "word string, n long"), "vocabulary")
    got = result(spelling.rooted(written(spelling.forms(vocabulary), "forms")))
    assert got == plain(counts) and got["aaaaa"][1] == "bbccc" and got["zzzzz"][0] == "zzzzx"


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.report(empty).collect() == [] and spelling.report(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    rows = texts(3, 300)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = {r.word: r.n for r in spelling.words(docs).collect()}
    monkeypatch.setattr(spelling, "HELD", 10)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == whole == plain_words(rows)
