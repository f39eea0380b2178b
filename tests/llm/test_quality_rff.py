"""The quality classifier: its sums, its calibration and its accuracy on held-out labels."""

import os
import random

import numpy as np
import pytest

from caselens.llm import quality_rff as q
from caselens.llm.common import written

DATA = "/root/testdata/sf0.01"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        found = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            found = [[w + "&&&" for w in found], [w.upper() + "!!" for w in found], found[:1] * len(found)][i // 4 % 3]
        rows.append((i, " ".join(found) + ".", "src", -1.0))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_keeps_every_row(spark):
    rows, labels = corpus()
    odd = [(None, "no id here", "s", 0.0), (900, None, "s", 0.0), (901, "", "s", 0.0), (902, "x" * 200_000, "s", 0.0), (903, "  \n\t", "s", 0.0), (5, rows[5][1], "s", 0.0)]
    docs, known = frames(spark, rows + odd, labels + [(None, 1, 0), (901, None, 0), (7, 0, 1), (904, 1, 0)])
    got = q.report(docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.held_out))
    assert all(len(x) == 1 for x in by.values()), "equal texts, equal scores"
    assert {s for s, _ in by[900]} == {s for s, _ in by[901]}
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark):
    rows, labels = corpus(120)
    docs, known = frames(spark, rows, labels)
    held = {r.doc_id for r in docs.select("doc_id", q.held_out().alias("h")).filter("h").collect()}
    turned = [(i, 1 - y if i in held else y, 1 - t) for i, y, t in labels]
    moved = spark.createDataFrame([(i, t, f"other{i}", 9.0) for i, t, _, _ in rows], docs.schema)
    score = lambda df: {r.doc_id: r.score for r in df.collect()}
    a, b = score(q.report(docs, known)), score(q.report(moved, frames(spark, rows, turned)[1]))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_columns_are_kept(spark):
    rows, labels = corpus(60)
    docs, known = frames(spark, rows, labels)
    got = q.scored(docs, known)
    assert got.columns == ["doc_id", "text", "source", "score"] and got.filter("score < 0").count() == 0
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r[0], r[1]) for r in rows}


def test_summed_normal_equations(spark):
    rows, labels = corpus(100)
    docs, known = frames(spark, rows, labels)
    table = written(docs.join(known, "doc_id").select(q.statistics_column("text").alias("x"), q.F.col("quality").alias("label"), (q.F.col("doc_id") % 3).cast("int").alias("fold")).repartition(5), "t")
    basis = q.Basis(np.zeros(q.STATISTICS), np.ones(q.STATISTICS), *q.projection(16))
    got = q.sums(table, basis)
    for fold in range(3):
        part = table.filter(f"fold = {fold}").toPandas()
        z = np.hstack([basis.of(list(part["x"])), part["label"].to_numpy(float)[:, None]])
        assert np.allclose(got[fold], z.T @ z)
    total = sum(got.values())
    w = q.solved(total, 1e-3)
    part = table.toPandas()
    z, y = basis.of(list(part["x"])), part["label"].to_numpy(float)
    ridge = np.diag([1e-3 * len(y)] * 16 + [1e-9])
    assert np.allclose(w, np.linalg.solve(z.T @ z + ridge, z.T @ y)) and np.isclose(q.error(total, w), ((z @ w - y) ** 2).sum())


def test_kernel():
    """Products of features approach the Gaussian kernel as they grow in number."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, q.STATISTICS))
    basis = q.Basis(np.zeros(q.STATISTICS), np.ones(q.STATISTICS), *q.projection(20_000))
    z = basis.of(list(x))[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-far / (2 * q.WIDTH**2 * q.STATISTICS))).max() < 0.05


def test_isotonic():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        at, rows = np.sort(rng.choice(1000, n, replace=False)), rng.integers(1, 9, n).astype(float)
        good = np.array([rng.integers(0, r + 1) for r in rows], float)
        x, y = q.isotonic(at, good, rows)
        assert (np.diff(y) > -1e-12).all() and (np.diff(x) > 0).all()
        fit, mean = np.interp(at, x, y), good / rows
        # the least-squares monotone fit is the largest of the smallest means of intervals
        want = [max(min(good[i : j + 1].sum() / rows[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(fit, want), (mean, fit, want)


def test_statistics():
    assert q.statistics(None) == q.statistics("") and len(q.statistics("")) == q.STATISTICS and not any(q.statistics("")[:-1])
    a, b = q.statistics("Aé 1! " * 400_000), q.statistics("Aé 1! " * 4)
    assert np.allclose(a[: len(q.KINDS)], b[: len(q.KINDS)])
    assert all(np.isfinite(q.statistics(t)).all() for t in [" ", "\n", "x", "𝄞" * 5, "a a a a"])


def test_no_labels_and_empty(spark):
    rows, labels = corpus(8)
    docs, known = frames(spark, rows, labels)
    none = known.filter("false")
    assert {r.score for r in q.report(docs, none).collect()} == {0.5}
    assert q.report(docs.filter("false"), known).collect() == []
    one = q.report(docs, known.filter("quality = 1")).collect()
    assert len(one) == 8 and all(0 <= r.score <= 1 for r in one)


def test_held_out_accuracy_on_the_tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = q.report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and (got["predicted"] == got["quality"]).mean() > 0.95
