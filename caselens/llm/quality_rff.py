"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each whole text gives a few statistics (shares of kinds of characters, of distinct and of repeated words, lengths). Cosines
of random projections of the standardised statistics approximate a Gaussian kernel. The normal equations of ridge
regression on them are sums over documents: each task sums its own, and the sums are added cell by cell, for each of a few
folds. The driver gets these sums, whose number is fixed by the parameters, chooses the penalty by the error on the folds
left out, and solves. Scores that each fold gets from the others' sums are rounded to a grid, and the labels' means on it
are made monotone (pool adjacent violators): the calibration that turns a score into a probability.

Labels are learned from rows that are not held out; nothing but the text enters a score. All labelled rows are learned
from, with no sample. Defined cases: a null text counts as empty, and an empty text has a score like any other; texts
of any length are read whole; of several labels of a doc_id the largest counts; null labels and labels of a null doc_id
are not learned from; rows that repeat a doc_id each count; equal texts get equal scores; without any label all scores
are 0.5; an empty table gives an empty result; further columns are kept by ``scored``, which adds or replaces score, and are
not read by ``report``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Random frequencies, their seed, the kernel's width over the root of the number of statistics, and the folds.
FEATURES, SEED, WIDTH, FOLDS = 128, 7, 1.0, 4
#: Penalties to choose from, as a share of the number of learned rows; steps of the grid of scores, which lie in -1 to 2.
PENALTIES, GRID = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1), 1024
#: The score from which a document is predicted to be good.
THRESHOLD = 0.3
#: Bytes whose kinds are counted at a time.
CHUNK = 1 << 20
#: Kinds of bytes: white space, digits, capitals, and marks that prose has or seldom has.
KINDS = [b"\n\r", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~"]
STATISTICS = len(KINDS) + 9


def statistics(text: str | None) -> list[float]:
    """What is measured on a whole text; all are 0 on an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(256, np.int64)
    for at in range(0, len(raw), CHUNK):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at), minlength=256)
    size = len(raw) - int(counts[128:192].sum())  # code points: bytes that do not go on with one
    found = (text or "").split()
    n, distinct = max(1, len(found)), Counter(found)
    repeated = sum(a == b for a, b in zip(found, found[1:], strict=False))
    top = max(distinct.values(), default=0)
    lines = 1 + int(counts[10])
    per = max(1, size)
    kinds = [int(counts[list(kind)].sum()) / per for kind in KINDS]
    lettered = sum(map(str.isalpha, distinct)) / max(1, len(distinct))
    lengths = [np.log1p(size), np.log1p(len(found)), np.log1p(size / n), np.log1p(size / lines) if size else 0.0]
    return [*kinds, *lengths, int(counts[192:].sum()) / per, len(distinct) / n, repeated / n, top / n, lettered]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_column(text: pd.Series) -> pd.Series:
    return text.map(statistics)


def projection(features: int = FEATURES, seed: int = SEED, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies (statistic, feature) and phases of a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(STATISTICS, features)) / (width * np.sqrt(STATISTICS)), rng.uniform(0, 2 * np.pi, features)


@dataclass
class Basis:
    """Random Fourier features of statistics, standardised by ``mean`` and ``spread``."""

    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    def of(self, rows: list) -> np.ndarray:
        """One row of features for each row of statistics, the last one constant."""
        x = np.array(rows, float).reshape(-1, STATISTICS)
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([cosines, np.ones((len(x), 1))])


@dataclass
class Model:
    """Weights on a basis, and the calibration: probabilities at scores on the grid."""

    basis: Basis
    weights: np.ndarray
    at: np.ndarray
    probability: np.ndarray

    def score(self, rows: list) -> np.ndarray:
        if not len(self.at):
            return np.full(len(rows), 0.5)
        return np.interp(rounded(self.basis.of(rows) @ self.weights) / GRID, self.at, self.probability)


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(np.clip(scores, -1, 2) * GRID).astype("int64")


def held_out():
    """Whether labels of a document are never learned from: CRC-32 of its doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sums(rows: DataFrame, basis: Basis) -> dict[int, np.ndarray]:
    """For each fold the sums over its rows (x, label, fold) of the products of all pairs of features and the label:
    each task sums its rows, and the tasks' sums are added cell by cell."""
    size = len(basis.phases) + 2

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            full = np.hstack([basis.of(list(batch["x"])), batch["label"].to_numpy(float)[:, None]])
            for fold in batch["fold"].unique():
                part = full[(batch["fold"] == fold).to_numpy()]
                found[fold] = found.get(fold, 0) + part.T @ part
        for fold, total in found.items():
            yield pd.DataFrame({"fold": int(fold), "cell": np.arange(size * size), "value": total.ravel()})

    out = {}
    total = rows.select("x", "label", "fold").mapInPandas(products, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value"))
    for fold, cells in total.toPandas().groupby("fold"):  # size x size numbers of each fold
        matrix = np.zeros(size * size)
        matrix[cells["cell"]] = cells["value"]
        out[int(fold)] = matrix.reshape(size, size)
    return out


def solved(total: np.ndarray, penalty: float) -> np.ndarray:
    """The ridge weights of summed products; the constant is not penalised."""
    a, b = total[:-1, :-1], total[:-1, -1]
    ridge = np.full(len(a), penalty * total[-2, -2])
    ridge[-1] = 1e-9
    return np.linalg.solve(a + np.diag(ridge), b)


def error(total: np.ndarray, w: np.ndarray) -> float:
    """The sum of squared errors of weights over the rows of summed products."""
    return float(total[-1, -1] - 2 * w @ total[:-1, -1] + w @ total[:-1, :-1] @ w)


def isotonic(at: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the non-decreasing means of ``good`` of ``rows`` at ascending scores, as (score, mean) at
    both ends of each pool, between which a score is interpolated."""
    pools: list[list[float]] = []  # first score, last score, good, rows
    for s, g, n in zip(at, good, rows, strict=True):
        pools.append([s, s, g, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, g, n = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = last, pools[-1][2] + g, pools[-1][3] + n
    ends = [(p[k], p[2] / p[3]) for p in pools for k in ((0, 1) if p[0] < p[1] else (0,))]
    return np.array([e[0] for e in ends], float), np.array([e[1] for e in ends], float)


def train(measured: DataFrame, labels: DataFrame, features: int = FEATURES, folds: int = FOLDS) -> Model:
    """Learns from ``measured`` (doc_id, x: statistics) and ``labels`` (doc_id, quality) that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("x"), F.lit(folds)).cast("int").alias("fold")  # by the statistics, so that copies are in one fold
    rows = written(measured.join(known, "doc_id").select("x", "label", fold), "labelled")
    one = rows.select([F.struct(F.avg(F.col("x")[k]), F.stddev_pop(F.col("x")[k])).alias(str(k)) for k in range(STATISTICS)]).first()
    frequencies, phases = projection(features)
    mean = np.array([v[0] or 0.0 for v in one])
    spread = np.array([v[1] or 1.0 for v in one])
    basis = Basis(mean, spread, frequencies, phases)
    parts = sums(rows, basis)
    if not parts:
        return Model(basis, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    total = sum(parts.values())
    rest = {k: total - part if len(parts) > 1 else total for k, part in parts.items()}
    penalty = min(PENALTIES, key=lambda p: sum(error(parts[k], solved(rest[k], p)) for k in parts))
    weights = {k: solved(rest[k], penalty) for k in parts}

    def crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = basis.of(list(batch["x"]))
            scores = np.einsum("ij,ij->i", z, np.array([weights[k] for k in batch["fold"]]).reshape(z.shape))
            yield pd.DataFrame({"at": rounded(scores), "label": batch["label"].to_numpy()})

    grid = rows.mapInPandas(crossed, "at long, label int").groupBy("at").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    found = grid.toPandas().sort_values("at")  # at most 3 x GRID + 1 scores
    at, probability = isotonic(found["at"].to_numpy() / GRID, found["good"].to_numpy(float), found["n"].to_numpy(float))
    return Model(basis, solved(total, penalty), at, probability)


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` (without a column score) with score in place of x, its statistics."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(x)))

    own = [c for c in measured.columns if c != "x"]
    return measured.select(*own, score("x").alias("score"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score: the calibrated probability that a document is good. Statistics are taken twice, once to learn and
    once to score, so that texts are never written again."""
    model = train(docs.select("doc_id", statistics_column("text").alias("x")), labels)
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns if c.lower() != "score"]).alias("row"), statistics_column("text").alias("x"))
    return apply(row, model).select("row.*", "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    measured = written(docs.select("doc_id", statistics_column("text").alias("x")), "statistics")
    out = apply(measured, train(measured, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
