"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, which a forward pass gives; that of a text is the product over its words. The piece
probabilities are learned by expectation-maximisation (forward-backward) from the words of a bounded sample of labelled
documents; prediction takes every word of the whole text.

Words are the runs of letters, lower-cased, each with the vocabulary's word mark before it. Defined cases: a null text,
or one without a letter, is ``und`` with score 0; texts and words of any length are read whole, in training too; without any labelled document all texts are; ties go to the language
that sorts first; rows with a null lang or text are never learned from; repeated rows count as often as they occur in
training and each get a prediction; further columns are kept by ``predicted``,
which adds or replaces lang_pred and score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents of each language that are learned from, in expectation; rounds of expectation-maximisation.
SAMPLE, ROUNDS = 500, 4
#: Pseudo-counts of the smoothing towards the vocabulary's mean; probability of a character outside the vocabulary.
PSEUDO, UNKNOWN = 200.0, 1e-7
#: Letters of a word up to which words are scored many at a time; words that a worker remembers.
SHORT, CACHE = 32, 200_000
UND = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter."""
    found = LETTERS.findall((text or "").lower())
    return found if any(map(str.isalpha, found)) else []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(model_file: str) -> list[str]:
    """The pieces of a vocabulary that are made of letters, with or without the word mark, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if LETTERS.fullmatch(p.removeprefix(MARK)) or p == MARK})


class Lattice:
    """All pieces in many words at a time. Substrings are looked up by a polynomial hash, whose values for the
    vocabulary are checked to be distinct; a character outside it is the last id."""

    base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest, self.unknown = pieces, max(map(len, pieces), default=1), len(pieces)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.kind = np.int16 if self.unknown < 1 << 15 else np.int32
        codes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes, self.order = codes[order], order
        assert len(np.unique(codes)) == len(codes), "two pieces share a hash"

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.base) + ord(c) + 1) & (2**64 - 1)
        return h

    def look_up(self, words: list[str]) -> np.ndarray:
        """ids[w, end, length - 1] of the pieces of words (with the mark before them); -1: none."""
        marked = [MARK + w for w in words]
        width = max(map(len, marked))
        chars = np.zeros((len(marked), width), np.uint64)
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), "<u4")
        chars[:] = flat.reshape(len(marked), width)
        sizes = np.array([len(w) for w in marked])
        prefix = np.zeros((len(marked), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * self.base + chars[:, j] + np.uint64(1)
        ids = np.full((len(marked), width + 1, self.longest), -1, self.kind)
        for n in range(1, min(self.longest, width) + 1):
            power = np.uint64(pow(int(self.base), n, 1 << 64))
            codes = prefix[:, n:] - prefix[:, :-n] * power
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            hit = (self.codes[at] == codes) & (np.arange(n, width + 1)[None, :] <= sizes[:, None])
            found = np.where(hit, self.order[at], -1)
            if n == 1:
                found = np.where((found < 0) & (np.arange(n, width + 1)[None, :] <= sizes[:, None]), self.unknown, found)
            ids[:, n:, n - 1] = found
        return ids


@dataclass
class Model:
    """Languages, pieces and probability[piece or unknown, language]."""

    languages: list[str]
    lattice: Lattice
    probability: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        by_size: dict[int, list[int]] = {}
        for i in short:
            by_size.setdefault(len(words[i]), []).append(i)
        for group in by_size.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                ids = self.lattice.look_up([words[i] for i in part])
                out[part] = np.log(forward(ids, self.probability)[:, -1])
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.long_score(w)
        return out

    def long_score(self, word: str) -> np.ndarray:
        """The same for a word of any length, in time linear in it and constant memory."""
        text, lattice, p = MARK + word, self.lattice, self.probability
        recent, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))  # the last sums, and their common factor
        for end in range(1, len(text) + 1):
            total = np.zeros(len(self.languages))
            for n in range(1, min(lattice.longest, end) + 1):
                i = lattice.ids.get(text[end - n : end], lattice.unknown if n == 1 else None)
                if i is not None:
                    total += recent[-n] * p[i]
            recent.append(total)
            if len(recent) > lattice.longest:
                recent.pop(0)
            if end % 16 == 0:
                top = recent[-1]
                scale += np.log(top)
                recent = [r / top for r in recent]
        return scale + np.log(recent[-1])


def forward(ids: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """sums[w, end, language] over the segmentations of each prefix; all words are of one length."""
    n, width, longest = ids.shape
    sums = np.zeros((n, width, probability.shape[1]))
    sums[:, 0] = 1
    for end in range(1, width):
        for size in range(1, min(longest, end) + 1):
            i = ids[:, end, size - 1]
            w = np.flatnonzero(i >= 0)
            if len(w):
                sums[w, end] += sums[w, end - size] * probability[i[w]]
    return sums


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Learns the piece probabilities of each language from the counts of its words, of any length."""
    languages = sorted(counts)
    lattice = Lattice(pieces)
    size = len(pieces) + 1
    learned = np.zeros((size, len(languages)))
    for k, language in enumerate(languages):
        by_size: dict[int, list[str]] = {}
        long = [w for w in sorted(counts[language]) if len(w) > SHORT]
        for w in sorted(counts[language]):
            if len(w) <= SHORT:
                by_size.setdefault(len(w), []).append(w)
        groups = [(lattice.look_up(ws[at : at + 4096]), np.array([counts[language][w] for w in ws[at : at + 4096]], float)) for ws in by_size.values() for at in range(0, len(ws), 4096)]
        p = np.full((size, 1), 1 / size)
        for _ in range(rounds):
            expected = np.zeros(size)
            for ids, times in groups:
                expected += soft_counts(ids, times, p)
            for w in long:
                add_long_counts(expected, w, counts[language][w], lattice, p[:, 0])
            expected[-1] = 0
            p = ((expected + 0.01) / (expected.sum() + 0.01 * size))[:, None]
        learned[:, k] = expected
    mean = (learned / np.maximum(learned.sum(0), 1)).mean(1) if languages else np.zeros(size)
    mean = 0.9 * mean + 0.1 / size
    probability = (learned + PSEUDO * mean[:, None]) / (learned.sum(0) + PSEUDO)
    probability[-1] = UNKNOWN
    return Model(languages, lattice, probability)


def add_long_counts(out: np.ndarray, word: str, times: int, lattice: Lattice, p: np.ndarray) -> None:
    """Adds the expected numbers of the pieces in one word of any length, by sums in logarithms; time is linear in it."""
    text, log = MARK + word, np.log(p)
    size = len(text)
    found = [[] for _ in range(size + 1)]  # (begin, piece) of the pieces that end at each place
    for end in range(1, size + 1):
        for n in range(1, min(lattice.longest, end) + 1):
            i = lattice.ids.get(text[end - n : end], lattice.unknown if n == 1 else None)
            if i is not None:
                found[end].append((end - n, i))
    ahead, back = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    ahead[0] = back[size] = 0.0
    for end in range(1, size + 1):
        ahead[end] = np.logaddexp.reduce([ahead[b] + log[i] for b, i in found[end]])
    for end in range(size, 0, -1):
        for b, i in found[end]:
            back[b] = np.logaddexp(back[b], back[end] + log[i])
    for end in range(1, size + 1):
        for b, i in found[end]:
            out[i] += times * np.exp(ahead[b] + log[i] + back[end] - ahead[size])


def soft_counts(ids: np.ndarray, times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The expected number of each piece over all segmentations of words that occur ``times`` times."""
    n, width, longest = ids.shape
    ahead = forward(ids, p)[:, :, 0]
    back = np.zeros((n, width))
    back[:, -1] = 1
    for end in range(width - 1, 0, -1):
        for size in range(1, min(longest, end) + 1):
            i = ids[:, end, size - 1]
            w = np.flatnonzero(i >= 0)
            back[w, end - size] += back[w, end] * p[i[w], 0]
    out = np.zeros(len(p))
    weight = times / ahead[:, -1]
    for end in range(1, width):
        for size in range(1, min(longest, end) + 1):
            i = ids[:, end, size - 1]
            w = np.flatnonzero(i >= 0)
            out += np.bincount(i[w], weight[w] * ahead[w, end - size] * p[i[w], 0] * back[w, end], minlength=len(p))
    return out


def held_out():
    """Whether a document is never learned from: CRC-32 of its doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE) -> Model:
    """Learns from the text and non-null lang of documents that are not held out: of each language a hash of the doc_id
    picks ``sample`` documents in expectation, whole. The driver gets the counts of their words alone."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return fit({}, pieces_of(vocabulary or default_vocabulary()))
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"})

    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    summed = picked.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for lang, word, n in summed.toPandas().itertuples(index=False):
        counts[lang][word] = int(n)
    return fit({k: v for k, v in counts.items() if v}, pieces_of(vocabulary or default_vocabulary()))


class Scorer:
    """Predicts texts; a worker remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.rows)
        if not new:
            return
        if len(self.rows) + len(new) > CACHE:
            self.rows, self.table, new = {}, self.table[:0], sorted(words)
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, self.model.word_scores(new)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for at in range(0, len(texts), 256):
            lists = [words_of(t) for t in texts[at : at + 256]]
            self.learn(set().union(*lists))
            for words in lists:
                if not words or not self.model.languages:
                    out.append((UND, 0.0))
                    continue
                logs = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(np.argmax(logs))
                out.append((self.model.languages[best], 1 / float(np.exp(logs - logs[best]).sum())))
        return out


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language among those learned. Only the text is read."""
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.DataFrame(scorer.predict(list(batch)), columns=["lang_pred", "score"])

    predict = predict.asNondeterministic()  # else a filter of its result would be a second prediction
    own = [c for c in docs.columns if c not in schema.names]
    return docs.select(*own, predict("text").alias("_p")).select(*own, "_p.lang_pred", "_p.score")


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    out = predicted(docs.select("doc_id", "text"), train(docs, sample=sample))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that have no letter, in their own columns."""
    found = predicted(docs.select(F.struct("*").alias("row"), "text"), train(docs, sample=sample))
    return found.filter(F.col("lang_pred") != UND).select("row.*")


def tagged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that have no letter, with lang_pred and score."""
    return predicted(docs, train(docs, sample=sample)).filter(F.col("lang_pred") != UND)
