"""Scores of all chunks for a block of stated queries, in one pass over an index.

An index row has tag columns (none, or such as the way of chunking), document_id, chunk_index, folded (its text) and words (its terms, joined by spaces).
A pass holds the queries' weights as matrices: a chunk's few matching terms pick rows of them, so a chunk is scored for all
queries at once and nothing is shuffled but what the pass returns: the best of each query, kept while a task runs, or all
pairs. Queries are a stated set; they are taken in blocks whose matrices keep to ``BYTES``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold, tokenise, tokens
from caselens.scratch import small, written

K1, B = 1.5, 0.75
PLACES = 6
#: Bytes of one block's matrices and queries in one block.
BYTES, BLOCK = 32 << 20, 4096
#: Scores that one step of a task holds at once, whatever the number of queries: its rows are taken in slices.
CELLS = 1 << 20
#: Hash places that a task remembers.
REMEMBERED = 200_000


class Best:
    """The ``top`` rows of each query that were seen so far, by score and then by their keys; with ``documents`` the best row alone of
    those of one first key."""

    def __init__(self, queries: int, top: int, positive: bool = True, documents: bool = False):
        self.top, self.positive, self.documents = top, positive, documents
        self.least = np.full(queries, -np.inf)
        self.rows: list[np.ndarray] | None = None  # query, score, keys...

    def _reached(self, scores: np.ndarray, key: np.ndarray) -> np.ndarray | float:
        """What the best ``top`` of these rows (of their documents' best) have at least, for each query."""
        if self.documents and len(scores) > self.top:
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            scores = np.maximum.reduceat(scores[order], begins, axis=0)
        at = len(scores) - self.top
        return np.partition(scores, at, axis=0)[at] if at > 0 else -np.inf

    def add(self, scores: np.ndarray, keys: list[np.ndarray]) -> None:
        """Rows of scores (row, query) with the rows' keys; what is no key of a row but told of each pair may follow as matrices."""
        able = scores >= np.maximum(self.least, self._reached(scores, keys[0]))
        if self.positive:
            able &= scores > 0
        at, q = np.nonzero(able)
        new = [q, scores[at, q], *(k[at, q] if k.ndim > 1 else k[at] for k in keys)]
        rows = new if self.rows is None else [np.concatenate(pair) for pair in zip(self.rows, new, strict=True)]
        named = rows[2 : 2 + sum(k.ndim == 1 for k in keys)]
        if self.documents:
            order = np.lexsort((*named[:0:-1], -rows[1], rows[2], rows[0]))
            rows = [r[order] for r in rows]
            first = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])][: len(rows[0])]
            rows = [r[first] for r in rows]
            named = rows[2 : 2 + len(named)]
        order = np.lexsort((*named[::-1], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        begins = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(rows[0]) else np.zeros(0, int)
        place = np.arange(len(rows[0])) - np.repeat(begins, np.diff(np.r_[begins, len(rows[0])]))
        self.rows = [r[place < self.top] for r in rows]
        full = place == self.top - 1
        self.least[rows[0][full]] = rows[1][full]


def slices(rows: int, queries: int) -> Iterator[slice]:
    """Slices of so many rows, each of no more than ``CELLS`` scores, or one row."""
    step = max(1, CELLS // max(1, queries))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


class Counted:
    """The terms of some texts (joined by spaces): ``row``, ``term`` (its place in ``terms``) and ``count`` of each that a text has, by
    text, and the terms of each text, repeats counted."""

    def __init__(self, words: list[str]):
        each = [w.split(" ") if w else [] for w in words]
        self.sizes = np.fromiter(map(len, each), np.int64, len(each))
        codes, self.terms = pd.factorize(np.array([*chain.from_iterable(each)], object))
        kinds = max(1, len(self.terms))
        pairs, count = np.unique(np.repeat(np.arange(len(each)), self.sizes) * kinds + codes, return_counts=True)
        self.row, self.term, self.count = pairs // kinds, pairs % kinds, count.astype(float)


class Hashed:
    """Vectors by feature hashing: the first 8 bytes of a term's SHA-256, modulo ``dimensions``, pick the place, the low bit of
    the ninth the sign, 1 + ln(count) the weight. A task remembers places."""

    def __init__(self, dimensions: int = 256):
        if dimensions < 16:
            raise ValueError("dimensions must be at least 16")
        self.dimensions = dimensions
        self.places: dict[str, tuple[int, float]] = {}

    def place(self, term: str) -> tuple[int, float]:
        """A term's place and sign."""
        if term not in self.places:
            digest = hashlib.sha256(term.encode()).digest()
            if len(self.places) > REMEMBERED:
                self.places.clear()
            self.places[term] = (int.from_bytes(digest[:8], "big") % self.dimensions, 1.0 if digest[8] & 1 else -1.0)
        return self.places[term]

    def vector(self, counts: Counter) -> np.ndarray:
        """The unit vector of counted terms; all zero without any."""
        out = np.zeros(self.dimensions)
        for term, count in counts.items():
            at, sign = self.place(term)
            out[at] += sign * (1 + math.log(count))
        norm = math.sqrt(float(out @ out))
        return out / norm if norm else out

    def vectors(self, counted: Counted) -> np.ndarray:
        """The unit vectors of counted texts, a row each."""
        at, sign = (np.array(x) for x in zip(*map(self.place, counted.terms), strict=True)) if len(counted.terms) else (np.zeros(0, int), np.zeros(0))
        flat = np.bincount(counted.row * self.dimensions + at[counted.term], sign[counted.term] * (1 + np.log(counted.count)), len(counted.sizes) * self.dimensions)
        return unit(flat.astype(float).reshape(len(counted.sizes), self.dimensions))  # whole numbers if no text has a term


@dataclass
class Block:
    """Some queries: their ids, phrases and terms, and the weights of their terms under each tag."""

    ids: list
    phrases: list[str]
    counts: list[Counter]
    k1: float = K1
    b: float = B
    terms: dict[str, int] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)  # of each tag: idf x count, (term, query)
    mean: dict[str, float] = field(default_factory=dict)

    def weigh(self, frequencies: dict[str, dict[str, int]], totals: dict[str, tuple[int, float]]) -> None:
        """Takes the chunks that have a term, all chunks and their mean length, under each tag."""
        self.present = np.zeros((len(self.terms), len(self.ids)))
        times = np.zeros_like(self.present)
        for q, counts in enumerate(self.counts):
            for term, n in counts.items():
                self.present[self.terms[term], q] = 1
                times[self.terms[term], q] = n
        self.sizes = np.array([len(c) for c in self.counts], float)
        for tag, (total, mean) in totals.items():
            df = np.array([frequencies.get(tag, {}).get(t, 0) for t in self.terms], float)
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            self.weights[tag], self.mean[tag] = idf[:, None] * times, mean or 1.0

    def vectors(self, hashed: Hashed) -> np.ndarray:
        return np.array([hashed.vector(c) for c in self.counts]).reshape(len(self.ids), hashed.dimensions).T

    def own(self, hashed: Hashed) -> np.ndarray:
        """``vectors``, made once a task."""
        if getattr(hashed, "asked", None) is None:
            hashed.asked = self.vectors(hashed)
        return hashed.asked

    def scores(self, words: list[str], folded: list[str], tags: list[str], wanted: tuple[str, ...], hashed: Hashed | None = None) -> dict[str, np.ndarray]:
        """Of the wanted scores (bm25, keyword, cosine, covered, phrase) a matrix (chunk, query); 0 where nothing is shared."""
        shape = (len(words), len(self.ids))
        out = {name: np.zeros(shape) for name in wanted}
        counted = Counted(words)
        if "cosine" in wanted:
            out["cosine"] = hashed.vectors(counted) @ self.own(hashed)
        others = set(wanted) - {"cosine"}
        known = np.fromiter((self.terms.get(t, -1) for t in counted.terms), np.int64, len(counted.terms))[counted.term] if others else np.zeros(0, int)
        here = known >= 0
        row, at, tf = (x[here] for x in (counted.row, known, counted.count)) if others else (known, known, known)
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        if "bm25" in wanted:
            length = counted.sizes / np.array([self.mean[t] for t in tags], float)
            gain = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row]))
        phrased = {"keyword", "phrase"} & others
        logs = np.log1p(tf)
        for i in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[i], bounds[i + 1])
            if "bm25" in wanted:
                out["bm25"][i] = gain[own] @ self.weights[tags[i]][at[own]]
            if not others - {"bm25"}:
                continue
            present = self.present[at[own]]
            matched = present.sum(axis=0)
            share = np.divide(matched, self.sizes, out=np.zeros(len(self.sizes)), where=self.sizes > 0)
            if "covered" in wanted:
                out["covered"][i] = share
            if phrased:
                # a phrase can hide its first and last term in longer ones but no other
                near = np.flatnonzero((matched > 0) & (matched >= self.sizes - 2))
                held = np.zeros(len(self.ids))
                held[[q for q in near if self.phrases[q] and self.phrases[q] in folded[i]]] = 1
                if "phrase" in wanted:
                    out["phrase"][i] = held
                if "keyword" in wanted:
                    out["keyword"][i] = np.where(matched > 0, share + 0.05 * (logs[own] @ present) / np.maximum(1, self.sizes) + 0.25 * held, 0)
        for name in out:
            out[name] = np.round(out[name], PLACES) if name in ("bm25", "keyword", "cosine") else out[name]
        return out


def query_rows(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.trim(fold(F.col("query"))).alias("phrase"), tokens(fold(F.col("query"))).alias("terms"))


def blocks(index: DataFrame, queries: DataFrame, tag: str | None = None, k1: float = K1, b: float = B) -> Iterator[Block]:
    """The queries (query_id, query) in blocks, weighed by the statistics of ``index`` under each tag."""
    named = (F.col(tag) if tag else F.lit("")).alias("tag")
    totals = {r[0]: (r[1], r[2]) for r in index.groupBy(named).agg(F.count("*"), F.avg("length")).collect()}  # a row a tag

    def weighed(block: Block) -> Block:
        known = frozenset(block.terms)

        def having(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[str, Counter] = {}
            for batch in batches:
                for t, words in zip(batch["tag"], batch["words"], strict=True):
                    found.setdefault(t, Counter()).update(known.intersection((words or "").split(" ")))
            for t, own in ((t, own) for t, own in found.items() if own):  # Spark takes no frame whose lists are empty
                yield pd.DataFrame({"tag": [t] * len(own), "term": list(own), "n": list(own.values())})

        counts = index.select(named, F.array_join("terms", " ").alias("words")).mapInPandas(having, "tag string, term string, n long").groupBy("tag", "term").agg(F.sum("n"))
        frequencies: dict[str, dict[str, int]] = {}
        for t, term, n in counts.toLocalIterator():  # no more than the block's terms
            frequencies.setdefault(t, {})[term] = n
        block.weigh(frequencies, totals)
        return block

    block = Block([], [], [], k1, b)
    for query_id, phrase, terms in query_rows(queries).toLocalIterator():
        new = len(set(terms or []) - block.terms.keys())
        if block.ids and ((len(block.terms) + new) * (len(block.ids) + 1) * 8 * (1 + len(totals)) > BYTES or len(block.ids) == BLOCK):
            yield weighed(block)
            block = Block([], [], [], k1, b)
        counts = Counter(terms or [])
        for t in counts:
            block.terms.setdefault(t, len(block.terms))
        block.ids.append(query_id)
        block.phrases.append(phrase or "")
        block.counts.append(counts)
    if block.ids:
        yield weighed(block)


def united(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def scored(index: DataFrame, queries: DataFrame, wanted: tuple[str, ...], tag: str | None = None, top: int | None = None, k1: float = K1, b: float = B, dimensions: int = 256) -> DataFrame:
    """(tag, query_id, document_id, chunk_index, scores...): all pairs with a positive score among the wanted bm25, keyword and
    cosine; covered (share of the query's terms) and phrase may be wanted beside. With ``top``, which goes with one wanted score,
    at least the best ``top`` of each query, under its tag: what each task kept."""
    if top is not None and (top <= 0 or len(wanted) > 1):
        raise ValueError("top must be greater than zero, and goes with one score")
    kinds = dict(index.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    names = [*([tag] if tag else []), "query_id", "document_id", "chunk_index"]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + "".join(f", {w} double" for w in wanted)
    ranking = [w for w in wanted if w in ("bm25", "keyword", "cosine")]
    rows = index.select(*([tag] if tag else []), "document_id", "chunk_index", "folded", F.array_join("terms", " ").alias("words"))

    def run(block: Block) -> DataFrame:
        ids = np.array(block.ids)

        def step(batch: pd.DataFrame, hashed: Hashed, best: dict[str, Best]) -> Iterator[pd.DataFrame]:
            tags = list(batch[tag]) if tag else [""] * len(batch)
            keys = [np.array(list(batch[c])) for c in ("document_id", "chunk_index")]
            found = block.scores(list(batch["words"]), list(batch["folded"]), tags, wanted, hashed)
            if top is not None:
                for name in set(tags):
                    own = np.array([t == name for t in tags])
                    best.setdefault(name, Best(len(ids), top)).add(found[wanted[0]][own], [k[own] for k in keys])
                return
            at, q = np.nonzero(sum(found[r] > 0 for r in ranking))
            given = {tag: np.array(tags, object)[at]} if tag else {}
            yield pd.DataFrame(given | {"query_id": ids[q], "document_id": keys[0][at], "chunk_index": keys[1][at]} | {w: found[w][at, q] for w in wanted})

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashed, best = Hashed(dimensions), {}
            for batch in batches:
                for part in slices(len(batch), len(ids)):
                    yield from step(batch.iloc[part], hashed, best)
            for name, kept in best.items():
                q, scores, *own = kept.rows
                given = {tag: [name] * len(q)} if tag else {}
                yield pd.DataFrame(given | {"query_id": ids[q], "document_id": own[0], "chunk_index": own[1], wanted[0]: scores})

        return rows.mapInPandas(score, schema)

    return united([run(block) for block in blocks(index, queries, tag, k1, b)], index.sparkSession, schema)


#: Whether the rows of a batch may be found for the queries with these ids: a matrix (row, query).
Passes = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def leading(index: DataFrame, queries: DataFrame, tops: dict[str, int], modes: dict[str, Passes] | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(search_method, filter_mode, query_id, document_id, chunk_index, score): in one pass over ``index``, of each query, score of ``tops``
    (bm25, keyword, cosine) and mode at least the best so many chunks that the mode lets pass: what each task kept. A mode sees
    ``columns`` of the index; without modes there is one, named by an empty text, which all chunks pass."""
    kinds = dict(index.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"search_method string, filter_mode string, query_id {kinds['query_id']}, document_id {kinds['document_id']}, chunk_index {kinds['chunk_index']}, score double"
    rows = index.select("document_id", "chunk_index", "folded", F.array_join("terms", " ").alias("words"), *columns)

    def run(block: Block) -> DataFrame:
        ids = np.array(block.ids)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashed = Hashed()
            best = {(name, mode): Best(len(ids), top) for name, top in tops.items() for mode in modes or {"": None}}
            for batch in batches:
                for part in slices(len(batch), len(ids)):
                    own = batch.iloc[part]
                    keys = [np.array(list(own[c])) for c in ("document_id", "chunk_index")]
                    found = block.scores(list(own["words"]), list(own["folded"]), [""] * len(own), tuple(tops), hashed)
                    able = {mode: test(own, ids) for mode, test in (modes or {}).items()}
                    for (name, mode), kept in best.items():
                        kept.add(found[name] * able[mode] if able else found[name], keys)
            for (name, mode), kept in best.items():
                if kept.rows is not None:
                    q, scores, *own = kept.rows
                    yield pd.DataFrame({"search_method": name, "filter_mode": mode, "query_id": ids[q], "document_id": own[0], "chunk_index": own[1], "score": scores})

        return rows.mapInPandas(score, schema)

    return united([run(block) for block in blocks(index, queries)], index.sparkSession, schema)


def document_scores(index: DataFrame, queries: DataFrame, wanted: tuple[str, ...], top: int, expected: DataFrame) -> DataFrame:
    """(search_method, query_id, document_id, score) of chunks, for each of the ``wanted`` scores (bm25, keyword, cosine): of each query at
    least the ``top`` documents of the best chunks and all whose score is no less than that of the best document it ``expected``
    (query_id, document_id). So ranks down to the first expected document are those of the whole list, but no pairs behind it leave
    a task. The expected documents are scored first, then all in one pass."""
    kinds = dict(index.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"search_method string, query_id {kinds['query_id']}, document_id {kinds['document_id']}, score double"
    known = list(blocks(index, queries))

    def run(block: Block, rows: DataFrame, least: dict[tuple, float] | None) -> DataFrame:
        ids = np.array(block.ids)
        floor = {m: np.array([0.0 if least is None else least.get((m, i), np.inf) for i in block.ids]) for m in wanted}

        def frame(name: str, q: np.ndarray, documents: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"search_method": np.full(len(q), name, object), "query_id": ids[q], "document_id": documents, "score": scores})

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashed, best = Hashed(), {m: Best(len(ids), top, documents=True) for m in wanted}
            for batch in batches:
                for part in slices(len(batch), len(ids)):
                    own = batch.iloc[part]
                    documents = np.array(list(own["document_id"]))
                    found = block.scores(list(own["words"]), list(own["folded"]), [""] * len(own), wanted, hashed)
                    for m in wanted:
                        at, q = np.nonzero((found[m] > 0) & (found[m] >= floor[m]))
                        yield frame(m, q, documents[at], found[m][at, q])
                        if least is not None:
                            best[m].add(found[m], [documents])
            for m, kept in best.items():
                if kept.rows is not None:
                    q, scores, documents = kept.rows
                    yield frame(m, q, documents, scores)

        return rows.select("document_id", "folded", F.array_join("terms", " ").alias("words")).mapInPandas(score, schema)

    def all_blocks(rows: DataFrame, least: dict[tuple, float] | None) -> DataFrame:
        return united([run(block, rows, least) for block in known], index.sparkSession, schema)

    expected = written(expected.select("query_id", "document_id").distinct(), "expected")
    held = index.join(small(expected.select("document_id").distinct()), "document_id", "left_semi")
    firsts = all_blocks(held, None).join(small(expected), ["query_id", "document_id"], "left_semi").groupBy("search_method", "query_id").agg(F.max("score"))
    return all_blocks(index, {(m, q): s for m, q, s in firsts.toLocalIterator()})  # no more than the queries


def counted(text: str | None) -> Counter:
    """The terms of a text, folded exactly, for use inside tasks."""
    return Counter(tokenise(text))
