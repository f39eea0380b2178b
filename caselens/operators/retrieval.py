"""Keyword, BM25, vector and fused retrieval over chunks.

Chunks are rows (document_id, chunk_index, text); queries are rows (query_id, query), a stated set. Chunks are folded and
tokenised once, as an index that all searches and rerankers share; a search reads it once for all queries (``scoring``) and
keeps the best of each while a task runs. Scores are rounded to six places before they are ranked, and ties go by document and chunk.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.text import fold, tokens
from caselens.scratch import small, written

from . import scoring
from .scoring import K1, PLACES, B

#: Rows of the query matrix that one pass over the corpus takes.
QUERY_BLOCK = 4096


def with_terms(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their folded text, terms and length (terms, repeats counted)."""
    folded = chunks.withColumn("folded", fold(F.col("text")))
    return folded.withColumn("terms", tokens(F.col("folded"))).withColumn("length", F.size("terms"))


def indexed(chunks: DataFrame, tag: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(tag, document_id, chunk_index, folded, terms, length, columns...) of ``chunks``, folded and tokenised and written once; an index
    is given back as it is, so several searches and rerankers can share one."""
    if "terms" in chunks.columns:
        return chunks
    return written(with_terms(chunks).select(*([tag] if tag else []), "document_id", "chunk_index", "folded", "terms", "length", *columns), "index")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows per query of (query_id, document_id, chunk_index, score), with their rank from 1."""
    if top <= 0:
        raise ValueError("top must be greater than zero")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, top: int | None = None) -> DataFrame:
    """(query_id, document_id, chunk_index, score) of every chunk that shares a term, or with ``top`` of no fewer than the best.
    Document frequencies and lengths are those of all ``chunks`` (or their index): filter afterwards."""
    return scoring.scored(indexed(chunks), queries, ("bm25",), top=top, k1=k1, b=b).withColumnRenamed("bm25", "score")


def keyword(chunks: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, document_id, chunk_index, score): share of the query's terms, a bonus for their frequency, and one
    for the whole query as a phrase."""
    return scoring.scored(indexed(chunks), queries, ("keyword",), top=top).withColumnRenamed("keyword", "score")


def hash_embedder(dimensions: int = 256):
    """A column function from a text to the unit vector of its terms by feature hashing (``scoring.Hashed``). Another provider is
    any function from a column of texts to a column of arrays of one width."""
    scoring.Hashed(dimensions)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashed = scoring.Hashed(dimensions)
        for batch in batches:
            yield batch.map(lambda t: hashed.vector(scoring.counted(t)))

    return embed


def embedded(chunks: DataFrame, dimensions: int = 256) -> DataFrame:
    """(document_id, chunk_index, vector) of each chunk."""
    return chunks.select("document_id", "chunk_index", hash_embedder(dimensions)("text").alias("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, top: int, places: int = PLACES, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """(query_id, ids..., score, rank): the ``top`` vectors of the greatest cosine for each query, exactly. ``vectors`` has
    ``ids`` (whole numbers that name a row together) and vector, ``queries`` (query_id, vector). Blocks of the queries, a
    stated set, go to the tasks as a matrix; a task multiplies each batch of vectors once and keeps its best, which one window
    per query then merges."""
    kinds = ", ".join(f"{c} long" for c in ids)

    def search(block: list) -> DataFrame:
        names = np.array([r[0] for r in block], np.int64)
        matrix = scoring.unit(np.array([r[1] for r in block], np.float64))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = scoring.Best(len(names), top, positive=False)
            for batch in batches:
                for part in scoring.slices(len(batch), len(names)):
                    rows = batch.iloc[part]
                    own = [rows[c].to_numpy(np.int64) for c in ids]
                    kept.add(np.round(scoring.unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)) @ matrix.T, places), own)
            if kept.rows is not None:
                q, scores, *own = kept.rows
                yield pd.DataFrame({"query_id": names[q], **dict(zip(ids, own, strict=True)), "score": scores})

        return vectors.select(*ids, "vector").mapInPandas(best, f"query_id long, {kinds}, score double")

    out, block = None, []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            part, block = search(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = search(block) if block else vectors.sparkSession.createDataFrame([], f"query_id long, {kinds}, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ids)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def fused(left: DataFrame, right: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: (query_id, document_id, chunk_index, score)."""
    both = left.select("query_id", "document_id", "chunk_index", "rank").unionByName(right.select("query_id", "document_id", "chunk_index", "rank"))
    return both.groupBy("query_id", "document_id", "chunk_index").agg(F.round(F.sum(1 / (constant + F.col("rank"))), PLACES).alias("score"))


def reranked(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """The pool of max(20, 4 * ``top``) candidates ordered anew by base score, covered terms and the phrase. ``chunks`` are the
    chunks or their index; only those of the pool are read again."""
    pool = written(candidates.filter(F.col("rank") <= max(20, 4 * top)), "pool")
    base = F.col("score") / F.coalesce(F.nullif(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0))
    asked = queries.select("query_id", fold(F.col("query")).alias("asked")).select("query_id", F.array_distinct(tokens(F.col("asked"))).alias("asked"), F.trim("asked").alias("phrase"))
    wanted = chunks.join(small(pool.select("document_id", "chunk_index").distinct()), ["document_id", "chunk_index"], "left_semi")
    text = (wanted if "terms" in chunks.columns else with_terms(wanted)).select("document_id", "chunk_index", "folded", "terms")
    rows = pool.withColumn("base", base).join(small(asked), "query_id").join(text, ["document_id", "chunk_index"])
    covered = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "terms")) / F.size("asked")).otherwise(0.0)
    phrase = F.when((F.col("phrase") != "") & F.contains("folded", "phrase"), 0.1).otherwise(0.0)
    scored = rows.select("query_id", "document_id", "chunk_index", F.round(0.7 * F.col("base") + 0.3 * covered + phrase, PLACES).alias("score"))
    return ranked(scored, top)


def lists(index: DataFrame, queries: DataFrame, tops: dict[str, int]) -> dict[str, DataFrame]:
    """Of each score of ``tops`` (bm25, keyword, cosine) the list of its best so many chunks of each query, with rank: all by one pass."""
    found = written(scoring.leading(index, queries, tops).drop("filter_mode"), "leading")
    return {name: ranked(found.filter(F.col("search_method") == name).drop("search_method"), top) for name, top in tops.items()}


class Search(Protocol):
    """A search: over an index (``indexed``) and queries (query_id, query), (query_id, document_id, chunk_index, score) of no fewer than
    the best ``top`` of each query; ``pool`` is how many of each list a fusion takes."""

    def __call__(self, index: DataFrame, queries: DataFrame, top: int, pool: int) -> DataFrame: ...


class Reranker(Protocol):
    """A reranker: ranked candidates in a new order, ``top`` of each query, with rank."""

    def __call__(self, candidates: DataFrame, index: DataFrame, queries: DataFrame, top: int) -> DataFrame: ...


def cosine(index: DataFrame, queries: DataFrame, top: int, dimensions: int = 256) -> DataFrame:
    """(query_id, document_id, chunk_index, score) by feature-hashed vectors of the terms, greater than 0."""
    return scoring.scored(index, queries, ("cosine",), top=top, dimensions=dimensions).withColumnRenamed("cosine", "score")


def _hybrid(index: DataFrame, queries: DataFrame, top: int, pool: int) -> DataFrame:
    return fused(*lists(index, queries, {"bm25": pool, "cosine": pool}).values())


#: The searches and rerankers by name; others are added by their names.
SEARCHES: dict[str, Search] = {
    "keyword": lambda index, queries, top, pool: keyword(index, queries, top=top),
    "bm25": lambda index, queries, top, pool: bm25(index, queries, top=top),
    "hash_embedding": lambda index, queries, top, pool: cosine(index, queries, top),
    "hybrid": _hybrid,
}
RERANKERS: dict[str, Reranker] = {"none": lambda candidates, index, queries, top: candidates.filter(F.col("rank") <= top), "lexical": reranked}


def search(index: DataFrame, queries: DataFrame, top: int, method: str = "bm25", reranker: str = "none", pool: int = 50) -> DataFrame:
    """The best ``top`` chunks of each query by a registered search and reranker, with rank. Unknown names raise."""
    if method not in SEARCHES or reranker not in RERANKERS:
        raise ValueError(f"unsupported search method or reranker: {method}, {reranker}")
    if top <= 0:
        raise ValueError("top must be greater than zero")
    taken = top if reranker == "none" else max(20, 4 * top)
    return RERANKERS[reranker](ranked(SEARCHES[method](index, queries, taken, pool), taken), index, queries, top)


def searches(index: DataFrame, queries: DataFrame, top: int, pool: int = 50) -> dict[str, DataFrame]:
    """The ranked lists of all registered searches, as long as a reranker to ``top`` wants them. The scores of those that are built in
    come from one pass."""
    wide = max(20, 4 * top)
    found = lists(index, queries, {"keyword": wide, "bm25": max(wide, pool), "cosine": max(wide, pool)})
    best = lambda name, most: found[name].filter(F.col("rank") <= most)
    out = {"keyword": found["keyword"], "bm25": best("bm25", wide), "hash_embedding": best("cosine", wide)}
    out["hybrid"] = ranked(fused(best("bm25", pool), best("cosine", pool)), wide)
    return {name: out[name] if name in out else ranked(method(index, queries, wide, pool), wide) for name, method in SEARCHES.items()}


# The metadata that is searched with the text, in order, and the columns that each filter mode compares.
SEARCHED = ["product", "version", "case_type", "question", "error_summary", "cause", "solution", "vendor_answer", "customer_answer"]
FILTER_MODES = {"none": [], "product": ["product"], "product_and_version": ["product", "version"]}


def searchable(columns: list[str] | None = None) -> Column:
    """The text and the non-empty metadata values, one a line."""
    return F.concat_ws("\n", "text", *(F.nullif(F.col(c), F.lit("")) for c in (SEARCHED if columns is None else columns)))


def meets(rows: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """The rows whose columns equal the wanted values after folding and trimming; a null value lets all pass, a null
    column meets none."""
    for column, value in wanted.items():
        if value is not None:
            same = F.trim(fold(F.col(column))) == F.lit(unicodedata.normalize("NFKC", value).strip().casefold())
            rows = rows.filter(F.coalesce(same, F.lit(False)))
    return rows


def filtered(scores: DataFrame, chunks: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    """``scores`` of the chunks that meet the product, or product and version, of their query (null: any), by ``mode``.
    ``chunks`` has (document_id, chunk_index, product, version), ``queries`` (query_id, product, version)."""
    columns = FILTER_MODES[mode]
    if not columns:
        return scores
    form = lambda c: F.trim(fold(F.col(c)))
    own = chunks.select("document_id", "chunk_index", *(form(c).alias(c) for c in columns))
    asked = queries.select("query_id", *(form(c).alias(f"_{c}") for c in columns))
    rows = scores.join(own, ["document_id", "chunk_index"]).join(small(asked), "query_id")
    for c in columns:
        rows = rows.filter(F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    return rows.select(*scores.columns)


def passes(queries: DataFrame) -> dict[str, scoring.Passes]:
    """Each filter mode as a test inside a task (``scoring.leading``) of rows with product and version, folded and trimmed, for
    ``queries`` (query_id, product, version), a stated set: the rule of ``filtered``."""
    form = lambda c: F.trim(fold(F.col(c))).alias(c)
    wanted = {r[0]: r for r in queries.select("query_id", form("product"), form("version")).toLocalIterator()}

    def test(columns: list[str]) -> scoring.Passes:
        def passed(batch: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
            out = np.ones((len(batch), len(ids)), bool)
            for c in columns:
                codes, kinds = pd.factorize(batch[c].to_numpy(object), use_na_sentinel=False)
                asked = [wanted[i][c] for i in ids]
                out &= np.array([[w is None or w == k for w in asked] for k in kinds], bool).reshape(len(kinds), len(ids))[codes]
            return out

        return passed

    return {mode: test(columns) for mode, columns in FILTER_MODES.items()}


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, document_id) of the documents whose text holds the passage: one pass with an automaton over the
    passages (query_id, query), a stated set."""
    known = [(r[0], r[1]) for r in passages.select("query_id", "query").toLocalIterator() if r[1]]

    @F.pandas_udf("array<long>")
    def held(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        ids: dict[str, list[int]] = {}
        for i, text in known:
            ids.setdefault(text, []).append(i)
        for text, who in ids.items():
            automaton.add_word(text, who)
        automaton.make_automaton()
        for batch in texts:
            yield batch.map(lambda t: sorted({i for _, who in automaton.iter(t or "") for i in who}) if ids else [])

    return docs.select(F.col("doc_id").alias("document_id"), F.explode(held("text")).alias("query_id")).select("query_id", "document_id")
