"""Spelling variants: words that differ by one edit, found by an even-partition pigeonhole join.

A word of length l is cut in two even segments. One edit touches one of them, so of two words of equal length one segment
is equal at its place, and of a word and a longer one by one code point the first segment is equal at its place or the
second one shifted by one. Words are indexed by their two segments; words of the same length, and those longer by one,
probe with the substrings at these places; equal keys are joined and each candidate is verified to be one edit away.

Frequent segments: a key of more than ``PAIRS`` candidate pairs is never joined. Its words' other segment, in which the
edit must lie, is cut again in two by the same rule, and so on, until a key has few pairs or the part that may differ is
one code point. So no bucket is compared in whole, whatever the vocabulary's size, and no pair is lost.

The counts of words, the keys and the pairs are all aggregates and equality joins; Python only cuts texts into words.

Defined cases: a null text has no words; a null doc_id is written as nothing before the colon; texts and words of any
length are read whole; repeated rows count as often as they occur; ties go to the smaller word in code-point order; an
empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Code points and occurrences that a word has at least; the number that marks a run for deletion.
SHORTEST, RAREST, MARK = 5, 3, 97
#: Candidate pairs up to which a key is joined; beyond it its words are cut once more.
PAIRS = 4096
#: Words whose counts a task holds before it passes them on.
HELD = 200_000
RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None) -> Counter:
    """How often each maximal run of letters occurs in a text, with A-Z lower-cased."""
    return Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))


def add_words(counts: Counter, doc_id, text: str | None) -> None:
    """Adds the words of a document: its runs, some without the code point that the hash of doc_id and run names."""
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs(text).items():
        h = crc32(run.encode(), start)
        if h % MARK == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            counts[run] += n


def words(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences over all ``docs`` (doc_id, text); short and rare words are left out."""

    def frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                add_words(held, doc_id, text)
                if len(held) > HELD:
                    yield frame(held)
                    held = Counter()
        yield frame(held)

    cut = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return cut.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, longer, size, a, b) twice: with either half of [a, b), the part in which it may differ from a word of
    ``size``, taken as equal. ``key`` is what lies outside the part that remains; a longer word's part is longer by one."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(mid.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), mid.alias("b")))
    both = rows.withColumn("_p", F.explode(parts)).withColumn("a", F.col("_p.a")).withColumn("b", F.col("_p.b")).drop("_p")
    head = F.substring(F.col("word"), F.lit(1), F.col("a"))
    tail = F.substring(F.col("word"), F.col("b") + F.col("longer") + 1, F.col("size"))
    return both.withColumn("key", F.xxhash64("size", "a", "b", head, tail))


def one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def joined(rows: DataFrame) -> DataFrame:
    """The verified pairs (a, n_a, b, n_b) of rows with equal keys: an indexed word and one that probes."""
    index = rows.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    probe = rows.select(F.col("key").alias("_key"), F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return index.join(probe, (F.col("key") == F.col("_key")) & once & one_edit("a", "b")).select("a", "n_a", "b", "n_b")


def near_pairs(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """All pairs of words one edit apart, each once: a, n_a, b, n_b. ``vocabulary`` (word, n; written) has each word once."""
    size = F.char_length("word")
    own = vocabulary.select("word", "n", F.lit(0).alias("longer"), size.alias("size"))
    probes = vocabulary.select("word", "n", F.lit(1).alias("longer"), (size - 1).alias("size")).filter(F.col("size") > 0)
    rows = own.unionByName(probes).select("*", F.lit(0).alias("a"), F.col("size").alias("b"))
    found = None
    while True:
        keyed = written(halved(rows), "segments")
        sizes = keyed.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("_own"), F.count("*").alias("_all"))
        sizes = written(sizes.filter("_own > 0 AND _all > 1").select("key", (F.col("_own") * F.col("_all") > pairs).alias("_hot")), "segment-sizes")
        keyed = keyed.join(sizes, "key")  # keys of one word, or without an indexed one, have no pair
        open_ = F.col("_hot") & (F.col("b") - F.col("a") > 1)
        here = written(joined(keyed.filter(~open_)), "variants")
        found = here if found is None else found.unionByName(here)
        rows = written(keyed.filter(open_).drop("key", "_hot"), "frequent-segments")
        if rows.isEmpty():
            return found.distinct()


def forms(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """word, n, n_near, form and form_n for each word of ``vocabulary`` (word, n; written)."""
    near = written(near_pairs(vocabulary, pairs), "near")
    both = near.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(near.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("_best"))
    larger = -F.col("_best.less") >= 2 * F.col("n")
    return vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(larger, F.col("_best.near")).alias("form"), F.when(larger, -F.col("_best.less")).alias("form_n")
    )


def rooted(found: DataFrame) -> DataFrame:
    """``found`` (written) with root: the last word that its forms lead to. A form has twice the count, so chains are
    short; each round doubles the steps of a link, and words that have arrived are only looked up from then on."""
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("at"), F.lit(False).alias("done"))
    while True:
        links = written(links, "links")
        going = links.filter("NOT done")
        if going.isEmpty():
            break
        ahead = links.select(F.col("word").alias("_word"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        step = going.join(ahead, going["at"] == ahead["_word"], "left")
        step = step.select("word", F.coalesce("_at", "at").alias("at"), F.coalesce("_done", F.lit(True)).alias("done"))  # without a link of its own it is a root
        links = links.filter("done").unionByName(step)
    return found.join(links.select("word", F.col("at").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``docs``."""
    vocabulary = written(words(docs), "vocabulary")
    found = written(forms(vocabulary, pairs), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")
