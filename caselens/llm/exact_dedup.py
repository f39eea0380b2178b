"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent. Their exact counts and winners are verified, and as there
are at most ``counters`` of them they are broadcast, so that a group of copies that holds a third of all rows never goes
through a shuffle. All other digests are grouped in the ordinary way.

Defined cases: a null text counts as empty; texts are equal if identical after lower-casing A-Z only; of equal texts the
row with the largest doc_id, of any ordered type, stays (a null doc_id is smallest); texts of any length are read whole; of rows that repeat that doc_id exactly one stays; an
empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, written

#: Counters of each Misra-Gries summary: the most digests that are broadcast (about 60 bytes each).
COUNTERS = 512


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_digest(text: str) -> Column:
    """SHA-256 of the text's UTF-8 after lower-casing A-Z only; a null text is empty. In a text of ASCII alone no other
    letters can change, so the quicker ``lower`` does."""
    text = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.unhex(F.sha2(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), 256))


def merge_counters(counters: dict, more: dict, k: int) -> dict:
    """Adds ``more`` to a Misra-Gries summary of at most ``k`` counters: too many counters all lose the count of the
    (k+1)-th largest, so a counter is too small by at most a k-th of the rows seen."""
    total = Counter(counters)
    total.update(more)
    if len(total) <= k:
        return dict(total)
    less = sorted(total.values(), reverse=True)[k]
    return {d: n - less for d, n in total.items() if n > less}


def frequent(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests that hold all those of over 2 / ``counters`` of the ``rows``."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            kept = merge_counters(kept, Counter(batch["digest"]), counters)
        yield pd.DataFrame({"digest": list(kept), "n": pd.Series(list(kept.values()), dtype="int64")})

    sums = digests.select("digest").mapInPandas(summarise, "digest binary, n long")
    return sums.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") > rows / counters).select("digest")


def resolve(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and digest (binary)."""
    table = written(docs.select("doc_id", normalised_digest("text").alias("digest"), F.monotonically_increasing_id().alias("rid")), "digests")
    best = F.max(F.struct(F.col("doc_id").alias("id"), F.col("rid"))).alias("best")  # a null id is the smallest
    found = written(
        table.join(F.broadcast(frequent(table, table.count(), counters)), "digest", "left_semi").groupBy("digest").agg(best, F.count("*").alias("n")),
        "winners",
    )
    split = table.join(F.broadcast(found), "digest", "left")
    heavy, rest = split.filter(F.col("n").isNotNull()), split.filter(F.col("n").isNull()).select("digest", "doc_id", "rid")
    groups = rest.groupBy("digest").agg(best, F.count("*").alias("n")).filter("n > 1")
    rest = rest.join(groups, "digest", "left")
    every = heavy.unionByName(rest.select(heavy.columns))
    single = F.col("n").isNull()
    return every.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("rid") == F.col("best.rid")).alias("kept"),
        "digest",
    )


def report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, dropped ones too."""
    return resolve(docs, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that are not kept, in its own columns. Only doc_ids cross the shuffle beside the
    rows themselves; a null doc_id is matched like any other."""
    found = written(resolve(docs, counters).select("doc_id", "digest", "kept"), "decisions")
    return keep_rows(docs, found, normalised_digest("text"))
