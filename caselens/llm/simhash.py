"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link if they differ in at most four. Cut into four segments, one segment of a linked pair
differs in at most one bit. If one of the three long segments is equal, of five parts of the other bits one is equal too:
15 keys. If the short one is equal, of the six halves of the long ones two are: 15 keys. Else each segment differs in
exactly one bit: then the short segment with that bit wildcarded, and a half of the first and of the second long one,
are equal: 40 keys. So each linked pair meets under an equal key, of 27 bits or more. Fingerprints are first compared
with one pivot a key, which joins large groups of near copies by as many links as members; after their components are
known, only keys that still hold several components are joined with themselves, and each pair is verified on all 64
bits.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; fewer words
than a shingle give one shingle of all of them; repeated rows and texts share a fingerprint; a null doc_id takes part,
but is the name of a component only if no other is in it; an empty table gives an empty result; further columns of the
input are not read by ``components`` and are kept by ``deduplicate``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, written

WORDS, BITS, DISTANCE = 4, 64, 4
#: (lowest bit, bits) of the segments: as many as DISTANCE, so that one of a linked pair differs in one bit at most.
SHORT, LONG = (0, 10), [(10, 18), (28, 18), (46, 18)]
#: Keys of several components are broadcast if there are no more (16 MB in memory), else joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a whole text: the majority of each bit of XXH64 (seed 42) over its word shingles."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


@F.pandas_udf(T.LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    return text.map(fingerprint).astype("int64")


def differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bits(column: str, low: int, bits: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << bits) - 1))


def _key(kind: int, *parts: tuple[int, int], wildcard: int | None = None):
    """A long of the kind of key and the bits (lowest, number) of the fingerprint; ``wildcard`` is the bit left out."""
    out = F.lit(kind).cast("long")
    for low, bits in parts:
        value = _bits("fp", low, bits)
        if wildcard is not None and low <= wildcard < low + bits:
            value = value.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << (wildcard - low))))
        out = F.shiftleft(out, bits).bitwiseOR(value)
    return out


def long_keys() -> list:
    """Keys of pairs of which a long segment is equal: that segment and a fifth of the other bits (in two runs at most)."""
    out = []
    for low, bits in LONG:
        rest = [i for i in range(BITS) if not low <= i < low + bits]
        for n in range(DISTANCE + 1):
            part = rest[n * len(rest) // (DISTANCE + 1) : (n + 1) * len(rest) // (DISTANCE + 1)]
            runs = [(part[0], len(part))]
            if part[-1] - part[0] >= len(part):  # it goes on beyond the segment
                before = low - part[0]
                runs = [(part[0], before), (low + bits, len(part) - before)]
            out.append(_key((1 << 6) + len(out), (low, bits), *runs))
    return out


def halves(segment: tuple[int, int]) -> list[tuple[int, int]]:
    low, bits = segment
    return [(low, bits // 2), (low + bits // 2, bits - bits // 2)]


def short_keys() -> list:
    """Keys of pairs of which the short segment is equal (with two halves of long ones), or all segments differ in one
    bit (the short one with that bit wildcarded, and a half of the first and second long one)."""
    every = [h for segment in LONG for h in halves(segment)]
    out = [_key((2 << 6) + n, SHORT, *two) for n, two in enumerate(combinations(every, 2))]
    low, bits = SHORT
    for i in range(low, low + bits):
        for first in halves(LONG[0]):
            for second in halves(LONG[1]):
                out.append(_key((2 << 6) + len(out), SHORT, first, second, wildcard=i))
    return out


def keyed(prints: DataFrame, keys: list) -> DataFrame:
    """Every row of ``prints`` (fp, ...) under each of the keys."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(tasks, "fp")  # each row becomes many: over as many tasks as a shuffle has, not coalesced
    return spread.withColumn("key", F.explode(F.array(*keys)))


def links(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for each node, root the smallest of its component.
    Large and small stars in turn; only minima and pairs of a node and a neighbour are shuffled, and each round is
    written, so no group is collected and a lost executor costs one round at most."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        edges = written(small.filter("a <> b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def clusters(prints: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``prints`` (fp, n) that has a link."""
    index = keyed(prints, long_keys())
    pivot = index.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("p"), F.count("*").alias("_m")).filter("_m > 1").select("key", F.col("p.fp").alias("pivot"))
    first = index.join(pivot, "key").filter((F.col("fp") != F.col("pivot")) & (differing("fp", "pivot") <= DISTANCE))
    near = written(links(first.select(F.col("fp").alias("a"), F.col("pivot").alias("b")), "stars"), "components")
    labelled = written(prints.join(near, prints["fp"] == near["node"], "left").select("fp", F.coalesce("root", "fp").alias("c")), "labelled")
    index = keyed(labelled, long_keys() + short_keys())
    open_keys = index.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo < _hi").select("key")
    open_keys = written(open_keys, "open-keys")
    small = open_keys.count() <= BROADCAST_KEYS
    several = index.join(F.broadcast(open_keys) if small else open_keys, "key", "left_semi")
    a, b = several.select("key", "fp", "c"), several.select("key", F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("c") < F.col("c2")) & (differing("fp", "fp2") <= DISTANCE))
    across = written(links(pairs.select(F.col("c").alias("a"), F.col("c2").alias("b")), "across"), "merged")
    found = labelled.join(across, labelled["c"] == across["node"], "left")
    return found.select("fp", F.coalesce("root", "c").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the component) for every row of ``docs``."""
    table = written(docs.select("doc_id", fingerprint_column("text").alias("fp")), "fingerprints")
    prints = written(table.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "prints")
    roots = prints.join(clusters(prints.select("fp", "n")), "fp")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(roots.join(names, "root").select("fp", "component_id"), "names")
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of ``docs``."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The document of the smallest doc_id of each component, in the columns of ``docs``; of rows that repeat it, one
    stays, and a document without doc_id stays if its component has no other."""
    found = components(docs).select("doc_id", F.col("fp").alias("digest"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return keep_rows(docs, written(found, "decisions"), fingerprint_column("text"))
