"""Histogram sort into shards of near-equal bytes, with DataFrame functions only.

The sort key of a row is one long: 12 bits of the text's MD5, then 48 bits of the MD5 of its doc_id. Equal texts so lie
in one narrow range of keys, and a group of copies of any size still has as many keys as rows. Rounds of exact counts
find the splitters: each round counts the bytes of the cells that a target falls into, over 4096 finer probes a cell,
until a cell holds no more than the tolerance or a single key. One exchange of the rows, by shard and cell of keys, then
numbers each shard's rows in the order of their keys; a file may hold cells of several shards.

Defined cases: size is the UTF-8 bytes of the text plus 8 (a null text has none, and CRC-32 0); a null doc_id has a key
of its own; rows that repeat a doc_id and text share a key and stay in one shard, in any order; an empty table gives an
empty result; further columns are kept by ``histogram_shard``, which adds or replaces size, shard and slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_starts, written

#: Bits of the key: those of the text, those of the doc_id, and those that one round of probes adds.
TEXT_BITS, ID_BITS, ROUND_BITS = 12, 48, 12
#: A cell of rows for the numbering of slots is cut into 4096 if it has more rows than this, or this many times the rows
#: of a mean cell and 1024 more (a frequent text).
CELL_ROWS, CELL_TIMES = 100_000, 8


def key_column():
    """The long sort key of (text, doc_id)."""
    text = F.conv(F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("long")
    own = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("long")
    return F.shiftleft(text, ID_BITS) + own


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.0) -> list[int]:
    """The ``shards`` - 1 keys at which a new shard begins. Shard k begins at the first key below which at least
    k / ``shards`` of the bytes lie, or within ``tolerance`` of the bytes from there. Counts are exact; the driver gets
    at most (``shards`` - 1) * 4096 of them a round."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = {k: -(-k * total // shards) for k in range(1, shards)}  # bytes below, at least
    found: dict[int, int] = {}
    cells = {0: (0, set(targets))} if total else {}  # prefix: bytes below the cell, targets in it
    bits = TEXT_BITS + ID_BITS
    left = bits
    while cells and left > 0:
        parent, left = left, left - ROUND_BITS
        rows = keyed if parent == bits else keyed.filter(F.shiftright("key", parent).isin(list(cells)))
        counted = rows.groupBy(F.shiftright("key", left).alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        inside: dict[int, list] = {}
        for cell, size in sorted(map(tuple, counted)):
            inside.setdefault(cell >> (parent - left) if parent != bits else 0, []).append((cell, size))
        finer: dict[int, tuple[int, set[int]]] = {}
        for prefix, (below, wanted) in cells.items():
            for cell, size in inside.get(prefix, []):
                for k in sorted(wanted):
                    if below < targets[k] <= below + size:
                        if left == 0 or size <= tolerance * total:
                            found[k] = (cell + 1) << left
                        else:
                            finer.setdefault(cell, (below, set()))[1].add(k)
                below += size
        cells = finer
    return [found[k] for k in sorted(found)]


def _shard(cuts: list[int]):
    return reduce(lambda a, c: a + (F.col("key") >= F.lit(c)).cast("int"), cuts, F.lit(0)).cast("int")


def histogram_shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with size, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard, in the order of the
    keys), exchanged once by narrow ranges of the key."""
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    keyed = docs.select(F.struct(*own).alias("row"), "doc_id", size.alias("size"), key_column().alias("key"))
    narrow = written(keyed.select("key", "size"), "keys")
    cuts = splitters(narrow, shards, tolerance)
    narrow = narrow.withColumn("shard", _shard(cuts))
    coarse = F.shiftright("key", ID_BITS)
    counts = narrow.groupBy(coarse.alias("c")).count()
    mean = (counts.agg(F.sum("count")).first()[0] or 0) >> TEXT_BITS
    heavy = [r[0] for r in counts.filter(F.col("count") > min(cell_rows, CELL_TIMES * mean + 1024)).collect()]
    cell = F.when(coarse.isin(heavy), F.shiftright("key", ID_BITS - ROUND_BITS)).otherwise(F.shiftleft(coarse, ROUND_BITS))
    cells = written(narrow.groupBy("shard", cell.alias("cell")).agg(F.count("*").alias("rows")), "cells")
    starts = block_starts(cells, ["shard"], "cell", "rows", "start").select("shard", "cell", "start")
    place = Window.partitionBy("shard", "cell").orderBy("key", "doc_id")
    out = keyed.withColumn("shard", _shard(cuts)).withColumn("cell", cell).withColumn("n", F.row_number().over(place))
    return out.join(starts, ["shard", "cell"]).select("row.*", "size", "shard", (F.col("start") + F.col("n") - 1).alias("slot"))


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) for every row of ``docs``."""
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = histogram_shard(docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
