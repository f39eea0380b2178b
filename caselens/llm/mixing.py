"""Mixing sources to target weights by Pfair scheduling.

Each source is a queue of blocks of near-equal bytes. Block k of a source of weight w has the release time floor(k / w)
and the deadline ceil((k + 1) / w); in each slot, of the blocks released, the one of the earliest deadline goes. Weights
are whole numbers of slots in a frame, so that every source is exactly on its target at the end of a frame and all
frames look alike: one frame is scheduled, and a block's slot follows from its number. In every prefix a source is less
than one block from its target. When a source runs out, the others go on with their weights scaled up (a new phase), so
all rows are kept and there are at most as many phases as sources.

Defined cases: a null text has one byte, as an empty one; a null source is a source; a source without a given weight
gets the mean of the given ones; rows that repeat a doc_id are placed one by one; a document longer than a block lies in
the block of its first byte, and leaves the blocks it covers empty; an empty table gives an empty result; ``mixed`` keeps
further columns.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, running_total, written

#: Bytes of a block; slots of a frame (more if there are many sources); exponent of the default weights.
BLOCK_BYTES, FRAME, TEMPERATURE = 1 << 14, 1024, 0.5
#: The plan is broadcast if it has no more bytes than this.
BROADCAST_BYTES = 4 << 20


def shares(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Whole slots of a frame for each source, at least one, in proportion to ``weights``."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * (frame - len(weights)) / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    return out


def schedule(slots: dict[str, int]) -> list[str]:
    """The source of each slot of a frame: earliest deadline first among the blocks released."""
    frame = sum(slots.values())
    waiting = sorted((k * frame // n, -(-(k + 1) * frame // n), s) for s, n in slots.items() for k in range(n))
    ready: list[tuple[int, str]] = []
    out, at = [], 0
    for t in range(frame):
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        deadline, source = heapq.heappop(ready)
        assert deadline > t, "a deadline was missed"
        out.append(source)
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], frame: int = FRAME) -> list[tuple]:
    """(source, phase, first, last, slots, frame, base, offsets) for each source and phase: its blocks first to last - 1
    go there; block first + i * slots + k goes to slot base + i * frame + offsets[k]."""
    left, done, base, out, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, [], 0
    while left:
        frame_now = max(frame, 1 << (4 * len(left) - 1).bit_length())
        slots = shares({s: weights[s] for s in sorted(left)}, frame_now)
        order = schedule(slots)
        whole = min(left[s] // slots[s] for s in left)
        taken = {s: whole * slots[s] for s in left}
        steps = 0
        for s in order:  # part of one more frame, up to the first slot of a source that has run out
            if taken[s] == left[s]:
                break
            taken[s] += 1
            steps += 1
        offsets: dict[str, list[int]] = {s: [] for s in left}
        for t, s in enumerate(order):
            offsets[s].append(t)
        out += [(s, phase, done[s], done[s] + taken[s], slots[s], frame_now, base, offsets[s]) for s in left if taken[s]]
        base += whole * frame_now + steps
        for s in list(left):
            done[s] += taken[s]
            left[s] -= taken[s]
            if not left[s]:
                del left[s]
        phase += 1
    return out


PLAN = "queue string, phase int, first long, last long, slots int, frame int, base long, offsets array<int>"


def queue_of() -> Column:
    """The name of a row's queue: "=" and its source, or nothing for a null source."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def placed_with_targets(docs: DataFrame, weights: dict[str | None, float] | None, block_bytes: int, frame: int) -> tuple[DataFrame, dict[str, float]]:
    """The rows of ``positions``, and the target weight of each queue."""
    spark = docs.sparkSession
    queue = queue_of()
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", queue.alias("queue"), size.alias("n_bytes")), "sizes")
    totals = {r[0]: r[1] for r in rows.groupBy("queue").agg(F.sum("n_bytes")).collect()}
    if weights:
        mean = sum(weights.values()) / len(weights)
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        wanted = {q: given.get(q, mean) for q in totals}
    else:
        wanted = {q: float(n) ** TEMPERATURE for q, n in totals.items()}
    plan = phases({q: (n - 1) // block_bytes + 1 for q, n in totals.items()}, wanted, frame)
    table = spark.createDataFrame(plan, PLAN)
    if sum(100 + 4 * len(p[-1]) for p in plan) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(bucket_count(rows.count()))))
    rows = running_total(rows, ["queue"], "b", ["doc_id", "rid"], "n_bytes", "at").withColumn("block", F.floor(F.col("at") / block_bytes))
    placed = rows.join(table, "queue").filter((F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    i = F.col("block") - F.col("first")
    k, begun = (i % F.col("slots")).cast("int"), F.col("base") + F.floor(i / F.col("slots")) * F.col("frame")
    step = lambda n: F.floor(n * F.col("frame") / F.col("slots"))
    placed = placed.select(
        "rid",
        "doc_id",
        "source",
        "n_bytes",
        "block",
        "phase",
        (begun + step(k)).cast("long").alias("release"),
        (begun + F.ceil((k + 1) * F.col("frame") / F.col("slots"))).cast("long").alias("deadline"),
        (begun + F.get("offsets", k)).cast("long").alias("slot"),
        "at",
        F.lit(1).cast("long").alias("one"),
    )
    return running_total(placed, [], "slot", ["at", "rid"], "one", "position").drop("at", "rid", "one"), wanted


def positions(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, frame: int = FRAME) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_bytes, block, phase, release and deadline (slots), slot, and
    position (gapless from 0 over all rows). By default weights are the sources' bytes to the power ``TEMPERATURE``."""
    return placed_with_targets(docs, weights, block_bytes, frame)[0]


def planned(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, frame: int = FRAME) -> DataFrame:
    """``docs`` in the order of their positions, with mix_position (of rows that repeat a doc_id, the first of theirs)
    and mix_share: the target weight of the row's source over the sum of all sources' weights."""
    placed, wanted = placed_with_targets(docs, weights, block_bytes, frame)
    place = placed.groupBy("doc_id").agg(F.min("position").alias("mix_position")).withColumnRenamed("doc_id", "_id")
    everything = sum(wanted.values())
    targets = docs.sparkSession.createDataFrame([(q, float(w / everything)) for q, w in wanted.items()], "_queue string, mix_share double")
    if sum(50 + len(q) for q in wanted) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    own = [c for c in docs.columns if c not in ("mix_position", "mix_share")]
    joined = docs.select(*own, queue_of().alias("_queue")).join(targets, "_queue").join(place, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*own, "mix_position", "mix_share")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` in the order of ``planned``: files, and rows in them, follow the schedule; of rows that repeat a doc_id,
    all lie at the place of the first."""
    rows = planned(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text"), weights)
    return rows.select("row.*")
