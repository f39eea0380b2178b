"""Audit of how filters interact: which removes what, in every order.

Five filters are tested on each document. The flags of all documents are crossed with the 120 orders of the filters (a
broadcast table of fixed size); each order's first failing step is found, its five steps are exploded, and the counts of
each (part, order, step) are summed on the map side before their only shuffle. The rows that meet in that shuffle are
at most 600 a part and task, whatever the number of documents.

A copy is found without gathering its group: the smallest doc_id of each text digest is an aggregate, and a document is
looked up in these by its own doc_id and digest, so no group of copies meets in one task.

Defined cases: a null text counts as empty (and so equals other empty ones), a null source is the part ''; a null doc_id
is no smaller than any and has none smaller, so it never fails E; rows that repeat a doc_id and text are no copies of each
other; texts of any length are read whole; of several labels of a doc_id, 1 counts if any is 1, and null labels are 0; an
empty table gives an empty result; further columns of the inputs are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The filters, each with its bit.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
WHITE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> Column:
    """The bits of the filters that need the text alone: A (under 50 words), B (under 65 distinct words of 100), C (over 5
    letters A-Z of 100 code points) and D (any of ``#$%&*|``). The words are cut once."""
    found = F.transform(F.array(F.array_remove(F.split(text, WHITE), "")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = {
        "A": found["n"] < 50,
        "B": 100 * found["distinct"].cast("long") < 65 * found["n"].cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(test, FILTERS[name]).otherwise(0) for name, test in tests.items()), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (of the failed filters), good and toxic for each row of ``docs`` (doc_id, text, source); ``labels`` has
    doc_id, quality and toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_flags(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = written(rows, "flags")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = rows.join(firsts, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    no = F.lit(False)
    return found.select("part", (F.col("own") + F.when(copy, FILTERS["E"]).otherwise(0)).alias("bits"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(like: DataFrame) -> DataFrame:
    """The 120 orders: filter_order and masks, the filters' bits in it."""
    rows = [("".join(p), [FILTERS[f] for f in p]) for p in permutations(FILTERS)]
    return like.sparkSession.createDataFrame(rows, "filter_order string, masks array<int>")


def replayed(flags: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for rows (part, bits, good, toxic)."""
    tasks = int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = flags.repartition(tasks)  # each narrow row becomes 600: over as many tasks as a shuffle has, not coalesced
    crossed = spread.crossJoin(F.broadcast(orders(flags)))
    fails = [F.col("bits").bitwiseAND(F.col("masks")[k]) != 0 for k in range(len(FILTERS))]
    first = F.coalesce(*[F.when(f, k + 1) for k, f in enumerate(fails)], F.lit(len(FILTERS) + 1))
    steps = crossed.select("*", first.alias("first")).select("part", "filter_order", "bits", "good", "toxic", "first", F.posexplode("masks").alias("pos", "mask"))
    step = F.col("pos") + 1
    removed = F.col("first") == step
    return steps.groupBy("part", "filter_order", step.alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((F.col("bits").bitwiseAND(F.col("mask")) != 0) & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("bits") == F.col("mask")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts of the step and ``shapley``: what its filter removes, summed
    over all orders."""
    steps = written(replayed(flagged(docs, labels)), "steps").withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    share = steps.groupBy("part", "_filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(share, ["part", "_filter"]).drop("_filter")
