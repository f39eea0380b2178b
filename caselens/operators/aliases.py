"""Names found in texts by a catalog of aliases that is a table.

A catalog has the columns dimension (products, components, ...), name and alias. Aliases are folded by NFKC and case, with
white space joined, as the texts are. One that begins and ends with an ASCII letter or digit must stand between other
characters than these; any other is found wherever it stands. Of the aliases, and their names, each is compared once, in
one pass over the texts (``containment``), whose plan does not grow with the catalog.

Defined cases: null texts, names and aliases, and blank ones, name nothing; a null key is kept; repeated rows of the texts
give repeated rows; an empty table or catalog gives an empty result; other columns of both are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold
from caselens.scratch import written

from . import containment

CATALOG = "dimension string, name string, alias string"


def comparable(text: Column) -> Column:
    """A text as aliases are compared with it: folded, white space joined."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\s+", " "))


def entries(catalog: DataFrame, itself: bool = True) -> DataFrame:
    """(dimension, name, alias) with folded aliases, each once; with ``itself`` a name is an alias of its own."""
    rows = catalog.select("dimension", "name", "alias").filter("name IS NOT NULL AND dimension IS NOT NULL")
    if itself:
        rows = rows.unionByName(rows.select("dimension", "name", F.col("name").alias("alias")))
    return rows.withColumn("alias", comparable(F.col("alias"))).filter("alias <> ''").distinct()


def mentions(rows: DataFrame, key: str, text: str, catalog: DataFrame, itself: bool = True, most: int = containment.BYTES) -> DataFrame:
    """(key, dimension, name): what each text names, each name once a row. Beyond ``most`` bytes of aliases the catalog is
    joined, not sent."""
    aliases = written(entries(catalog, itself), "aliases")
    terms = aliases.select(F.col("alias").alias("term"), F.col("alias").rlike(r"(?s)^[a-z0-9](?:.*[a-z0-9])?$").alias("bounded")).distinct()
    ids = written(rows.select(F.col(key).alias("_own"), comparable(F.col(text)).alias("text"), F.monotonically_increasing_id().alias("_key")), "texts")
    hits = containment.found(ids.select("_key", "text"), terms, most)
    # dealt out by key once, for the join as for what is different
    named = hits.join(aliases, hits["term"] == aliases["alias"]).select("_key", "dimension", "name").repartition("_key").distinct()
    return ids.select("_key", "_own").join(named, "_key").select(F.col("_own").alias(key), "dimension", "name")


def profiled(rows: DataFrame, key: str, text: str, catalog: DataFrame, dimensions: list[str], itself: bool = True, most: int = containment.BYTES) -> DataFrame:
    """``rows``, whose ``key`` names each once, with one array of names (sorted) for each dimension."""
    found = mentions(rows, key, text, catalog, itself, most)
    lists = [F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("name")))).alias(d) for d in dimensions]
    sums = found.groupBy(F.col(key).alias("_named")).agg(*lists)  # no more names a text than it has places
    none = F.array().cast("array<string>")
    own = [c for c in rows.columns if c not in dimensions]
    return rows.join(sums, F.col(key) == F.col("_named"), "left").select(*own, *(F.coalesce(d, none).alias(d) for d in dimensions))
