"""Incremental indexing: diffs by key and content, deduplication by content, order-insensitive fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, changed, deleted or unchanged, by one full outer join on the key."""
    a = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def merged(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """The new index: rows of ``new``, but the old row where the content is the same, so its costly columns live on."""
    same = new.select(key, content)
    kept = old.join(same, [key, content], "left_semi")
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def file_diff(old: DataFrame, new: DataFrame, path: str, modified: str) -> DataFrame:
    """``diff`` of two listings: a file is unchanged if its time of change is."""
    return diff(old, new, path, modified)


def group_diff(old: DataFrame, new: DataFrame, key: str, member: str, content: str) -> DataFrame:
    """(key, change) of groups, such as a case's notes: unchanged if the members and their contents are the same. Groups
    are compared by fingerprints, so no list of members is gathered."""
    mark = lambda rows: fingerprint(rows, [key], F.concat_ws("\x1f", F.col(member).cast("string"), F.col(content).cast("string")))
    return diff(mark(old), mark(new), key, "fingerprint")


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays have the same members, in any order and number."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def first_per_content(rows: DataFrame, content: Column, order: list, exempt: Column | None = None) -> DataFrame:
    """Of rows of equal content the first in ``order``; rows that are ``exempt`` all stay. Only the first of each content
    leaves a task, so one that is frequent is not gathered."""
    w = Window.partitionBy("_content").orderBy(*order)
    given = rows.withColumn("_content", content)
    rest = given if exempt is None else given.filter(~F.coalesce(exempt, F.lit(False)))
    kept = rest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_content", "_n")
    return kept if exempt is None else kept.unionByName(rows.filter(exempt))


def files_before_archives(rows: DataFrame, content: Column) -> DataFrame:
    """Of files of equal content (path, is_archive_entry) one: plain files before entries of archives, then by path."""
    return first_per_content(rows, content, [F.col("is_archive_entry"), F.col("path")])


def build_counters(files: DataFrame) -> DataFrame:
    """One row of counts over scanned files (extension, category, duplicate, characters, failed)."""
    read = F.col("category") == "ImportCandidate"
    return files.agg(
        F.count("*").alias("scanned"),
        F.count_if(read).alias("supported"),
        F.count_if(~read).alias("skipped"),
        F.count_if(read & F.col("duplicate")).alias("duplicates"),
        F.count_if(read & ~F.col("duplicate") & (F.col("characters") == 0)).alias("empty"),
        F.count_if("failed").alias("failures"),
        F.count_if(read & ~F.col("duplicate") & (F.col("characters") > 0) & ~F.col("failed")).alias("indexed"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """(category, extension, files)."""
    return files.groupBy("category", "extension").agg(F.count("*").alias("files"))


def manifest(chunks: DataFrame, keys: list[str], document: str, at: str) -> DataFrame:
    """Per group of chunks: its documents, chunks and last time."""
    docs = chunks.groupBy(*keys, document).agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
    return docs.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("_n").alias("chunks"), F.max("_at").alias("last_updated"))


def fingerprint(rows: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """Per group: members, distinct members, and a SHA-256 that does not depend on their order. The members' digests
    are summed as two numbers, so no list of them is ever gathered."""
    digest = F.sha2(member, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.sum(part(1)).alias("_x"), F.sum(part(16)).alias("_y"))
    total = F.concat_ws(":", F.col("members").cast("string"), F.col("_x").cast("string"), F.col("_y").cast("string"))
    return sums.select(*keys, "members", F.sha2(total, 256).alias("fingerprint"))


def version_conflicts(rows: DataFrame, product: str, version: str) -> DataFrame:
    """``rows`` with conflict: its version is known and its product has another known one. The versions of a product are
    counted first, so only products of several are joined."""
    several = rows.groupBy(F.col(product).alias("_product")).agg(F.min(version).alias("_lo"), F.max(version).alias("_hi")).filter("_lo <> _hi").select("_product", F.lit(True).alias("_several"))
    joined = rows.join(several, F.col(product) == F.col("_product"), "left")
    return joined.withColumn("conflict", F.col(version).isNotNull() & F.col("_several").isNotNull()).drop("_product", "_several")


def conflict_pairs(rows: DataFrame, product: str, version: str) -> DataFrame:
    """(product, version, other): the different known versions of one product, each pair once, over distinct values."""
    a = rows.select(product, version).filter(F.col(version).isNotNull()).distinct()
    b = a.select(F.col(product).alias("_product"), F.col(version).alias("other"))
    return a.join(b, (F.col(product) == F.col("_product")) & (F.col(version) < F.col("other"))).select(product, version, "other")
