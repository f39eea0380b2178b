"""Case analytics: summaries, pivots, latest and best rows, two-key deduplication, lookups and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def is_stale(updated: Column, as_of: Column | str, days: int = 7) -> Column:
    """Whether a row was last updated ``days`` or more before ``as_of``; a time that cannot be read is not stale."""
    as_of = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return F.coalesce(F.to_date(updated) <= F.date_sub(as_of, days), F.lit(False))


def status_summary(cases: DataFrame, key: str, open_if: Column, updated: str, as_of: str, days: int = 7) -> DataFrame:
    """Per ``key``: all cases, open ones, open ones that are stale, and the last update."""
    stale = open_if & is_stale(F.col(updated), as_of, days)
    return cases.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(open_if).alias("open"), F.count_if(stale).alias("stale"), F.max(updated).alias("last_updated")
    )


def pivot_with_total(rows: DataFrame, key: str, column: str, values: list, total: str = "total") -> DataFrame:
    """Counts per ``key`` and value of ``column`` (zeros filled, other values only in the total), and a row for all."""
    counts = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    grouped = rows.groupBy(key).agg(*counts, F.count("*").alias(total))
    # summed from the groups, so that a table without rows has a total of zeros
    every = grouped.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in [*map(str, values), total]])
    return grouped.unionByName(every.withColumn(key, F.lit("(all)")))


def year_of(value: Column) -> Column:
    """The year in the first four characters if it is from 1900 to 2100, else ``unknown``."""
    year = F.substring(value, 1, 4)
    known = year.rlike("^[0-9]{4}$") & year.try_cast("int").between(1900, 2100)
    return F.coalesce(F.when(known, year), F.lit(UNKNOWN))


def year_cube(cases: DataFrame, seed: DataFrame, key: str, created: str) -> DataFrame:
    """(key, year, cases) with totals over years and keys: each key of ``seed`` occurs even without cases."""
    rows = seed.select(key).distinct().join(cases, key, "left")
    rows = rows.withColumn("year", F.when(F.col(created).isNotNull(), year_of(F.col(created))))
    counted = rows.cube(key, "year").agg(F.count(created).alias("cases"), F.grouping_id().alias("_level"))
    counted = counted.filter((F.col("year").isNotNull()) | F.col("_level").isin(1, 3))
    return counted.select(F.when(F.col("_level") >= 2, "(all)").otherwise(F.col(key)).alias(key), F.coalesce("year", F.lit("(all)")).alias("year"), "cases")


def monthly_pivot(cases: DataFrame, key: str, created: str, year: int) -> DataFrame:
    """Cases per ``key`` in each month of a year; the total also counts those whose month is unknown."""
    month = F.try_to_number(F.substring(created, 5, 2), F.lit("99")).cast("int")
    rows = cases.filter(year_of(F.col(created)) == str(year)).withColumn("_m", month)
    return rows.groupBy(key).agg(*[F.count_if(F.col("_m") == m).alias(f"m{m:02d}") for m in range(1, 13)], F.count("*").alias("total"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_segment(segments: DataFrame, key: str, at: str, index: str, body: str) -> DataFrame:
    """Each key's last segment: those with text before blank ones, then the latest time, then the highest index."""
    blank = F.trim(F.coalesce(F.col(body), F.lit(""))) == ""
    return first_of(segments, [key], [blank, F.col(at).desc_nulls_last(), F.desc(index)])


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_id: str, right_at: str, block: str = "day") -> DataFrame:
    """For each row of ``left`` the row of ``right`` of the same key at the smallest distance in time: ties go to the
    later one, then to the smaller id; a null time is infinitely far; a row without partner has null. An as-of search
    by two windows (the last before, the first after) over each key's blocks of time, so a key with many rows on both
    sides has no product and is not gathered; only the edges of its blocks are carried on."""
    kinds = lambda df, side, i, at: df.select(key, F.col(at).cast("timestamp").alias("_at"), F.col(i).alias("_id"), F.lit(side).alias("_side"))
    both = kinds(left, 1, left_id, left_at).unionByName(kinds(right, 0, right_id, right_at))
    dated = both.filter(F.col("_at").isNotNull()).withColumn("_block", F.date_trunc(block, "_at"))
    answer = F.when(F.col("_side") == 0, F.struct("_at", "_id"))
    edges = dated.groupBy(key, "_block").agg(
        F.min_by(answer, F.when(F.col("_side") == 0, F.struct((-F.unix_micros("_at")).alias("t"), F.col("_id")))).alias("_last"),
        F.min(answer).alias("_first"),
    )
    over = Window.partitionBy(key).orderBy("_block")
    before = F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select(key, "_block", before.alias("_before"), after.alias("_after"))
    back = Window.partitionBy(key, "_block").orderBy("_at", "_side", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "_block").orderBy("_at", F.desc("_side"), "_id").rowsBetween(0, Window.unboundedFollowing)
    near = dated.withColumn("_b", F.last(answer, True).over(back)).withColumn("_f", F.first(answer, True).over(ahead)).filter("_side = 1")
    near = near.join(edges, [key, "_block"]).withColumn("_b", F.coalesce("_b", "_before")).withColumn("_f", F.coalesce("_f", "_after"))
    far = lambda c: F.abs(F.unix_micros(F.col(f"{c}._at")) - F.unix_micros("_at"))
    gap_back, gap_ahead = far("_b"), far("_f")
    pick = F.when(F.col("_b").isNull() | (F.col("_f").isNotNull() & (gap_ahead <= gap_back)), F.col("_f._id")).otherwise(F.col("_b._id"))
    found = near.select(key, F.col("_id").alias(left_id), pick.alias("_found"))
    anyone = right.groupBy(key).agg(F.max_by(right_id, F.struct(F.col(right_at).cast("timestamp").alias("t"))).alias("_latest"), F.min(right_id).alias("_any"))
    rows = left.select(key, left_id).join(found, [key, left_id], "left").join(anyone, key, "left")
    return rows.select(key, left_id, F.coalesce("_found", "_latest", "_any").alias(right_id))


def two_key_dedup(rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Rows in ``order`` (unique) are kept if neither key was seen; a row dropped for its second key has still used its
    first, and one dropped for its first has not touched its second. So a row passes the first test if it is the first of
    its first key, and is kept if it is the first of its second key among those that pass; null keys never collide."""

    def firsts(table: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(order)
        known = table.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        return known.unionByName(table.filter(F.col(key).isNull()))

    return firsts(firsts(rows, first), second)


def matches_keyword(columns: list[str], keyword: str | None) -> Column:
    """Whether one of the columns contains the keyword, without case; a blank keyword matches all."""
    if not (keyword or "").strip():
        return F.lit(True)
    word, out = F.lit(keyword.lower()), F.lit(False)
    for c in columns:
        out = out | (F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), word))
    return out


def drill_down(rows: DataFrame, key: str, created: str, product: str = "", year: str = "", month: int = 0) -> DataFrame:
    """Rows of a product, year and month; a blank or zero one lets all pass."""
    if product.strip():
        rows = rows.filter(F.col(key) == product)
    if year.strip():
        rows = rows.filter(year_of(F.col(created)) == year)
    return rows.filter(month_of(F.col(created)) == month) if month > 0 else rows


def month_of(value: Column) -> Column:
    """The month in characters 5 and 6 of a date of eight or more; null if it is none."""
    month = F.when(F.char_length(value) >= 8, F.substring(value, 5, 2).try_cast("int"))
    return F.when(month.between(1, 12), month)


def lookup(index: DataFrame, scanned: DataFrame, column: str, number: str) -> DataFrame:
    """The case of a support number in its normal form: from the index, else from the folders; one row at most."""
    from caselens.functions.text import support_number

    wanted = support_number(F.lit(number))
    both = index.withColumn("_part", F.lit(0)).unionByName(scanned.withColumn("_part", F.lit(1)))
    found = both.filter((support_number(F.col(column)) == wanted) & (wanted != ""))
    return found.orderBy("_part", *index.columns).limit(1).drop("_part")


def existing(index: DataFrame, folders: DataFrame, path: str, root: str) -> DataFrame:
    """Index rows whose folder lies under the root and is there."""
    from caselens.functions.names import under_root

    return index.filter(under_root(F.col(path), root)).join(folders.select(path).distinct(), path, "left_semi")


def in_display_order(products: DataFrame) -> DataFrame:
    """Enabled products with their place from 1, by order and name; the list of products is short."""
    w = Window.orderBy("sort_order", F.lower("display_name"), "display_name")
    return products.filter("is_enabled").withColumn("place", F.row_number().over(w))


def categories(paths: DataFrame, path: str, root: str) -> DataFrame:
    """The folders directly under a root."""
    from caselens.functions.names import under_root

    top = root.rstrip("/")
    below = paths.filter(under_root(F.col(path), top) & (F.char_length(path) > len(top) + 1))
    return below.select(F.element_at(F.split(F.substr(F.col(path), F.lit(len(top) + 2)), "/"), 1).alias("category")).distinct()


def repeated_names(products: DataFrame, name: str) -> DataFrame:
    """(name, n): names that occur more than once without case, in upper case."""
    form = F.upper(F.trim(name))
    return products.filter(F.trim(name) != "").groupBy(form.alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def matched_product(rows: DataFrame, products: DataFrame, wanted: str) -> DataFrame:
    """Adds product_id to rows by their wanted id, name or alias without case: an id before a name before an alias.
    ``products``: product_id, display_name, aliases."""
    form = lambda c: F.lower(F.trim(c))
    names = F.concat(
        F.array(F.struct(F.lit(0).alias("p"), form(F.col("product_id")).alias("n")), F.struct(F.lit(1).alias("p"), form(F.col("display_name")).alias("n"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(2).alias("p"), form(a).alias("n"))),
    )
    known = products.select("product_id", F.explode(names).alias("x")).filter(F.coalesce("x.n", F.lit("")) != "")
    first = known.groupBy(F.col("x.n").alias("_name")).agg(F.min(F.struct(F.col("x.p").alias("p"), "product_id")).alias("_m"))
    joined = rows.join(first, form(F.col(wanted)) == F.col("_name"), "left")
    return joined.withColumn("product_id", F.col("_m.product_id")).drop("_m", "_name")


def launch_folder(contexts: DataFrame, folders: DataFrame) -> DataFrame:
    """For each launch context (context_id, support_number, company, status, received) the folder (path, name, modified)
    whose name has the support number among its runs of letters and digits: 100, and 40 more for the date of reception,
    30 for the company, 10 for the status in the name; the best, ties to the later one. Without any, path is null."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    named = folders.select("path", "name", "modified", F.explode(runs).alias("_run"))
    rows = contexts.join(named, F.lower(F.trim(F.col("support_number"))) == F.col("_run"))
    has = lambda c: F.when((F.trim(c) != "") & F.contains(F.lower("name"), F.lower(F.trim(c))), 1).otherwise(0)
    score = F.lit(100) + 40 * has(F.date_format("received", "yyyyMMdd")) + 30 * has(F.col("company")) + 10 * has(F.col("status"))
    best = F.max_by(F.struct("path", score.alias("score")), F.struct(score.alias("s"), "modified", "path")).alias("_b")
    return contexts.select("context_id").join(rows.groupBy("context_id").agg(best), "context_id", "left").select("context_id", "_b.path", "_b.score")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key, and the new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(table.columns))


def insertable(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not in ``table``, and the first of those that share one."""
    return first_of(new.join(table.select(key), key, "left_anti"), [key], [c for c in new.columns if c != key])


def retained(rows: DataFrame, at: str, as_of: str, days: int = 30, newest: int = 500, partition: list[str] | None = None) -> DataFrame:
    """Rows of the last ``days``, and of those the ``newest`` (from 50 to 10,000): the feature is the limit."""
    newest = min(10_000, max(50, newest))
    recent = rows.filter(F.col(at) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))
    order = [F.desc(at), *[c for c in rows.columns if c != at]]
    if not partition:
        return recent.orderBy(*order).limit(newest)
    return recent.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("_n") <= newest).drop("_n")


def shadow_statistics(runs: DataFrame, keys: list[str], value: str, ok: Column) -> DataFrame:
    """Per group: runs, share of matches, and the nearest-rank 50th and 95th percentiles of ``value``."""
    nearest_rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.round(F.avg(ok.cast("int")), 6).alias("match_rate"),
        F.count_if(~ok).alias("failures"),
        nearest_rank(0.5).alias("p50"),
        nearest_rank(0.95).alias("p95"),
    )


def trailing_failures(runs: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """How many runs at the end of each group failed one after another, without sorting: those after the last match."""
    position = F.struct(*order)
    last = runs.withColumn("_p", position).groupBy(*keys).agg(F.max(F.when(ok, F.col("_p"))).alias("_last"))
    rows = runs.withColumn("_p", position).join(last, keys)
    return rows.groupBy(*keys).agg(F.count_if(F.col("_last").isNull() | (F.col("_p") > F.col("_last"))).alias("streak"))
