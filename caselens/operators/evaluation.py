"""Retrieval metrics, quality gate, recommended configuration, regression comparison and readiness of a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import fold, fold_all
from caselens.scratch import small, written

from .incremental import fingerprint, version_conflicts

# Gate limits, and the preferences that break ties between configurations.
MINIMA = {"mean_recall_at_k": 0.8, "mrr": 0.8, "mean_ndcg_at_k": 0.8, "mean_required_term_coverage_at_k": 0.8}
MAXIMA = {"excluded_term_hit_count": 0, "product_confusion_count": 0, "version_mismatch_count": 0}
PREFERENCES = {
    "filter_mode": ["product_and_version", "product", "none"],
    "search_method": ["bm25", "keyword", "hybrid", "hash_embedding"],
    "reranker": ["none", "lexical"],
    "chunk_strategy": ["fixed", "paragraph", "heading", "structured"],
}
CONFIGURATION = ["chunk_strategy", "search_method", "reranker", "filter_mode", "top_k"]


def first_per_document(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The best-ranked chunk of each document, ranked anew."""
    own = Window.partitionBy(*keys, "document_id").orderBy("rank")
    again = Window.partitionBy(*keys).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n").withColumn("rank", F.row_number().over(again))


def scored_metrics(scores: DataFrame, expected: DataFrame, queries: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """``query_metrics`` of all scored chunks (keys..., query_id, document_id, score): documents are ranked by their best
    chunk, then by id. Only the best of each query go through a window; the rank of the first expected document is one
    more than the count of those before it."""
    keys = keys or []
    group = [*keys, "query_id"]
    best = written(scores.groupBy(*group, "document_id").agg(F.max("score").alias("score")), "scores")
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "document_id")
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(ks)).select(*group, "document_id", "rank")
    return document_metrics(best, top, expected, queries, ks, keys)


def document_metrics(best: DataFrame, top: DataFrame, expected: DataFrame, queries: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """``query_metrics`` of the documents' best scores (keys..., query_id, document_id, score; written) and of the first of them
    (keys..., query_id, document_id, rank)."""
    group = [*keys, "query_id"]
    relevant = best.join(expected.distinct(), ["query_id", "document_id"], "left_semi")
    mark = relevant.groupBy(*group).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("document_id").alias("d"))).alias("_first"))
    before = F.struct((-F.col("score")).alias("s"), F.col("document_id").alias("d")) < F.col("_first")
    first = best.join(small(mark), group).groupBy(*group).agg((F.count_if(before) + 1).alias("first_relevant_rank"))
    return _metrics(top.select(*group, "document_id", "rank"), first, expected, queries, ks, keys, best)


def query_metrics(ranked: DataFrame, expected: DataFrame, queries: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """One row per query and K: precision (of K places), recall (of the expected documents), reciprocal rank (over the
    whole list), nDCG. ``ranked`` has (keys..., query_id, document_id, rank), ``expected`` (query_id, document_id);
    queries without results or expectations count with zeros."""
    keys = keys or []
    group = [*keys, "query_id"]
    each = first_per_document(ranked, group)
    hits = each.join(expected.distinct(), ["query_id", "document_id"], "left_semi")
    first = hits.groupBy(*group).agg(F.min("rank").alias("first_relevant_rank"))
    return _metrics(each, first, expected, queries, ks, keys, ranked)


def _metrics(ranked: DataFrame, first: DataFrame, expected: DataFrame, queries: DataFrame, ks: list[int], keys: list[str], configurations: DataFrame) -> DataFrame:
    group = [*keys, "query_id"]
    wanted = expected.distinct().groupBy("query_id").agg(F.count("*").alias("expected"))
    hits = ranked.filter(F.col("rank") <= max(ks)).join(expected.distinct().withColumn("hit", F.lit(1)), ["query_id", "document_id"], "left")
    at = F.explode(F.array(*map(F.lit, ks))).alias("top_k")
    all_queries = queries.select("query_id", at)
    if keys:  # every configuration of every query: a few rows
        all_queries = all_queries.join(small(configurations.select(*keys).distinct(), 10_000), how="cross")
    top = hits.select("*", at).filter(F.col("rank") <= F.col("top_k"))
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    sums = top.groupBy(*group, "top_k").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.sum(gain).alias("dcg"), F.count("*").alias("returned"))
    rows = all_queries.join(sums, [*group, "top_k"], "left").join(first, group, "left").join(wanted, "query_id", "left")
    best = F.aggregate(F.sequence(F.lit(1), F.least("expected", "top_k")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    nothing = F.lit(0.0)
    return rows.select(
        *group,
        "top_k",
        F.coalesce(F.col("hits") / F.col("top_k"), nothing).alias("precision_at_k"),
        F.coalesce(F.col("hits") / F.col("expected"), nothing).alias("recall_at_k"),
        F.coalesce(1 / F.col("first_relevant_rank"), nothing).alias("reciprocal_rank"),
        F.when(F.col("expected") > 0, F.coalesce(F.col("dcg"), nothing) / best).otherwise(nothing).alias("ndcg_at_k"),
        F.coalesce("returned", F.lit(0)).alias("returned_document_count"),
    )


def means() -> list[Column]:
    """The number of queries and the means of their metrics, to six places."""
    named = {"precision_at_k": "mean_precision_at_k", "recall_at_k": "mean_recall_at_k", "reciprocal_rank": "mrr", "ndcg_at_k": "mean_ndcg_at_k"}
    return [F.count("*").alias("query_count"), *(F.round(F.avg(c), 6).alias(name) for c, name in named.items())]


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the queries for each configuration and K."""
    return metrics.groupBy(*keys, "top_k").agg(*means())


def violations(minima: dict[str, float] = MINIMA, maxima: dict[str, int] = MAXIMA) -> Column:
    """Names of the limits that a summary row breaks; a missing value counts as 0."""
    low = [F.when(F.coalesce(F.col(c), F.lit(0.0)) < limit, F.lit(c)) for c, limit in minima.items()]
    high = [F.when(F.coalesce(F.col(c), F.lit(0)) > limit, F.lit(c)) for c, limit in maxima.items()]
    return F.filter(F.array(*low, *high), lambda x: x.isNotNull())


def gated(rows: DataFrame, minima: dict[str, float] = MINIMA, maxima: dict[str, int] = MAXIMA) -> DataFrame:
    """Summary rows with quality_gate_passed and the names of the broken limits."""
    return rows.withColumn("violations", violations(minima, maxima)).withColumn("quality_gate_passed", F.size("violations") == 0)


def _preference(column: str) -> Column:
    out = F.lit(99)
    for i, name in reversed(list(enumerate(PREFERENCES[column]))):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def recommended(rows: DataFrame, top_k: int) -> DataFrame:
    """The best configuration of gated summary rows at ``top_k``."""
    better = [F.desc("mean_recall_at_k"), F.desc("mrr"), F.desc("mean_ndcg_at_k")]
    better += [F.desc(c) for c in ("mean_required_term_coverage_at_k",) if c in rows.columns]
    better += [F.asc(c) for c in MAXIMA if c in rows.columns]
    order = [~F.col("quality_gate_passed"), *better, *(_preference(c) for c in PREFERENCES), "chunk_strategy", "search_method", "reranker"]  # 15 keys
    return rows.filter(F.col("top_k") == top_k).orderBy(*order).limit(1)


def regression(baseline: DataFrame, candidate: DataFrame, metrics: list[str], drop: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Full outer comparison of two reports by configuration: status missing, new, regressed (a metric fell by more than
    ``drop``), improved or unchanged."""
    keys = keys or CONFIGURATION
    pick = lambda df, side: df.select(*keys, *(F.col(m).alias(f"{side}_{m}") for m in metrics), F.lit(True).alias(side))
    both = pick(baseline, "baseline").join(pick(candidate, "candidate"), keys, "full_outer")
    change = [F.round(F.col(f"candidate_{m}") - F.col(f"baseline_{m}"), 6) for m in metrics]
    status = (
        F.when(F.col("candidate").isNull(), "missing")
        .when(F.col("baseline").isNull(), "new")
        .when(F.least(*change) < -drop if len(change) > 1 else change[0] < -drop, "regressed")
        .when(F.greatest(*change) > 0 if len(change) > 1 else change[0] > 0, "improved")
        .otherwise("unchanged")
    )
    return both.select(*keys, status.alias("status"), *(c.alias(f"change_{m}") for c, m in zip(change, metrics, strict=True)))


def term_metrics(top: DataFrame, cases: DataFrame) -> DataFrame:
    """For each query of ``cases`` (query_id, product, version, required_terms, excluded_terms), over its documents in
    ``top`` (query_id, rank, text, product, version): required_term_coverage_at_k (1 without terms), the missing ones,
    excluded_terms_found, product_confusion_count and version_mismatch_count (0 if none is asked for). All are compared
    folded and trimmed."""
    form = lambda c: F.trim(fold(F.col(c)))
    docs = top.select("query_id", "rank", form("text").alias("_text"), form("product").alias("_p"), form("version").alias("_v"))
    asked = cases.select("query_id", form("product").alias("_ap"), form("version").alias("_av"), "required_terms", "excluded_terms")
    rows = docs.join(small(asked.select("query_id", "_ap", "_av")), "query_id")
    wrong = lambda want, got: F.count_if(F.col(want).isNotNull() & ~F.col(want).eqNullSafe(F.col(got)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_text"))), lambda x: x["_text"]), "\n")
    sums = rows.groupBy("query_id").agg(text.alias("_all"), wrong("_ap", "_p").alias("product_confusion_count"), wrong("_av", "_v").alias("version_mismatch_count"))
    joined = asked.join(sums, "query_id", "left").withColumn("_all", F.coalesce("_all", F.lit("")))
    given = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    both = lambda c: F.arrays_zip(given(c).alias("t"), fold_all(given(c)).alias("f"))
    among = lambda c, there: F.transform(F.filter(both(c), lambda x: F.contains(F.col("_all"), F.trim(x["f"])) == F.lit(there)), lambda x: x["t"])
    needed = given("required_terms")
    missing = F.array_distinct(among("required_terms", False))
    zero = F.lit(0).cast("long")
    return joined.select(
        "query_id",
        F.when(F.size(needed) > 0, (F.size(needed) - F.size(missing)) / F.size(needed)).otherwise(1.0).alias("required_term_coverage_at_k"),
        missing.alias("required_terms_missing"),
        among("excluded_terms", True).alias("excluded_terms_found"),
        F.coalesce("product_confusion_count", zero).alias("product_confusion_count"),
        F.coalesce("version_mismatch_count", zero).alias("version_mismatch_count"),
    )


def status_counts(compared: DataFrame) -> DataFrame:
    """Rows of each status of ``regression``."""
    return compared.groupBy("status").agg(F.count("*").alias("rows"))


def content_fingerprint(text: Column) -> Column:
    """SHA-256 of a text whatever its line endings."""
    return F.sha2(F.regexp_replace(text, r"\r\n?", "\n"), 256)


def report_digest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row (rows, digest): a SHA-256 of a report's rows that depends on their values but not on order or report name.
    The rows' digests are summed as two numbers."""
    line = F.to_json(F.struct(*sorted([*keys, *values])), {"ignoreNullFields": "false"})
    return fingerprint(rows, [], line).select(F.col("members").alias("rows"), F.col("fingerprint").alias("digest"))


def readiness(baseline: DataFrame, candidate: DataFrame, again: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row: whether a candidate report may become the baseline. It is ready if its repetition is equal and nothing is
    missing or regressed against the baseline."""
    keys = keys or CONFIGURATION
    counts = regression(baseline, candidate, metrics, keys=keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("missing", "new", "regressed", "improved", "unchanged")))
    first = report_digest(candidate, keys, metrics).select(F.col("digest").alias("candidate_digest"))
    second = report_digest(again, keys, metrics).select(F.col("digest").alias("reproduction_digest"))
    rows = counts.join(F.broadcast(first)).join(F.broadcast(second))  # one row each
    same = F.col("candidate_digest") == F.col("reproduction_digest")
    ready = same & (F.col("missing") == 0) & (F.col("regressed") == 0)
    return rows.withColumn("reproducible", same).withColumn("status", F.when(ready, "ready").otherwise("blocked"))


def baseline_violations(rows: DataFrame) -> DataFrame:
    """What keeps summary rows from being a baseline: (configuration..., violation) for repeated configurations, metrics
    outside 0 to 1 and negative counts."""
    metrics = [c for c in ("mean_precision_at_k", *MINIMA) if c in rows.columns]
    counts = [c for c in MAXIMA if c in rows.columns]
    keys = [c for c in CONFIGURATION if c in rows.columns]
    bad = [F.when(F.coalesce(~F.col(c).between(0, 1), F.lit(True)), F.lit(f"{c} out of range")) for c in metrics]
    bad += [F.when(F.coalesce(F.col(c) < 0, F.lit(True)), F.lit(f"{c} negative")) for c in counts]
    own = rows.select(*keys, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("violation"))
    twice = rows.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("repeated configuration").alias("violation"))
    return own.unionByName(twice)


def ingestion_report(rows: DataFrame) -> DataFrame:
    """(kind, id) of what went wrong when files were read into an index: rows have case_id, expected_included,
    actual_included, sha256, is_archive_entry and source_path. Kinds: false_positive, false_negative, duplicate_group and
    duplicate_violation (id is the hash: repeated, or indexed twice), external_preference_violation (only the archive's
    copy is indexed), invalid_archive_source."""
    cases = [
        ("false_positive", F.col("actual_included") & ~F.col("expected_included")),
        ("false_negative", F.col("expected_included") & ~F.col("actual_included")),
        ("invalid_archive_source", F.col("is_archive_entry") & ~archive_source_path(F.col("source_path"))),
    ]
    kinds = F.filter(F.array(*(F.when(test, F.lit(k)) for k, test in cases)), lambda x: x.isNotNull())
    own = rows.select(F.explode(kinds).alias("kind"), F.col("case_id").alias("id"))
    plain, entry = ~F.col("is_archive_entry"), F.col("is_archive_entry")
    groups = rows.filter(F.coalesce("sha256", F.lit("")) != "").groupBy(F.lower("sha256").alias("id")).agg(
        F.count("*").alias("n"), F.count_if("actual_included").alias("indexed"), F.max(plain).alias("out"), F.max(entry).alias("zip"),
        F.coalesce(F.max(F.col("actual_included") & plain), F.lit(False)).alias("kept"),
    )
    tests = [("duplicate_group", F.col("n") > 1), ("duplicate_violation", F.col("indexed") > 1), ("external_preference_violation", F.col("out") & F.col("zip") & ~F.col("kept"))]
    shared = F.filter(F.array(*(F.when(test, F.lit(k)) for k, test in tests)), lambda x: x.isNotNull())
    return own.unionByName(groups.select(F.explode(shared).alias("kind"), "id"))


def archive_source_path(path: Column) -> Column:
    """Whether a path names an entry of a ZIP archive (``archive.zip!/entry``) that stays inside it."""
    archive, entry = F.regexp_extract(path, r"^(.*?)!/", 1), F.translate(F.regexp_extract(path, r"(?s)^.*?!/(.*)$", 1), "\\", "/")
    away = entry.startswith("/") | entry.rlike(r"^[A-Za-z]:") | F.exists(F.split(entry, "/"), lambda p: p == "..") | entry.rlike(r"^\.(/|$)")
    return F.lower(archive).endswith(".zip") & (entry != "") & ~away


def annotated(rows: DataFrame, as_of: str, stale_days: int) -> DataFrame:
    """Adds to evidence rows (product, version, updated, confidence, asked_product, asked_version, score, rank,
    matched_terms) product_match, version_match (null if not asked for), possibly_stale (null without a date),
    possible_conflict (another version of the product in the query's evidence), keyword_matches (the longest 20),
    warnings and unverified."""
    form = lambda c: F.nullif(F.trim(fold(F.col(c))), F.lit(""))
    match = lambda want, got: F.when(form(want).isNotNull(), form(want).eqNullSafe(form(got)))
    date = F.to_timestamp(F.col("updated"))
    conflicts = version_conflicts(rows.withColumn("_key", F.struct("query_id", "product")), "_key", "version").drop("_key")
    order = lambda x, y: F.when(F.char_length(x) != F.char_length(y), F.char_length(y) - F.char_length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)
    rows = conflicts.withColumns(
        {
            "product_match": match("asked_product", "product"),
            "version_match": match("asked_version", "version"),
            "possibly_stale": date < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {stale_days} days"),
            "possible_conflict": F.col("conflict") & F.col("product").isNotNull(),
            "keyword_matches": F.slice(F.array_sort(F.array_distinct("matched_terms"), order), 1, 20),
        }
    ).drop("conflict")
    warnings = {"ProductMismatch": ~F.col("product_match"), "VersionMismatch": ~F.col("version_match"), "PossiblyStale": F.col("possibly_stale"), "PossibleConflict": F.col("possible_conflict")}
    unknown = {"version": F.col("version").isNull(), "updated": date.isNull(), "confidence": F.col("confidence").isNull()}
    listed = lambda d: F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in d.items())), lambda x: x.isNotNull())
    return rows.withColumns({"warnings": listed(warnings), "unverified": listed(unknown)})
