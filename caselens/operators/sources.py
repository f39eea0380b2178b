"""Search results of all kinds as common rows: filters, gates, priorities, limits and unions.

A row has query_id, source_type (OfficialDoc, Manual, ExactPastAnswer, PastAnswer, PastCaseNote, CuratedFact), source_id,
title, text, score and what else a caller needs. Types are compared without case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.scratch import small

# The order of the united sources, priorities by type of question, and limits.
UNION_ORDER = ["OfficialDoc", "Manual", "PastAnswer", "PastCaseNote"]
PRIORITY = {
    "TroubleshootingQuestion": ["CuratedFact", "ExactPastAnswer", "Manual", "OfficialDoc", "PastAnswer", "PastCaseNote"],
    "HowToQuestion": ["CuratedFact", "Manual", "OfficialDoc", "ExactPastAnswer", "PastAnswer", "PastCaseNote"],
    "": ["CuratedFact", "OfficialDoc", "Manual", "ExactPastAnswer", "PastAnswer", "PastCaseNote"],
}
FRESH_PRIORITY = {True: ["OfficialDoc", "Manual", "PastCaseNote"], False: ["Manual", "OfficialDoc", "PastCaseNote"]}
PAST = ["exactpastanswer", "pastanswer", "pastcasenote"]
LATEST = "LatestVersionQuestion"
FRESH_LEAST, FRESH_MANUALS, FRESH_CASES = 0.25, 2, 1
FAMILY_LEAST = 0.45


def score_of() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


def is_type(*names: str) -> Column:
    return F.coalesce(F.lower("source_type").isin([n.lower() for n in names]), F.lit(False))


def clamped(value: float) -> float:
    return min(1.0, max(0.0, value))


def common_rows(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The sources' rows one below the other with their type and its ordinal, in the order of ``UNION_ORDER``; a column
    that a source lacks is null."""
    rows = [df.withColumns({"source_type": F.lit(t), "ordinal": F.lit(i)}) for i, t in enumerate(UNION_ORDER) if (df := parts.get(t)) is not None]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return united.select("ordinal", "source_type", *columns)


def visible(rows: DataFrame, source_type: str | None = None, least: float = 0.0) -> DataFrame:
    """The rows of a type (None or All: any) with at least a score, which is clamped; a missing score is 0."""
    shown = rows.filter(score_of() >= clamped(least))
    return shown if not (source_type or "").strip() or source_type.lower() == "all" else shown.filter(is_type(source_type))


def with_selection(rows: DataFrame, source_type: str | None, threshold: float, least: float = 0.0) -> DataFrame:
    """``selected`` set by a threshold for the rows that are visible; others keep theirs."""
    shown = score_of() >= clamped(least)
    if (source_type or "").strip() and source_type.lower() != "all":
        shown = shown & is_type(source_type)
    return rows.withColumn("selected", F.when(shown, score_of() >= clamped(threshold)).otherwise(F.col("selected")))


def auto_selected(fresh: Column, least: float) -> Column:
    """Whether a row is taken without being chosen: official pages by their own threshold where freshness counts."""
    return F.when(is_type("OfficialDoc") & fresh, score_of() >= FRESH_LEAST).otherwise(score_of() >= least)


def _place(order: list[str], default: int) -> Column:
    out = F.lit(default)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(is_type(name), i).otherwise(out)
    return out


def source_priority(types: Column) -> Column:
    """The place of a row's type among the sources for a question of some types."""
    out = _place(PRIORITY[""], 6)
    for name in ("HowToQuestion", "TroubleshootingQuestion"):
        out = F.when(F.array_contains(types, name), _place(PRIORITY[name], 6)).otherwise(out)
    return out


def freshness_priority(fresh: Column) -> Column:
    return F.when(fresh, _place(FRESH_PRIORITY[True], 3)).otherwise(_place(FRESH_PRIORITY[False], 3))


def relevant(rows: DataFrame, product: Column, types: Column) -> DataFrame:
    """Rows of no or the question's product; none of past cases for a question about the latest version."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    same = blank(F.col("product_name")) | blank(product) | (F.lower("product_name") == F.lower(product))
    past = F.coalesce(F.lower("source_type").isin(PAST), F.lit(False))
    return rows.filter(same & ~(F.array_contains(types, LATEST) & past))


def best_per_source(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of rows of one type and id, as different queries or variants found them, the one of the best score, of equal ones the
    first by its other columns."""
    keys = ["source_type", "source_id"] if keys is None else keys
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct((-score_of()).alias("_s"), *rest))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(*rows.columns)


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The parts united; of rows of one key that of the earliest part stays, within a part that of the best score, then the
    first by its other columns."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in rows.columns if c not in keys and c != "_part"]
    first = F.min(F.struct("_part", (-score_of()).alias("_s"), *rest))
    return rows.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*").select(*parts[0].columns)


def merged(preferred: DataFrame, additional: DataFrame, top: int) -> DataFrame:
    """Hits by support number before those of a search: the best row of each source, those first, then by score."""
    rows = preferred.withColumn("preferred", F.lit(True)).unionByName(additional.withColumn("preferred", F.lit(False)))
    key = Window.partitionBy("query_id", "source_type", "source_id").orderBy(F.desc("preferred"), F.desc(score_of()))
    once = rows.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("query_id").orderBy(F.desc("preferred"), F.desc(score_of()), "source_type", "source_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def displayed(rows: DataFrame) -> DataFrame:
    """All rows of a query by score, type and id, with their place from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score_of()), "source_type", "source_id")
    return rows.withColumn("place", F.row_number().over(w))


def exact_answers(rows: DataFrame, top: int) -> DataFrame:
    """Exact past answers of all products, by score and time of retrieval, ``top`` of a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score_of()), F.desc("retrieved_at"), "source_id")
    return rows.filter(is_type("ExactPastAnswer")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def limited_per_type(rows: DataFrame, limit: int, order: list[Column | str]) -> DataFrame:
    """The first ``limit`` rows of each type of a query."""
    w = Window.partitionBy("query_id", "source_type").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def family(source_type: Column) -> Column:
    """OfficialDoc, Manual or PastCase (answers and notes alike), else the type itself."""
    kind = F.lower(source_type)
    return F.when(kind == "officialdoc", "OfficialDoc").when(kind == "manual", "Manual").when(kind.isin(PAST), "PastCase").otherwise(source_type)


def represented(rows: DataFrame, top: int) -> DataFrame:
    """The best row of each family that has matched terms and a score of 0.45, then others by score, ``top`` in all."""
    own = Window.partitionBy("query_id", family(F.col("source_type"))).orderBy(F.desc(score_of()), "source_id")
    able = family(F.col("source_type")).isin("OfficialDoc", "Manual", "PastCase") & (score_of() >= FAMILY_LEAST) & (F.size("matched_terms") > 0)
    ranked = rows.withColumn("_able", F.coalesce(able, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("query_id", family(F.col("source_type")), "_able").orderBy(F.desc(score_of()), "source_id"))
    ranked = ranked.withColumn("_lead", F.col("_able") & (first == 1))
    again = Window.partitionBy("query_id").orderBy(F.desc("_lead"), F.desc(score_of()), "source_id")
    return ranked.withColumn("_n", F.row_number().over(again)).filter(F.col("_n") <= top).drop("_able", "_lead", "_n")


def selection(rows: DataFrame, most: int, threshold: float, fallback: bool = True) -> DataFrame:
    """What is sent for each query of rows with selected, manual, excluded (by hand) and fresh (of the query): chosen rows
    that are manual or reach the threshold; if there are none, the best of all not excluded (with ``fallback``). Where
    freshness counts official pages go first, and without one at most two manuals and one past case stay. ``state`` is
    sent, limit, freshness, score (chosen but too low) or null."""
    least = clamped(threshold)
    passed = F.col("selected") & (F.col("manual") | auto_selected(F.col("fresh"), least))
    rows = rows.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    everything = Window.partitionBy("query_id")
    none = ~F.max("_passed").over(everything)
    spare = none & ~F.col("excluded") if fallback and most > 0 else F.lit(False)
    order = [F.when(F.col("fresh"), freshness_priority(F.lit(True))).otherwise(0), F.desc(score_of()), F.col("source_id")]
    rows = rows.withColumn("_none", none).withColumn("_in", F.col("_passed") | spare)
    place = F.row_number().over(Window.partitionBy("query_id", "_in").orderBy(*order))
    rows = rows.withColumn("_in", F.col("_in") & (F.col("_passed") | (place <= most)))
    official = F.max(F.col("_in") & is_type("OfficialDoc")).over(everything)
    nth = F.row_number().over(Window.partitionBy("query_id", "_in", F.lower("source_type")).orderBy(*order))
    allowed = (is_type("Manual") & (nth <= FRESH_MANUALS)) | (is_type("PastCaseNote") & (nth <= FRESH_CASES))
    rows = rows.withColumn("_kept", F.col("_in") & (~F.col("fresh") | official | allowed))
    again = F.row_number().over(Window.partitionBy("query_id", "_kept").orderBy(*order))
    rows = rows.withColumn("_n", again)
    state = (
        F.when(F.col("_kept") & (F.col("_n") <= most), "sent")
        .when(F.col("_kept"), "limit")
        .when(F.col("_in"), "freshness")
        .when(F.col("selected") & ~F.col("_passed"), "score")
    )
    return rows.withColumn("state", state).drop("_passed", "_none", "_in", "_kept", "_n")


def selection_summary(rows: DataFrame, threshold: float, display: float = 0.0, source_type: str | None = None) -> DataFrame:
    """Counts of each query over the rows of ``selection``: found, selected and sent, by type, hidden ones and why."""
    of = lambda t, test: F.count_if(is_type(t) & test)
    sent, chosen = F.col("state") == "sent", F.col("selected")
    right = is_type(source_type) if (source_type or "").strip() and source_type.lower() != "all" else F.lit(True)
    types = ["OfficialDoc", "Manual", "PastCaseNote"]
    return rows.groupBy("query_id").agg(
        F.count("*").alias("results"),
        F.count_if(chosen).alias("selected"),
        *(of(t, chosen).alias(f"selected_{t}") for t in types),
        *(of(t, F.coalesce(sent, F.lit(False))).alias(f"sent_{t}") for t in types),
        *(F.count_if(F.col("state") == s).alias(f"by_{s}") for s in ("limit", "freshness", "score")),
        F.count_if(~right).alias("hidden_by_type"),
        F.count_if(right & (score_of() < clamped(display))).alias("hidden_by_score"),
        F.count_if(score_of() < clamped(threshold)).alias("below_threshold"),
    )


def _chunks_about(sets: DataFrame, indexed: DataFrame) -> DataFrame:
    """(product, _set, feature_matches): the different chunks about a feature of each set, counted once for all queries that ask for it.
    Those of a single feature are a sum over the chunks; only sets of several meet the chunks themselves."""
    own = indexed.select("product", "feature", "chunk_id").filter("product IS NOT NULL AND feature IS NOT NULL")
    sums = own.groupBy("product", "feature").agg(F.count_distinct("chunk_id").alias("feature_matches"))
    one = sums.select("product", F.array("feature").alias("_set"), "feature_matches").join(sets, ["product", "_set"], "left_semi")
    several = sets.filter(F.size("_set") > 1).select("product", "_set", F.explode("_set").alias("feature"))
    met = own.join(small(several), ["product", "feature"]).groupBy("product", "_set").agg(F.count_distinct("chunk_id").alias("feature_matches"))
    return one.unionByName(met)


def official_diagnostics(queries: DataFrame, results: DataFrame, index: DataFrame, indexed: DataFrame) -> DataFrame:
    """How official pages came into each query's answer: its counts of them found, selected, sent and of an asked version, the chunks of its product's
    index, those of an asked feature, and the diagnosis: the first step at which there were none. ``queries`` has query_id, product,
    document_urls (registered ones), target_versions and features; ``results`` the rows of ``selection`` with title, text, url and matched_terms;
    ``index`` (product, chunks, fetch_failures) the indexes there are; ``indexed`` (product, chunk_id, feature) what their chunks are about."""
    asked = queries.select("query_id", "product", "document_urls", F.coalesce("target_versions", F.array().cast("array<string>")).alias("target_versions"), F.coalesce("features", F.array().cast("array<string>")).alias("features"))
    told = lambda v: F.coalesce(F.contains(F.lower(F.concat_ws("\n", "title", "text", "url")), F.lower(v)), F.lit(False)) | F.exists(F.coalesce("matched_terms", F.array().cast("array<string>")), lambda t: F.lower(t) == F.lower(v))
    official = results.filter(is_type("OfficialDoc")).join(asked.select("query_id", "target_versions"), "query_id")
    counts = official.groupBy("query_id").agg(
        F.count("*").alias("found"),
        F.count_if("selected").alias("selected"),
        F.count_if(F.coalesce(F.col("state") == "sent", F.lit(False))).alias("sent"),
        F.count_if(F.exists("target_versions", told)).alias("version_matches"),
    )
    sets = asked.select("query_id", "product", F.array_sort(F.array_distinct("features")).alias("_set"))
    about = sets.join(_chunks_about(sets.select("product", "_set").distinct(), indexed), ["product", "_set"]).select("query_id", "feature_matches")
    rows = asked.join(index, "product", "left").join(counts, "query_id", "left").join(about, "query_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    diagnosis = (
        F.when(F.col("product").isNull() | (number("document_urls") == 0), "CrawlNotConfigured")
        .when(F.col("chunks").isNull(), "IndexMissing")
        .when(F.col("chunks") == 0, F.when(number("fetch_failures") > 0, "CrawlFailed").otherwise("IndexEmpty"))
        .when((F.size("features") > 0) & (number("feature_matches") == 0), "IndexCoverageMissing")
        .when(number("found") == 0, "SearchMismatch")
        .when(number("selected") == 0, "SelectorExcluded")
        .when(number("sent") == 0, "FinalSelectionExcluded")
        .otherwise("Selected")
    )
    return rows.select("query_id", *(number(c).alias(c) for c in ("chunks", "feature_matches", "found", "selected", "sent", "version_matches")), diagnosis.alias("diagnosis"))


def quality_evidence(chosen: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """The sources and what a result reports as evidence beyond them."""
    return chosen.unionByName(reported.join(chosen.select(*keys).distinct(), keys, "left_anti"))


def source_counts(types: Column) -> Column:
    """struct(used, official, manual, past, other) of an array of source types, blank ones not counted."""
    given = F.filter(types, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    count = lambda names: F.size(F.filter(given, lambda t: F.lower(t).isin(names)))
    official, manual, past = count(["officialdoc", "official"]), count(["manual"]), count([*PAST, "pastcase"])
    return F.struct(F.size(given).alias("used"), official.alias("official"), manual.alias("manual"), past.alias("past"), (F.size(given) - official - manual - past).alias("other"))


def query_variants(query: str, features: dict[str, list[str]], analysis: bool = False, most: int = 8) -> list[str]:
    """A query and its forms with each alias of a feature put for the others, different without case, ``most`` at most."""
    import re

    out = [query]
    for name, aliases in features.items():
        forms = list({f.lower(): f for f in reversed([name, *aliases]) if f.strip()}.values())[::-1]
        for new in forms:
            form = query
            for old in forms:
                form = re.sub(re.escape(old), lambda _, new=new: new, form, flags=re.I)
            out.append(form)
    if analysis:
        out += [f"{query} qacli analyze project analysis run analysis", "qacli analyze project analysis procedure"]
    seen: dict[str, str] = {}
    for form in out:
        if form.strip():
            seen.setdefault(form.lower(), form)
    return list(seen.values())[:most]
