"""Evidence ranked by topic: assessment of candidates, a choice that completes coverage, and why it falls short.

Candidates have query_id, candidate_id, original_rank, text, folded (its folded form), query_profile and profile (``topics.profiled``),
requested_product and requested_version (of the query), product_name, version, technical_tokens (of the query), source_type,
base_score, excluded, manually_selected and, if there are, lexical_score and semantic_score.

Defined cases: null products, versions, tokens and scores are none; a query without candidates has no row; ties go by topic,
entity and base score, then to the earlier rank, then to the greater candidate_id; equal texts are picked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold, fold_all
from caselens.scratch import written

from . import coverage, selection, topics

# The items that a text may cover of a feature, and of an upload, with their words; limits of the choice.
FEATURE_ITEMS = {
    "A": ["概要", "とは", "overview", "what is", "definition"],
    "B": ["用途", "目的", "使用する", "used for", "purpose", "use case"],
    "C": ["設定", "作成", "手順", "configure", "configuration", "setup", "create", "step"],
    "D": ["関連付け", "紐付け", "associate", "association", "link", "project", "qac"],
    "E": ["確認", "検証", "状態", "verify", "verification", "confirm", "status", "check"],
}
COMMAND_WORDS, UPLOAD_WORDS = ["qacli", "command", "コマンド"], ["upload", "アップロード", "validate build"]
OPTION_WORDS, RUN_WORDS = ["option", "parameter", "オプション", "引数"], ["execute", "run", "実行"]
UPLOAD_ITEMS = {
    "U-C": ["auth", "authentication", "login", "credential", "token", "認証", "ログイン"],
    "U-D": ["project", "associate", "association", "関連付け", "紐付け"],
    "U-G": ["fail", "error", "check", "失敗", "エラー", "トラブルシュート"],
}
SHOWN_WORDS = ["confirm", "verify", "portal", "確認", "表示"]
GAIN, MOST, LOW_CONFIDENCE, LOW_COVERAGE = 0.06, 5, 0.25, 3


def flat(value: Column) -> Column:
    """A folded name without white space; null if it is blank."""
    return F.nullif(F.regexp_replace(fold(value), r"\s+", ""), F.lit(""))


def upload_workflow(query: Column) -> Column:
    """Whether a question's profile is about uploads to Validate."""
    named = F.exists(query["components"], lambda c: F.lower(F.trim(c)) == "validate")
    return F.array_contains(query["features"], "Build upload") | (F.array_contains(query["operations"], "Upload") & named)


def covered(query: Column, evidence: Column, text: Column, folded: Column, match: Column, conflict: Column) -> Column:
    """The items A to E of a feature and U-A to U-G of an upload that a text covers for a question."""
    has = lambda words: coverage.has_any(folded, words)
    feature = (F.size(query["features"]) > 0) & (F.size(evidence["features"]) > 0) & match
    upload = upload_workflow(query) & ~conflict
    command = has(COMMAND_WORDS)
    flags = [(item, feature & has(words)) for item, words in FEATURE_ITEMS.items()]
    flags += [
        ("U-A", upload & command & has(UPLOAD_WORDS)),
        ("U-B", upload & (text.rlike(coverage.OPTION) | has(OPTION_WORDS))),
        ("U-C", upload & has(UPLOAD_ITEMS["U-C"])),
        ("U-D", upload & has(UPLOAD_ITEMS["U-D"])),
        ("U-E", upload & (command | has(RUN_WORDS))),
        ("U-F", upload & has(["validate"]) & has(SHOWN_WORDS)),
        ("U-G", upload & has(UPLOAD_ITEMS["U-G"])),
    ]
    return coverage.listed(flags)


def assessed(candidates: DataFrame) -> DataFrame:
    """``candidates`` (written) with product_match, version_match, technical_score, source_trust, what ``topics.ranked`` adds,
    covers (their coverage) and fingerprint."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.coalesce("technical_tokens", F.array().cast("array<string>"))
    rows = candidates.withColumn("_tokens", fold_all(tokens)).withColumns({"_asked": flat(F.col("requested_product")), "_own": flat(F.col("product_name"))})
    number = lambda v: F.nullif(F.regexp_extract(F.coalesce(v, F.lit("")), selection.VERSION, 1), F.lit(""))
    actual = F.coalesce(number(F.col("version")), number(text))
    wanted = F.nullif(F.trim("requested_version"), F.lit(""))
    status = F.when(wanted.isNull(), "not_requested").when(number(wanted).isNull() | actual.isNull(), "unknown").otherwise(selection.version_status(number(wanted), actual))
    held = F.size(F.filter("_tokens", lambda t: F.contains(F.col("folded"), F.trim(t))))
    rows = rows.withColumns(
        {
            "product_match": F.col("_asked") == F.col("_own"),
            "version_match": status,
            "technical_score": F.when(F.size("_tokens") > 0, held / F.size("_tokens")),
            "source_trust": selection.source_trust(F.col("source_type")),
            "_manual": F.coalesce("manually_selected", F.lit(False)),
        }
    )
    rows = rows.withColumn("_shunned", F.coalesce("excluded", F.lit(False))).withColumn("excluded", F.col("_shunned") & ~F.col("_manual"))
    rows = topics.ranked(rows, shares=True).withColumn("topic_conflict", F.size("conflict_kinds") > 0)
    own = covered(F.col("query_profile"), F.col("profile"), text, F.col("folded"), F.col("has_topic_match"), F.col("topic_conflict"))
    rows = rows.withColumn("covers", own).withColumn("fingerprint", F.sha2("folded", 256)).withColumn("excluded", F.col("_shunned"))
    return rows.drop("_tokens", "_asked", "_own", "_manual", "_shunned")


def chosen(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, candidate_id, pick, score, covered): of ``assessed`` rows (written) up to five a query, each the one of the
    greatest score plus ``GAIN`` for each item that is new, in rounds that pick one of each query. Rows of another product or in
    conflict are out unless they were selected by hand; covered is what the picks so far cover."""
    none = F.array().cast("array<string>")
    able = rows.filter(F.coalesce("manually_selected", F.lit(False)) | (F.coalesce("product_match", F.lit(True)) & ~F.col("topic_conflict")))
    able = able.select("query_id", "candidate_id", "original_rank", "final_score", "topic_score", "entity_score", F.coalesce("base_score", F.lit(0.0)).alias("base_score"), "covers", "fingerprint")
    state = able.select("query_id").distinct().withColumns({"_covered": none, "_seen": none})
    out = None
    for n in range(1, max(0, min(most, MOST)) + 1):
        each = able.join(state, "query_id").filter(~F.array_contains("_seen", F.col("fingerprint")))
        value = F.round(F.col("final_score") + GAIN * F.size(F.array_except("covers", "_covered")), 6)
        order = F.struct(value.alias("v"), "topic_score", "entity_score", "base_score", (-F.col("original_rank")).alias("r"), "candidate_id")
        best = F.max_by(F.struct("candidate_id", F.col("final_score").alias("score"), "covers", "fingerprint", "_covered", "_seen"), order)
        picked = each.groupBy("query_id").agg(best.alias("_b")).select("query_id", F.lit(n).alias("pick"), "_b.*")
        picked = written(picked.withColumn("covered", F.array_union("_covered", "covers")), "topic-pick")
        part = picked.select("query_id", "candidate_id", "pick", "score", F.array_sort("covered").alias("covered"))
        out = part if out is None else out.unionByName(part)
        state = picked.select("query_id", F.col("covered").alias("_covered"), F.concat("_seen", F.array("fingerprint")).alias("_seen"))
        if picked.isEmpty():
            break
    return out


def insufficient_reasons(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """(query_id, reasons) for each query of ``assessed`` rows: why the picks of ``chosen`` fall short, in the order of the rules.
    Each is a difference of what is needed and what was found or chosen, told by aggregates over a query's rows."""
    sets = picks.groupBy("query_id").agg(F.max_by("covered", "pick").alias("_covered"), F.count("*").alias("_picks"))
    mine = rows.join(picks.select("query_id", "candidate_id", F.lit(True).alias("_picked")), ["query_id", "candidate_id"], "left")
    picked = F.coalesce("_picked", F.lit(False))
    known = F.when(picked, flat(F.col("version")))
    mine = mine.withColumns({"_in": picked, "_version": known})
    sums = mine.groupBy("query_id").agg(
        F.any_value("query_profile").alias("q"),
        F.any_value("requested_version").alias("_wanted"),
        F.coalesce(F.max(F.col("_in") & F.col("has_topic_match")), F.lit(False)).alias("_match"),
        F.max("topic_conflict").alias("_conflict"),
        F.min(F.coalesce(~F.col("product_match"), F.lit(False))).alias("_other"),
        F.max(F.when(F.col("_in"), F.col("final_score"))).alias("_best"),
        F.coalesce(F.max(F.col("_in") & F.col("version_match").isin("exact", "near")), F.lit(False)).alias("_near"),
        F.min("_version").alias("_lo"),
        F.max("_version").alias("_hi"),
    )
    sums = sums.join(sets, "query_id", "left").withColumns({"_covered": F.coalesce("_covered", F.array().cast("array<string>")), "_picks": F.coalesce("_picks", F.lit(0))})
    q, some = F.col("q"), F.col("_picks") > 0
    feature = F.size(q["features"]) > 0
    lacks = lambda item: ~F.array_contains("_covered", item)
    intends = lambda *names: F.arrays_overlap(q["intents"], F.array(*map(F.lit, names)))
    setup, upload = intends("HowTo", "Configuration"), upload_workflow(q)
    flags = [
        ("NoTopicMatch", (feature | (F.size(q["components"]) > 0)) & ~F.col("_match")),
        ("TopicConflict", ~some & F.col("_conflict")),
        ("ProductMismatch", F.col("_other")),
        ("MissingOverview", feature & intends("Overview") & lacks("A")),
        ("MissingSetupProcedure", feature & setup & lacks("C")),
        ("MissingVerification", feature & setup & lacks("E")),
        ("LowCoverage", feature & (F.size("_covered") < LOW_COVERAGE)),
        ("MissingCommand", upload & intends("Command") & lacks("U-A")),
        ("MissingSetupProcedure", upload & intends("HowTo") & (lacks("U-E") | lacks("U-F"))),
        ("LowConfidence", some & (F.col("_best") < LOW_CONFIDENCE)),
        ("VersionMismatch", (F.trim(F.coalesce("_wanted", F.lit(""))) != "") & some & ~F.col("_near")),
        ("ConflictingEvidence", F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))),
    ]
    return sums.select("query_id", coverage.listed(flags).alias("reasons"))


def adapted(rows: DataFrame, adjustment: Column | None = None) -> DataFrame:
    """``assessed`` rows as candidates of ``selection.coverage_selection``: their quality from the ranking, what they cover of
    what a question may need, and why they are out. ``adjustment`` raises (above 0) or lowers scores within their bounds."""
    by = F.lit(0.0) if adjustment is None else adjustment
    moved = lambda c: F.when(by > 0, F.col(c) + (1 - F.col(c)) * by).otherwise(F.col(c) * (1 + by))
    version = F.when(F.col("version_match") == "exact", 1.0).when(F.col("version_match") == "near", 0.5).otherwise(0.0)
    scored = rows.withColumns(
        {
            "ranking_score": moved("final_score"),
            "topic_score": moved("topic_score"),
            "technical_token_score": F.coalesce("technical_score", F.lit(0.0)),
            "version_score": version,
        }
    )
    off = F.col("topic_conflict") | ((F.size(F.col("query_profile")["features"]) > 0) & ~F.col("has_topic_match"))
    return scored.select(
        "query_id", "candidate_id", "original_rank", F.round(selection.quality(-F.col("penalty") + F.least(F.lit(0.0), by)), 6).alias("quality"), coverage.observed(F.col("text"), F.col("folded")).alias("coverage"), "source_type",
        "document_id", "section", F.col("fingerprint").alias("content_hash"), "text", "technical_tokens", F.coalesce("manually_selected", F.lit(False)).alias("manually_selected"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"), off.alias("topic_conflict"), F.coalesce(~F.col("product_match"), F.lit(False)).alias("product_mismatch"),
    )


def coverage_shortfalls(candidates: DataFrame, needed: DataFrame, picks: DataFrame) -> DataFrame:
    """(query_id, needed, not_found, not_chosen): of what a question needs (query_id, required_coverage), what no candidate covers, and
    what some candidate covers but no pick of ``selection.coverage_selection``."""
    none = F.array().cast("array<string>")
    found = candidates.select("query_id", F.explode("coverage").alias("c")).distinct().groupBy("query_id").agg(F.collect_set("c").alias("_found"))
    taken = picks.join(candidates.select("query_id", "candidate_id", "coverage"), ["query_id", "candidate_id"]).select("query_id", F.explode("coverage").alias("c")).distinct().groupBy("query_id").agg(F.collect_set("c").alias("_taken"))
    rows = needed.join(found, "query_id", "left").join(taken, "query_id", "left")
    wanted, there, held = F.coalesce("required_coverage", none), F.coalesce("_found", none), F.coalesce("_taken", none)
    return rows.select("query_id", F.array_sort(wanted).alias("needed"), F.array_sort(F.array_except(wanted, there)).alias("not_found"), F.array_sort(F.array_except(F.array_intersect(wanted, there), held)).alias("not_chosen"))
