"""Evidence for an answer: the builder that chooses within a budget, and the payload that says why each item was chosen.

Defined cases: null titles and texts are empty; sources of another product, or of past cases where the latest version is asked
for, are no candidates; ties go by source_id; of repeated rows each is a candidate, though its text repeats a pick; queries
without candidates have no row; payloads of queries without results are not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import jaccard
from caselens.scratch import written

from . import evaluation, sources
from .selection import NEAR_DUPLICATE

# Characters of an excerpt, words of a text that are compared, the default of items, the least budget, and the texts of
# warnings, open points and reasons.
EXCERPT, WORDS, ITEMS, LEAST_BUDGET = 240, 200, 2, 600
WARNINGS = {
    "ProductMismatch": "対象製品と根拠の製品が一致しません。", "VersionMismatch": "対象バージョンと根拠のバージョンが一致しません。",
    "PossiblyStale": "根拠が設定された鮮度基準より古い可能性があります。", "PossibleConflict": "同一製品の異なるバージョンの根拠が含まれています。",
}
OPEN = {"version": "根拠の対象バージョン", "updated": "根拠の作成日または更新日", "confidence": "根拠の信頼度"}
UNASKED = "未指定"
# Items that are taken over from elsewhere (by default and at most) and the bytes of a file that holds them.
TAKEN, MOST_TAKEN, MOST_BYTES = 3, 5, 10 << 20
VERSION_WARNING, VERSION_WORD = "対象バージョンと根拠のバージョンが一致しません。", "バージョン"


def excerpt(text: Column) -> Column:
    """The lines of a text, trimmed and joined, of which 240 characters are shown."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]"), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(lines, " ")
    return F.when(F.char_length(joined) <= EXCERPT, joined).otherwise(F.concat(F.substring(joined, 1, EXCERPT), F.lit("...")))


def compared_words(text: Column) -> Column:
    """The different words, without case, among the first 200 of two letters or more: those by which texts repeat each other."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \r\n\t。、,.:;/\\_-]+"), lambda w: F.char_length(F.trim(w)) > 1)
    return F.array_distinct(F.transform(F.slice(words, 1, WORDS), lambda w: F.lower(F.trim(w))))


def built(candidates: DataFrame, product: Column, types: Column, characters: int, items: int = ITEMS) -> DataFrame:
    """(query_id, source_id, pick, excerpt, used, relevance): of the sources (query_id, source_id, source_type, title, text, score,
    product_name) those that are relevant, by priority for the question's types and by score, up to ``items``; the first always, then each that
    repeats no pick and fits the budget of half the characters (600 at least) with its title and excerpt. One that is passed
    over is not looked at again, so each round takes the first able one behind the last pick, and no query's rows gather."""
    budget = max(LEAST_BUDGET, characters // 2)
    rows = sources.relevant(candidates, product, types)
    key = F.struct(sources.source_priority(types).alias("p"), (-sources.score_of()).alias("s"), F.col("source_id").alias("i"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(
        "query_id", "source_id", key.alias("key"), excerpt(F.col("text")).alias("excerpt"), compared_words(F.col("text")).alias("words"), F.char_length(F.coalesce("title", F.lit(""))).alias("_title"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), sources.score_of())).alias("relevance"),
    )
    rows = written(rows.withColumn("cost", F.col("_title") + F.char_length("excerpt")).drop("_title"), "sources")
    state, out = None, None
    for n in range(1, max(1, items) + 1):
        if state is None:
            able = rows.withColumns({"_used": F.lit(0), "_kept": F.array().cast("array<array<string>>")})
        else:
            behind = rows.join(state, "query_id").filter(F.col("key") > F.col("_last"))
            repeats = F.exists("_kept", lambda w: (F.size(w) > 0) & (F.size("words") > 0) & (jaccard(w, F.col("words")) >= NEAR_DUPLICATE))
            able = behind.filter(~repeats & (F.col("_used") + F.col("cost") <= budget))
        best = F.min_by(F.struct("source_id", "key", "excerpt", "words", "cost", "relevance", "_used", "_kept"), "key")
        picked = able.groupBy("query_id").agg(best.alias("b")).select("query_id", F.lit(n).alias("pick"), "b.*")
        picked = written(picked.withColumn("used", F.col("_used") + F.col("cost")), "evidence-pick")
        part = picked.select("query_id", "source_id", "pick", "excerpt", "used", "relevance")
        out = part if out is None else out.unionByName(part)
        state = picked.select("query_id", F.col("used").alias("_used"), F.col("key").alias("_last"), F.concat("_kept", F.array("words")).alias("_kept"))
    return out


def payload_items(results: DataFrame, top: int, as_of: str, stale_days: int) -> DataFrame:
    """The items of each query's payload: of its results (query_id, rank, score, document_id, support_id, product, version, source_type, updated,
    confidence, text, matched_terms, asked_product, asked_version) the first chunk of each document, ``top`` of them, with place, what
    ``evaluation.annotated`` tells, and why it was chosen."""
    own = Window.partitionBy("query_id", "document_id").orderBy("rank")
    first = results.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= top)
    rows = evaluation.annotated(placed, as_of, stale_days)
    told = lambda c: F.when(F.col(c).isNull(), F.lit(UNASKED)).when(F.col(c), F.lit("True")).otherwise(F.lit("False"))
    reason = F.concat(
        F.lit("検索順位"), F.col("rank").cast("string"), F.lit("位、スコア"), F.format_string("%.6f", F.col("score").cast("double")), F.lit("。製品一致="), told("product_match"), F.lit("、バージョン一致="), told("version_match"),
        F.lit("、キーワード一致="), F.size("keyword_matches").cast("string"), F.lit("件。"),
    )
    by = lambda c, words: F.transform(F.col(c), lambda x: F.create_map(*[F.lit(v) for kv in words.items() for v in kv])[x])
    return rows.withColumns({"selection_reason": reason, "warning_texts": by("warnings", WARNINGS), "open_texts": by("unverified", OPEN), "source_type": F.coalesce("source_type", F.lit("Unknown"))})


def payloads(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, payload): one JSON text for each query of ``payload_items``, whose few items lie in it in their places."""
    item = F.struct(
        F.col("source_type").alias("sourceType"), F.col("document_id").alias("documentId"), F.col("support_id").alias("supportId"), "product", "version", F.round("score", 8).alias("score"), F.col("selection_reason").alias("selectionReason"),
        F.col("warning_texts").alias("warnings"), "text", F.col("product_match").alias("productMatch"), F.col("version_match").alias("versionMatch"), F.col("keyword_matches").alias("keywordMatches"),
        F.col("possibly_stale").alias("possiblyStale"), F.col("possible_conflict").alias("possibleConflict"), F.col("open_texts").alias("unverifiedItems"),
    )
    grouped = items.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("selectedEvidence"))
    body = F.to_json(F.struct("query", "selectedEvidence"), {"ignoreNullFields": "false"})
    return grouped.join(queries.select("query_id", "query"), "query_id").select("query_id", body.alias("payload"))


def taken_over(items: DataFrame, most: int = 0) -> DataFrame:
    """``items`` of payloads made elsewhere (query_id, place, document_id, text, product, version, product_match, version_match, warnings,
    asked_product, asked_version, ready) with state: NotReady where the baseline they rest on is not, Incomplete without document or text,
    OtherProduct, Taken for the first ``most`` others of a query (3 by default, 5 at most) or Beyond; those of another version get a
    warning of it."""
    limit = min(MOST_TAKEN, max(1, TAKEN if most <= 0 else most))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    differs = lambda asked, got, told: F.coalesce(~F.col(told), F.lit(False)) | (~blank(asked) & ~blank(got) & (F.lower(F.trim(asked)) != F.lower(F.trim(got))))
    out = F.when(~F.coalesce("ready", F.lit(False)), "NotReady").when(blank("document_id") | blank("text"), "Incomplete").when(differs("asked_product", "product", "product_match"), "OtherProduct")
    rows = items.withColumn("_out", out)
    nth = F.row_number().over(Window.partitionBy("query_id", F.col("_out").isNull()).orderBy("place"))
    rows = rows.withColumn("state", F.coalesce("_out", F.when(nth <= limit, "Taken").otherwise("Beyond")))
    given = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.trim(F.coalesce(w, F.lit(""))) != "")
    told = F.exists(given, lambda w: F.contains(w, F.lit(VERSION_WORD)))
    more = differs("asked_version", "version", "version_match") & ~told
    return rows.withColumn("warnings", F.when(more, F.concat(given, F.array(F.lit(VERSION_WARNING)))).otherwise(given)).drop("_out")


def takeover_reasons(rows: DataFrame) -> DataFrame:
    """(query_id, taken, left_out, reason): how many items of each query of ``taken_over`` are taken, how many are left out, and why none is:
    BaselineNotReady or NoApplicableEvidence; null if some are."""
    taken = F.count_if(F.col("state") == "Taken")
    reason = F.when(F.max(F.col("state") == "NotReady"), "BaselineNotReady").when(taken == 0, "NoApplicableEvidence")
    return rows.groupBy("query_id").agg(taken.alias("taken"), F.count_if(F.col("state").isin("Incomplete", "OtherProduct")).alias("left_out"), reason.alias("reason"))
