"""Replies, prompts and requests: cleaning, cutting, reading of answers, the application's types of questions, and the
readiness of a new selector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import coverage, facts

# What a reply to a customer must not hold, with what stands for it and the warnings; the end of a prompt
# that is cut; and texts of cells that are not translated.
WINDOWS_PATH = r"[A-Za-z]:\\[^\r\n\t :;\"'<>|]+"
EVIDENCE_ID = r"(?i)\b(?:evidence|source)[-_ ]?id\s*[:：=]\s*[A-Za-z0-9_-]+|\bE\d{1,3}\b"
MEMO_LINE = r"(?m)^\s*(?:社内メモ|内部メモ)\s*[:：].*$"
REMOVED_PATH, REMOVED_ID = "[内部パス削除]", "[根拠ID削除]"
CUT = "\n...[MaxPromptCharsにより省略]"
JAPANESE = "[\\u3040-\\u309f\\u30a0-\\u30ff\\u4e00-\\u9fff]"
NOT_PROSE = r"(?i)https?://|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|[A-Z]:\\"
# Words of the application's eleven types of questions, looked for without white space.
LATEST = ["最新", "currentversion", "latestversion", "latest"]
SAST, ENGINE, HOTFIX = ["sast", "cxsast"], ["enginepack", "ep", "エンジンパック"], ["hotfix", "hf", "ホットフィックス"]
VERSION_WORDS = ["バージョン", "version"]
UPGRADE = ["アップグレード", "アップデート", "upgrade", "update", "移行", "上げ", "更新可能", "可能ですか"]
OTHER_TYPES = {
    "HowToQuestion": ["手順", "方法", "howto", "設定", "一連", "完了まで", "使い方"],
    "FeatureAvailabilityQuestion": ["対応していますか", "対応可否", "利用可能", "使用できますか", "機能はありますか", "featureavailability", "issupported", "supported"],
    "TroubleshootingQuestion": ["エラー", "失敗", "動かない", "原因", "解消", "トラブル", "exception", "timeout"],
    "CommandQuestion": ["コマンド", "command", "qacli", "cli"],
    "ConfigurationQuestion": ["設定", "configuration", "configure", "config"],
    "VersionQuestion": VERSION_WORDS,
    "PermissionQuestion": ["権限", "permission", "accessdenied", "unauthorized", "forbidden"],
    "ErrorMessageQuestion": ["エラーメッセージ", "エラーコード", "errormessage", "errorcode"],
}
NOT_WITH_LATEST = ["HowToQuestion", "FeatureAvailabilityQuestion", "VersionQuestion"]
INSTALLED = r"(?i)(?:現在|現行|使用中|利用中|current)[^0-9]{0,20}v?(\d+(?:\.\d+){1,3})"
# Least runs (and their bounds) and greatest share of fallbacks for a selector to be taken over.
LEAST_RUNS, RUN_BOUNDS, MOST_FALLBACKS = 50, (10, 10_000), 0.01


def clean_reply(text: Column) -> Column:
    """A reply without memo lines, internal paths and evidence ids."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), MEMO_LINE, "")
    out = F.regexp_replace(F.regexp_replace(out, WINDOWS_PATH, REMOVED_PATH), EVIDENCE_ID, REMOVED_ID)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def reply_warnings(text: Column) -> Column:
    """What ``clean_reply`` would remove."""
    text = F.coalesce(text, F.lit(""))
    return coverage.listed([("InternalPath", text.rlike(WINDOWS_PATH)), ("EvidenceId", text.rlike(EVIDENCE_ID)), ("InternalMemo", text.rlike(MEMO_LINE))])


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters of a text; where it is cut it says so, if there is room."""
    if most <= 0:
        return F.lit("")
    cut = F.substring(text, 1, most) if most <= len(CUT) else F.concat(F.substring(text, 1, most - len(CUT)), F.lit(CUT))
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def translatable(value: Column, is_formula: Column) -> Column:
    """struct(translate, reason) of a cell: formulas, blank ones, those without Japanese, addresses and paths are left."""
    reason = (
        F.when(is_formula, "formula")
        .when(F.trim(F.coalesce(value, F.lit(""))) == "", "blank")
        .when(~value.rlike(JAPANESE), "not Japanese")
        .when(value.rlike(NOT_PROSE), "address")
        .otherwise("")
    )
    return F.struct((reason == "").alias("translate"), reason.alias("reason"))


def answer_fields(text: Column) -> Column:
    """struct(status, answer, confidence, evidence) of a model's reply: what it thinks aloud and code fences go, then the
    first object is read; wrong types and missing fields are null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    found = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    get = lambda path, kind: F.try_variant_get(found, f"$.{path}", kind).alias(path)
    return F.struct(get("status", "string"), get("answer", "string"), get("confidence", "double"), get("evidence", "array<string>"))


def classified(text: Column) -> Column:
    """struct(types, requested) of a question by the application's rules: its types and the facts it asks for. A question
    for the latest version is none about features, versions or how to do something."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    has = lambda words: coverage.has_any(flat, words)
    latest = has(LATEST) & (has(SAST) | has(ENGINE) | has(HOTFIX) | has(VERSION_WORDS))
    upgrade = has(UPGRADE)
    flags = [("LatestVersionQuestion", latest), ("UpgradePossibilityQuestion", upgrade)]
    for name, words in OTHER_TYPES.items():
        test = has(words) | (F.coalesce(text, F.lit("")).rlike(coverage.OPTION) if name == "CommandQuestion" else F.lit(False))
        flags.append((name, test & ~latest if name in NOT_WITH_LATEST else test))
    types = coverage.listed(flags)
    types = F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("GeneralSupportQuestion")))
    asked = [
        (facts.SAST, latest), (facts.ENGINE_PACK, latest & has(ENGINE)), (facts.HOTFIX, latest & has(HOTFIX)), ("UpgradePossibility", upgrade),
        ("CurrentInstalledVersion", upgrade & F.coalesce(text, F.lit("")).rlike(INSTALLED)),
    ]
    return F.struct(types.alias("types"), coverage.listed(asked).alias("requested"))


def selector_readiness(runs: DataFrame, keys: list[str], least: int = LEAST_RUNS, fallbacks: float = MOST_FALLBACKS) -> DataFrame:
    """(keys..., runs, readiness) of production runs (matched, fallback, failed): NotEnoughData, Blocked by a failure,
    NeedsInvestigation by a mismatch or too many fallbacks, else Ready."""
    n = F.count("*")
    readiness = (
        F.when(n < min(RUN_BOUNDS[1], max(RUN_BOUNDS[0], least)), "NotEnoughData")
        .when(F.max("failed"), "Blocked")
        .when(~F.min("matched") | (F.count_if("fallback") / n > fallbacks), "NeedsInvestigation")
        .otherwise("Ready")
    )
    return runs.groupBy(*keys).agg(n.alias("runs"), readiness.alias("readiness"))


def product_folder(product: Column, most: int = 80) -> Column:
    """A product's name as the name of its index folder; where that changes the name, 8 digits of its hash follow."""
    raw = F.when(F.trim(F.coalesce(product, F.lit(""))) == "", "Default").otherwise(F.trim(product))
    safe = F.regexp_replace(F.regexp_replace(raw, r"[<>:\"/\\|?*\p{Cntrl}]", "_"), r"^[ .]+|[ .]+$", "")
    safe = F.when(safe == "", "Product").otherwise(safe)
    short = F.regexp_replace(F.substring(safe, 1, most), r"^[ .]+|[ .]+$", "")
    marked = F.regexp_replace(raw, r"[<>:\"/\\|?*\p{Cntrl}]", "_") != raw
    changed = marked | (safe == "Product") & (raw != "Product") | (F.char_length(safe) > most)
    return F.when(changed, F.concat(short, F.lit("_"), F.substring(F.sha2(raw, 256), 1, 8))).otherwise(short)


def unknown_last(value: Column, unknown: str) -> list[Column]:
    """The order of texts with the unknown one at the end."""
    return [F.when(value == unknown, 1).otherwise(0), value]


def notes_of_cases(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, note): the notes that lie in a case's folder or in a folder of it."""
    parent = F.regexp_replace("note", r"/[^/]*$", "")
    each = notes.select("note", F.explode(F.array_distinct(F.array(parent, F.regexp_replace(parent, r"/[^/]*$", "")))).alias("path"))
    return folders.select("path").distinct().join(each, "path")


def topic_adjustment(rows: DataFrame) -> Column:
    """What topics add to or take from a search score: rows have asked_features, matched_features, feature_conflict,
    excluded_match, fresh, troubleshooting and source_type."""
    kind = F.lower("source_type")
    feature = F.when(F.col("asked_features") == 0, 0.0).when(F.col("matched_features") > 0, 0.28).when(F.col("feature_conflict"), -0.55).otherwise(-0.24)
    fresh = F.when(~F.col("fresh"), 0.0).when(kind == "officialdoc", 0.12).when(kind == "manual", 0.03).when(kind.isin("pastcasenote", "pastanswer", "exactpastanswer"), -0.08).otherwise(0.0)
    exact = F.when(F.col("troubleshooting") & (kind == "exactpastanswer"), 0.12).otherwise(0.0)
    return feature + F.when(F.col("excluded_match"), -0.55).otherwise(0.0) + fresh + exact
