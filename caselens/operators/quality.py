"""Deterministic quality of answers against their evidence: claims, grounding, readiness and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold, fold_all
from caselens.scratch import written

from . import coverage, topics
from .selection import clamp

# Kinds of claims with their patterns and whether they are major, and markers in answers.
CLAIMS = [
    ("Command", r"(?i)\b(qacli(?:\s+[a-z][a-z0-9_.-]*){1,4})", True),
    ("Option", r"(?<![A-Za-z0-9_])(--[A-Za-z][A-Za-z0-9_-]*)", True),
    ("Api", r"\b([A-Z][A-Za-z0-9_.-]*\s+API)\b", True),
    ("Setting", r"\b([A-Z][A-Z0-9_]{2,}\s*=\s*[A-Za-z0-9_.-]+)\b", True),
    ("Path", r"\b([A-Za-z]:\\[^\s\"'<>|]+)", True),
    ("Path", r"(?<![A-Za-z0-9_.-])(/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)", True),
    ("File", r"(?i)(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]+\.(?:json|xml|ya?ml|conf|cfg|ini|txt|log|pdf|qac|cct))(?=$|[^A-Za-z0-9_.-])", False),
    ("ErrorCode", r"\b([A-Z]{2,10}-\d{2,8})\b", True),
    ("Version", r"(?i)((?:version|ver\.?|v|バージョン)\s*[:：]?\s*\d+(?:\.\d+){1,3})", True),
    ("Port", r"(?i)((?:port|ポート)\s*[:：]?\s*\d{2,5})", True),
]
SAFE = ["api", "cli", "gui", "http", "https", "os"]
INTERNAL = [
    "[RAG Evidence]", "Evidence score", "Selection reason", "fallback", "TopK", "InsufficientEvidence", "CompletedWithFallback",
    "Phase 14", "Phase 15", "Phase 16", "Phase 17", "RAG内部", "内部スコア",
]
INSUFFICIENT = ["根拠不足", "情報不足", "確認できません", "判断できません", "断定できません", "insufficient evidence"]
LIMITS = {"directness": 0.65, "grounding": 0.80, "topic_alignment": 0.75, "coverage": 0.80, "technical_fidelity": 1.0, "actionability": 0.65, "customer_readiness": 0.65}
LOW_GROUNDING, LOW_COVERAGE = 0.30, 0.34
HARD_REASONS = ["NoRelevantEvidence", "ProductMismatch", "VersionMismatch", "TopicConflict", "ConflictingEvidence"]
#: What is cut from the front of a claim before it is compared.
PREFIXES = {"Command": r"^qacli\s+", "Version": r"^(?:version|ver\.?|v|バージョン)\s*[:：]?\s*", "Port": r"^(?:port|ポート)\s*[:：]?\s*"}
EDGES = r"^[ .,():;\[\]{}「」［］]+|[ .,():;\[\]{}「」［］]+$"
STEP = r"(?m)^\s*(?:\d+[.)、]|[-*・])"
# The catalog of a support product, what its questions need, and the words by which an answer covers it.
CATALOG: topics.Catalog = {
    "products": {"Validate": ["Perforce Validate"]},
    "components": {"Validate": ["Perforce Validate"]},
    "features": {
        "Stream": ["ストリーム"], "License": ["ライセンス"], "IDE Plugin": ["IDEプラグイン", "Eclipse Plugin"],
        "Build upload": ["validate build", "build upload", "解析結果をアップロード"],
    },
    "objects": {"Analysis result": ["解析結果"]},
}
UPLOAD_NEEDS = ["Command", "Option", "Authentication", "Association", "Execution", "Verification"]
COVERED = {
    "Overview": ["概要", "とは", "overview", "definition"],
    "Setup": ["設定", "作成", "手順", "setup", "configure", "create"],
    "Authentication": ["認証", "ログイン", "token", "credential", "authentication"],
    "Association": ["接続", "関連付け", "紐付け", "project", "associate", "connection"],
    "Execution": ["実行", "アップロード", "run", "execute", "upload"],
    "Verification": ["確認", "検証", "表示", "verify", "confirm", "portal"],
}
DOES = ["実行", "操作", "run", "execute"]


def catalog_of(product: str | None) -> topics.Catalog:
    """The support catalog with a product of its own."""
    own = {product: []} if product else {}
    return CATALOG | {"products": own | CATALOG["products"]}


def _claim_of(kind: str, major: bool):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(major).alias("major"))


def claims(text: Column, catalog: topics.Catalog | None = None, folded: Column | None = None, kind_of: str | None = None) -> Column:
    """Different (kind, value, major) claims of a text, values folded and without the words before them; products and
    features of the catalog and names of systems count as minor claims. Within arrays its ``folded`` form is given. With ``kind_of``
    only those of one kind of ``CLAIMS``."""
    text = F.coalesce(text, F.lit(""))
    folded = F.regexp_replace(fold(text) if folded is None else folded, r"\s+", " ")

    def clean(kind: str):
        def of(v: Column) -> Column:
            out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(v)), r"\s+", " "), EDGES, "")
            return F.trim(F.regexp_replace(out, PREFIXES[kind], "")) if kind in PREFIXES else out

        return of

    parts = [F.transform(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), clean(kind)), _claim_of(kind, major)) for kind, pattern, major in CLAIMS if kind_of in (None, kind)]
    for d in ("products", "features") if kind_of is None else ():
        parts.append(F.transform(F.transform(topics.named(folded, (catalog or {}).get(d, {})), F.lower), _claim_of("ProductFeature", False)))
    if kind_of is None:
        parts.append(F.transform(F.transform(topics.named(folded, topics.SYSTEMS, itself=False), F.lower), _claim_of("System", False)))
    found = F.filter(F.concat(*parts), lambda c: (c["value"] != "") & ~c["value"].isin(SAFE))
    return F.array_distinct(found)


def hits(text: Column, words: list[str]) -> Column:
    folded = F.lower(text)
    return sum((F.when(F.contains(folded, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0))


def customer_readiness(answer: Column, leaks: Column) -> Column:
    size = F.char_length(F.trim(answer))
    score = F.when(answer.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]"), 0.35).otherwise(0.0)
    score = score + F.when(answer.rlike(r"。|(?:です|ます|ください|いたします)\s"), 0.25).otherwise(0.0)
    score = score + F.when(size >= 60, 0.25).when(size >= 30, 0.15).otherwise(0.0) + F.when(leaks == 0, 0.15).otherwise(0.0)
    return F.when(size > 0, clamp(score)).otherwise(0.0)


def needs_of(profile: Column) -> Column:
    """What a question of this profile needs an answer to cover."""
    asks = lambda names: F.arrays_overlap(profile["intents"], F.array(*map(F.lit, names)))
    items = lambda names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    stream = F.concat(F.when(asks(["Overview"]), items(["Overview"])).otherwise(none), F.when(asks(["HowTo", "Configuration"]), items(["Setup", "Association", "Verification"])).otherwise(none))
    upload = F.array_contains(profile["operations"], "Upload") | F.array_contains(profile["features"], "Build upload")
    return F.when(upload, items(UPLOAD_NEEDS)).when(F.array_contains(profile["features"], "Stream"), stream).when(asks(["HowTo", "Configuration", "Command"]), items(["Execution"])).otherwise(none)


def covered_by(folded: Column, found: Column) -> Column:
    """What a folded answer with these claims covers."""
    kinds = F.transform(found, lambda c: c["kind"])
    flags = [(k, F.array_contains(kinds, k)) for k in ("Command", "Option")]
    return coverage.listed(flags + [(k, coverage.has_any(folded, w)) for k, w in COVERED.items()])


#: What ``supported`` adds, and what of a profile is compared with another.
SUPPORT = ["_reasons", "_q", "_known", "_versions", "_off", "_needs"]
COMPARED = ("products", "components", "features")


def _pair(c: Column) -> Column:
    return F.concat_ws("\x1f", c["kind"], c["value"])


def supported(rows: DataFrame, product: str | None = None, separated: bool = False) -> DataFrame:
    """``rows`` (question, evidence, insufficient_reasons) with ``SUPPORT``: what ``evaluated`` needs of the question and the evidence, which
    is the same for all answers to them."""
    catalog, own = catalog_of(product), rows.columns
    evidence = F.coalesce("evidence", F.array().cast("array<string>"))
    reasons = F.coalesce("insufficient_reasons", F.array().cast("array<string>"))
    folds = {"_evidence": evidence, "_reasons": reasons, "_fq": fold(F.coalesce("question", F.lit(""))), "_fe": fold_all(evidence)}
    rows = written(rows.withColumns(folds), "questions")  # each step is written, as its arrays are read many times by the next
    evidence, q = F.col("_evidence"), F.col("_q")
    rows = rows.withColumn("_q", topics.profile(F.col("question"), catalog, F.col("_fq"), (*COMPARED, *topics.ACTIONS)))
    each = F.arrays_zip(evidence.alias("t"), F.col("_fe").alias("f"))
    support = F.array_join(F.concat(F.array(F.coalesce("question", F.lit(""))), evidence), "\n")
    rows = rows.withColumns(
        {
            "_known": F.transform(claims(support, catalog, F.concat_ws("\n", "_fq", F.array_join("_fe", "\n"))), _pair),
            "_versions": F.array_distinct(F.flatten(F.transform(each, lambda x: F.transform(claims(x["t"], None, x["f"], "Version"), lambda c: c["value"])))),
            "_off": F.size(F.filter(each, lambda x: F.size(topics.conflicts(q, topics.profile(x["t"], catalog, x["f"], COMPARED))) > 0)),
            "_needs": coverage.required(F.col("question"), q) if separated else needs_of(q),
        }
    )
    return written(rows.select(*own, *SUPPORT), "supported")


def evaluated(rows: DataFrame, product: str | None = None, separated: bool = False) -> DataFrame:
    """Adds the scores and the decision to answers with the columns question, answer, evidence (array of texts) and
    insufficient_reasons (array): topic_alignment, grounding, technical_fidelity, coverage, directness, actionability,
    customer_readiness, unsupported (kind, value, major), unsupported_claims, conflicts, leaks, blocking, warnings,
    decision. ``separated``: evidence and answer must each cover what the question requires. Rows that ``supported`` (by the same
    arguments) gave are not looked at for that again."""
    catalog = catalog_of(product)
    own = [c for c in rows.columns if c not in SUPPORT]
    rows = rows if set(SUPPORT) <= set(rows.columns) else supported(rows, product, separated)
    answer, evidence, q, a, pair = F.coalesce("answer", F.lit("")), F.coalesce("evidence", F.array().cast("array<string>")), F.col("_q"), F.col("_a"), _pair
    rows = written(rows.withColumn("_fa", fold(answer)), "answers")
    rows = rows.withColumn("_a", topics.profile(answer, catalog, F.col("_fa"), COMPARED))
    rows = rows.withColumns(
        {
            "_claims": claims(answer, catalog, F.col("_fa")),
            "_conflict": F.size(topics.conflicts(q, a)) > 0,
            "_match": F.coalesce(topics.topic_match(q, a), F.lit(False)),
            "leaks": hits(answer, INTERNAL),
        }
    )
    rows = written(rows, "profiled-answers")
    rows = rows.withColumn("unsupported", F.filter("_claims", lambda c: ~F.array_contains("_known", pair(c))))
    rows = rows.withColumn("_got", coverage.observed(answer) if separated else covered_by(F.col("_fa"), F.col("_claims")))
    lacking = F.array_except("_needs", coverage.observed_in_all(evidence)) if separated else F.array().cast("array<string>")
    rows = rows.withColumns({"missing_evidence": lacking, "missing_answer": F.array_except("_needs", "_got"), "conflicts": F.col("_off") + F.when(F.size("_versions") > 1, 1).otherwise(0)})
    n, lost, needs = F.size("_claims"), F.size("unsupported"), F.size("_needs")
    specific = (F.size(q["features"]) > 0) | (F.size(q["components"]) > 0)
    alignment = (
        F.when(F.col("_conflict"), 0.0)
        .when(specific, F.when(F.col("_match"), 1.0).otherwise(0.25))
        .when(F.size(q["products"]) > 0, F.when(F.arrays_overlap(q["products"], a["products"]), 1.0).otherwise(0.5))
        .otherwise(1.0)
    )
    rows = rows.withColumns({"topic_alignment": alignment, "coverage": F.when(needs > 0, (needs - F.size("missing_answer")) / needs).otherwise(1.0)})
    share = F.when(n > 0, 1 - lost / n)
    grounding = F.when(F.size(evidence) == 0, 0.0).otherwise(F.coalesce(share, F.when(F.col("topic_alignment") >= 0.75, 1.0).when(F.col("topic_alignment") >= 0.5, 0.6).otherwise(0.3)))
    direct = 0.65 * F.col("topic_alignment") + 0.35 * F.col("coverage")
    short = F.char_length(F.trim(answer)) < 20
    directness = F.when(F.trim(answer) == "", 0.0).when(hits(answer, INSUFFICIENT) > 0, 0.25).otherwise(clamp(F.when(short, direct * 0.5).otherwise(direct)))
    got = lambda item: F.array_contains("_got", item)
    third = lambda *tests: sum((t.cast("int") for t in tests), F.lit(0)) / 3
    acts = F.arrays_overlap(q["intents"], F.array(*map(F.lit, ["HowTo", "Command", "Configuration"])))
    stream = third(got("Setup"), got("Association"), got("Verification"))
    steps = third(got("Command") | answer.rlike(STEP), got("Execution") | coverage.has_any(F.col("_fa"), DOES), got("Verification"))
    rows = rows.withColumns(
        {
            "topic_alignment": F.round("topic_alignment", 6),
            "coverage": F.round("coverage", 6),
            "grounding": F.round(grounding, 6),
            "technical_fidelity": F.round(F.coalesce(share, F.lit(1.0)), 6),
            "directness": F.round(directness, 6),
            "actionability": F.round(F.when(~acts, 1.0).when(F.array_contains(q["features"], "Stream"), stream).otherwise(steps), 6),
            "customer_readiness": F.round(customer_readiness(answer, F.col("leaks")), 6),
            "unsupported_claims": lost,
            "blocking": coverage.listed([("TopicConflict", F.col("_conflict")), ("MajorUnsupportedTechnicalClaim", F.exists("unsupported", lambda c: c["major"]))]),
        }
    )
    flags = [("InternalLeakage", F.col("leaks") > 0), ("EvidenceConflict", F.col("conflicts") > 0), ("UnsupportedTechnicalClaim", lost > 0)]
    if separated:
        flags += [("MissingEvidenceCoverage", F.size("missing_evidence") > 0), ("MissingAnswerCoverage", F.size("missing_answer") > 0)]
        weak = F.arrays_overlap("_reasons", F.array(*map(F.lit, HARD_REASONS))) | (F.size("missing_evidence") > 0)
        review = F.size("missing_answer") > 0
    else:
        weak, review = (F.size("_reasons") > 0) | (F.col("coverage") < LOW_COVERAGE), F.lit(False)
    weak = weak | (F.size(evidence) == 0) | (F.col("grounding") < LOW_GROUNDING)
    ready = F.lit(True)
    for name, least in LIMITS.items():
        ready = ready & (F.col(name) >= least)
    decision = (
        F.when(F.size("blocking") > 0, "Blocked")
        .when(weak, "InsufficientEvidence")
        .when(review | (F.col("conflicts") > 0) | (F.col("leaks") > 0) | ~ready, "NeedsReview")
        .otherwise("CustomerReady")
    )
    added = ["topic_alignment", "grounding", "technical_fidelity", "coverage", "directness", "actionability", "customer_readiness", "unsupported", "unsupported_claims", "conflicts", "leaks", "missing_evidence", "missing_answer", "blocking", "warnings", "decision"]
    rows = rows.withColumn("warnings", coverage.listed(flags)).withColumn("decision", decision)
    return rows.select(*(c for c in own if c not in added), *added)


def report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and rates to six places and counts of decisions per group of evaluated answers."""
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("coverage", "topic_alignment", "directness", "grounding", "technical_fidelity", "actionability", "customer_readiness")]
    decisions = ("CustomerReady", "NeedsReview", "InsufficientEvidence", "Blocked")
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in decisions]
    rates = [F.round(F.avg((F.col("decision") == d).cast("int")), 6).alias(f"{d}_rate") for d in decisions]
    return rows.groupBy(*keys).agg(F.count("*").alias("answers"), *means, *counts, *rates, F.sum("unsupported_claims").alias("unsupported_claims"), F.sum("conflicts").alias("conflicts"))
