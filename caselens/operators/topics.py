"""Topics and entities of texts, their comparison, and the rank score that rests on them.

A catalog of aliases is a table (``profiled``), looked for in one pass whatever its size; a small stated one, a mapping of
a dimension (products, components, features, objects) to names and their aliases, may be given as tests of a column
(``profile``). Texts are folded by NFKC and case first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold

from . import aliases
from .selection import clamp

Catalog = dict[str, dict[str, list[str]]]

# Words of operations and intents, systems and servers, patterns of entities, and weights of the score.
OPERATIONS = {
    "Configuration": ["設定", "構成", "configure", "configuration", "setup", "set up"],
    "Creation": ["作成", "生成", "create", "creation", "generate"],
    "Upload": ["アップロード", "upload"],
    "Verification": ["確認", "検証", "verify", "verification", "check"],
    "Association": ["関連付け", "紐付け", "associate", "association", "link"],
    "Execution": ["実行", "起動", "run", "execute", "launch"],
    "Troubleshooting": ["原因", "対処", "解決", "troubleshoot", "failure", "failed"],
}
INTENTS = {
    "Overview": ["概要", "何ですか", "とは", "what is", "overview"],
    "Purpose": ["用途", "目的", "何に使", "purpose", "use case"],
    "HowTo": ["方法", "手順", "やり方", "how to", "procedure"],
    "Command": ["コマンド", "command", "cli", "qacli"],
    "Configuration": ["設定", "構成", "configuration", "configure", "setup"],
    "Verification": ["確認", "検証", "verify", "verification"],
    "Troubleshooting": ["原因", "対処", "解決", "troubleshoot", "error", "failed"],
}
SYSTEMS = {
    "Windows": ["windows"],
    "Linux": ["linux"],
    "macOS": ["macos", "mac os"],
    "RHEL": ["rhel", "red hat enterprise linux"],
    "Ubuntu": ["ubuntu"],
    "License Server": ["license server", "ライセンスサーバー", "ライセンスサーバ"],
    "Application Server": ["application server", "アプリケーションサーバー", "アプリケーションサーバ"],
    "Web Server": ["web server", "webサーバー", "webサーバ"],
    "Database Server": ["database server", "db server", "データベースサーバー", "データベースサーバ"],
}
ENTITIES = {
    "command": r"(?i)(?<![A-Za-z0-9_])(qacli(?:\s+[A-Za-z0-9_.+/-]+){1,3})",
    "option": r"(?<![A-Za-z0-9_])(--[A-Za-z0-9][A-Za-z0-9_-]*)",
    "api": r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_.]*(?:\s+)?(?:API|Api))(?![A-Za-z0-9_])",
    "setting": r"(?<![A-Za-z0-9_])((?:[A-Z][A-Z0-9]*_[A-Z0-9_]+(?:\s*=\s*[^\s,;]+)?|[A-Z][A-Z0-9_]{2,}\s*=\s*[^\s,;]+))",
    "error": r"(?<![A-Za-z0-9_])([A-Z]{2,10}[-_]\d{2,8})(?![A-Za-z0-9_])",
    "file": r"(?i)(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]+\.(?:json|xml|yaml|yml|ini|conf|cfg|log|txt|csv|pdf|zip))(?![A-Za-z0-9_.-])",
    "version": r"(?i)(?<![A-Za-z0-9_.])(v?\d+(?:\.\d+){1,3})(?![A-Za-z0-9_.])",
}
SCORE = {"features": 0.24, "components": 0.16, "product": 0.11, "entities": 0.10, "operations": 0.10, "intents": 0.09, "technical": 0.08, "trust": 0.02, "version": 0.02, "base": 0.08, "lexical": 0.05, "semantic": 0.03}
PENALTY = {"product": 0.65, "features": 0.55, "components": 0.30, "no_topic": 0.20, "version": 0.18, "excluded": 0.90}
DIMENSIONS = ["products", "components", "features", "objects"]
ACTIONS = {"operations": OPERATIONS, "intents": INTENTS}
PROFILE = (*DIMENSIONS, *ACTIONS, "entities")


def mentions(folded: Column, alias: str) -> Column:
    """Whether a folded text has the alias; an ASCII one must stand between other characters than letters and digits."""
    alias = " ".join(alias.casefold().split())
    if alias.isascii() and alias[:1].isalnum() and alias[-1:].isalnum():
        # most texts have most aliases nowhere, which is told much faster than between which characters they stand
        return F.contains(folded, F.lit(alias)) & folded.rlike(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])")
    return F.contains(folded, F.lit(alias)) if alias else F.lit(False)


def named(folded: Column, names: dict[str, list[str]], itself: bool = True) -> Column:
    """The names of which the text has one of the words, or the name ``itself``."""
    found = []
    for name, words in names.items():
        hit = F.lit(False)
        for w in ([name] if itself else []) + words:
            hit = hit | mentions(folded, w)
        found.append(F.when(hit, F.lit(name)))
    if not found:
        return F.array().cast("array<string>")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def entities(text: Column, folded: Column) -> Column:
    """Different ``kind:value`` of a text, values folded."""

    def of(kind: str):
        return lambda v: F.concat(F.lit(f"{kind}:"), F.regexp_replace(F.lower(v), r"\s+", " "))

    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), of(kind)) for kind, pattern in ENTITIES.items()]
    parts.append(F.transform(named(folded, SYSTEMS, itself=False), lambda v: F.concat(F.lit("system:"), F.lower(v))))
    return F.array_distinct(F.concat(*parts))


def profile(text: Column, catalog: Catalog, folded: Column | None = None, wanted: tuple[str, ...] = PROFILE) -> Column:
    """The struct of a text's products, components, features, objects, operations, intents and entities, or of those ``wanted``. Within
    arrays, where a text cannot be folded, its ``folded`` form is given."""
    folded = F.regexp_replace(fold(F.coalesce(text, F.lit(""))) if folded is None else folded, r"\s+", " ")

    def of(form: Column) -> Column:
        parts = [*((d, named(form, catalog.get(d, {}))) for d in DIMENSIONS if d in wanted), *((a, named(form, names, False)) for a, names in ACTIONS.items() if a in wanted)]
        last = [("entities", entities(F.coalesce(text, F.lit("")), form))] if "entities" in wanted else []
        return F.struct(*(c.alias(n) for n, c in [*parts, *last]))

    return F.transform(F.array(folded), of)[0]  # a lambda's variable: the text is folded once and not for each alias


def _actions(folded: Column) -> list[Column]:
    return [named(folded, names, False).alias(a) for a, names in ACTIONS.items()]


def profiled(rows: DataFrame, key: str, text: str, catalog: DataFrame, out: str = "profile") -> DataFrame:
    """``rows``, whose ``key`` names each once, with the struct of ``profile`` by a catalog that is a table (dimension, name,
    alias), names sorted."""
    found = aliases.profiled(rows, key, text, catalog, DIMENSIONS).withColumn("_folded", aliases.comparable(F.col(text)))
    struct = F.struct(*DIMENSIONS, *_actions(F.col("_folded")), entities(F.coalesce(F.col(text), F.lit("")), F.col("_folded")).alias("entities"))
    return found.withColumn(out, struct).drop("_folded", *[d for d in DIMENSIONS if d not in rows.columns])


def conflicts(query: Column, evidence: Column) -> Column:
    """The dimensions in which both have values but none in common."""
    found = []
    for d, name in (("products", "Product"), ("components", "Component"), ("features", "Feature")):
        both = (F.size(query[d]) > 0) & (F.size(evidence[d]) > 0) & ~F.arrays_overlap(query[d], evidence[d])
        found.append(F.when(both, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def topic_match(query: Column, evidence: Column) -> Column:
    """Whether a feature agrees, or without asked features a component, or without both a product."""
    shared = lambda d: F.arrays_overlap(query[d], evidence[d])
    none = lambda d: F.size(query[d]) == 0
    return shared("features") | (none("features") & shared("components")) | (none("features") & none("components") & shared("products"))


def weighted(*parts: tuple[float, Column, Column]) -> Column:
    """The mean of clamped scores over the parts that apply, by weight; 0 if none does."""
    total = sum((w * F.when(applies, clamp(score)).otherwise(0.0) for w, score, applies in parts), F.lit(0.0))
    weight = sum((F.when(applies, w).otherwise(0.0) for w, _, applies in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def ranked(rows: DataFrame, shares: bool = False) -> DataFrame:
    """Adds conflict_kinds, has_topic_match, topic_score, entity_score, penalty and final_score to candidates with the columns
    query_profile, profile, product_match (may be null), technical_score, version_match, source_trust, base_score and
    excluded. Topics count if any agrees, or with ``shares`` by the share of the asked ones; where there is a lexical_score or
    semantic_score, these stand for the base score."""
    q, e = F.col("query_profile"), F.col("profile")
    asked = lambda d: F.size(q[d]) > 0
    share = lambda d: F.when(asked(d), F.size(F.array_intersect(q[d], e[d])) / F.size(q[d])).otherwise(0.0)
    hit = share if shares else lambda d: F.when(F.arrays_overlap(q[d], e[d]), 1.0).otherwise(0.0)
    version = F.when(F.col("version_match") == "exact", 1.0).when(F.col("version_match") == "near", 0.5).otherwise(0.0)
    wants_version = F.col("version_match") != "not_requested"
    product = F.when(F.col("product_match"), 1.0).otherwise(0.0)
    named_product = F.col("product_match").isNotNull()
    topic = [(SCORE["features"], hit("features"), asked("features")), (SCORE["components"], hit("components"), asked("components")), (SCORE["product"], product, named_product)]
    always = F.lit(True)
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    lexical, semantic = given("lexical_score"), given("semantic_score")
    neither = lexical.isNull() & semantic.isNull()
    score = weighted(
        *topic,
        (SCORE["entities"], share("entities"), asked("entities")),
        (SCORE["operations"], hit("operations"), asked("operations")),
        (SCORE["intents"], hit("intents"), asked("intents")),
        (SCORE["technical"], F.col("technical_score"), F.col("technical_score").isNotNull()),
        (SCORE["trust"], F.col("source_trust"), always),
        (SCORE["version"], version, wants_version),
        (SCORE["base"], F.col("base_score"), neither),
        (SCORE["lexical"], lexical, lexical.isNotNull()),
        (SCORE["semantic"], semantic, semantic.isNotNull()),
    )
    rows = rows.withColumn("conflict_kinds", conflicts(q, e)).withColumn("has_topic_match", F.coalesce(topic_match(q, e), F.lit(False)))
    kinds = F.col("conflict_kinds")
    no_topic = (asked("features") | asked("components")) & ~F.col("has_topic_match")
    penalty = F.when(~F.col("product_match"), PENALTY["product"]).otherwise(0.0)
    penalty = penalty + F.when(F.array_contains(kinds, "Feature"), PENALTY["features"]).when(F.array_contains(kinds, "Component"), PENALTY["components"]).when(no_topic, PENALTY["no_topic"]).otherwise(0.0)
    penalty = penalty + F.when(F.col("version_match") == "mismatch", PENALTY["version"]).otherwise(0.0)
    shunned = F.when(F.col("excluded"), PENALTY["excluded"]).otherwise(0.0)
    scored = rows.withColumn("topic_score", F.round(weighted(*topic, (SCORE["operations"], hit("operations"), asked("operations"))), 6))
    return scored.withColumns({"entity_score": share("entities"), "penalty": penalty, "final_score": F.round(clamp(score - penalty - shunned), 6)})
