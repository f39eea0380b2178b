"""Facts: grouping by value, resolution by priority, disagreements, unsupported claims and technical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of technical values and their patterns.
TECHNICAL = {
    "version": r"(?i)(?<![A-Za-z0-9])(v?\d+(?:\.\d+){1,4}(?:[-+][A-Za-z0-9._-]+)?)",
    "hotfix": r"(?i)\b((?:HF|EP)[-_ ]?\d+[A-Za-z0-9._-]*)\b",
    "error": r"(?i)\b(0x[0-9A-F]+|[A-Z]{1,8}[-_]\d{2,})\b",
    "url": r"(?i)(https?://[^\s<>\"']+)",
    "windows_path": r"\b([A-Za-z]:\\[^\r\n\t<>\"|?*]+)",
    "unix_path": r"(?<!\w)(/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+)",
    "quoted": r"`([^`\r\n]{2,120})`",
    "unit": r"(?i)(?<![A-Za-z0-9])(\d+(?:\.\d+)?\s*(?:MB|GB|KB|ms|秒|分|%|件|回))\b",
}
# The facts that official pages tell, the words of their titles, and the patterns of their values.
SAST, ENGINE_PACK, HOTFIX = "LatestSastVersion", "LatestEnginePackVersion", "LatestHotfixVersion"
RELEASE_WORDS, ENGINE_WORDS, HOTFIX_WORDS = r"(?i)release notes|release-notes", r"(?i)engine pack|engine-pack", r"(?i)hotfix"
RELEASE_VERSION = r"(?i)release[-\s]?notes(?:\s+for)?\s+(\d+\.\d+\.\d+)"
SAST_VERSION = r"(?i)\b(?:CxSAST|SAST)\s+(\d+\.\d+\.\d+)\b"
ENGINE_VERSION = r"(?i)engine\s*pack(?:\s+version)?\s+(\d+\.\d+\.\d+)"
HOTFIX_VERSION = r"(?i)\b(HF\d+)\b"
OTHER_PRODUCT, OWN_PRODUCT = r"(?i)\bSCA\b|checkmarx\s+sca|/sca(?:/|-|$)", r"(?i)CxSAST"
CONFIDENCE = {"High": 3, "Medium": 2}
# Types of questions that documents answer, not facts.
PROCEDURAL = ["HowToQuestion", "ConfigurationQuestion", "CommandQuestion", "FeatureAvailabilityQuestion", "GeneralSupportQuestion"]


def version_rank(value: Column) -> Column:
    """A number that orders versions: ``HFn`` by n, dotted ones by their parts in base 1000, other parts left out."""
    hotfix = F.regexp_extract(value, r"(?i)^HF\s*(\d+)$", 1)
    parts = F.filter(F.split(value, r"\."), lambda p: p.rlike(r"^\d+$"))
    return F.when(hotfix != "", hotfix.cast("long")).otherwise(F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 1000 + p.cast("long")))


def best_per_value(facts: DataFrame) -> DataFrame:
    """Of facts (key, value, confidence, ...) that state one value of a key, the most confident."""
    order = [F.desc("confidence"), *[c for c in facts.columns if c not in ("key", "value", "confidence")]]
    return facts.withColumn("_n", F.row_number().over(Window.partitionBy("key", "value").orderBy(*order))).filter("_n = 1").drop("_n")


def resolved(facts: DataFrame, several: str = "Conflict") -> DataFrame:
    """(key, value, confidence, status, sources): the most confident value of each key, ties to the higher version, then
    to the smaller text; Confirmed if it is the only one, else
    ``several`` (Candidate for a catalog)."""
    values = facts.groupBy("key", "value").agg(F.max("confidence").alias("confidence"), F.count("*").alias("sources"))
    best = F.max(F.struct(F.col("confidence"), version_rank(F.col("value")).alias("rank"))).alias("b")
    tops = values.groupBy("key").agg(best, F.count("*").alias("n"))
    rows = values.join(tops, "key").filter((F.col("confidence") == F.col("b.confidence")) & version_rank(F.col("value")).eqNullSafe(F.col("b.rank")))
    return rows.groupBy("key").agg(
        F.min("value").alias("value"),
        F.first("confidence").alias("confidence"),
        F.when(F.first("n") == 1, "Confirmed").otherwise(several).alias("status"),
        F.min_by("sources", "value").alias("sources"),
    )


def by_priority(requested: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each requested key the value of the first layer (name, facts) that has one; null and Missing without."""
    every = None
    for i, (name, facts) in enumerate(layers):
        part = facts.groupBy("key").agg(F.min("value").alias("value")).select("key", "value", F.lit(name).alias("layer"), F.lit(i).alias("priority"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("key").agg(F.min_by(F.struct("value", "layer"), "priority").alias("f"))
    return requested.select("key").distinct().join(first, "key", "left").select("key", F.col("f.value").alias("value"), F.coalesce("f.layer", F.lit("Missing")).alias("layer"))


def disagreements(curated: DataFrame, found: DataFrame) -> DataFrame:
    """(key, curated_value, found_value): pairs of a key that differ, each once."""
    a = curated.select("key", F.col("value").alias("curated_value")).distinct()
    b = found.select("key", F.col("value").alias("found_value")).distinct()
    return a.join(b, "key").filter("curated_value <> found_value")


def _values(text: Column, pattern: str) -> Column:
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.regexp_replace(F.trim(v), "[.,、。]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def technical_set(text: Column) -> Column:
    """All technical values of a text, different without case."""
    every = F.concat(*(_values(F.coalesce(text, F.lit("")), p) for p in TECHNICAL.values()))
    return F.array_sort(F.array_distinct(F.transform(every, F.lower)))


def technical_diff(left: Column, right: Column) -> Column:
    """struct(removed, added): technical values of one text that the other lacks."""
    a, b = technical_set(left), technical_set(right)
    return F.struct(F.array_except(a, b).alias("removed"), F.array_except(b, a).alias("added"))


def technical_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value): the different technical values of each text, without the marks after them."""
    kinds = [F.struct(F.lit(kind).alias("kind"), _values(F.col(text), p).alias("vals")) for kind, p in TECHNICAL.items()]
    each = rows.select(key, F.explode(F.array(*kinds)).alias("k"))
    return each.select(key, F.col("k.kind").alias("kind"), F.explode("k.vals").alias("value"))


def unsupported(claims: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Claims (keys..., kind, value) that the evidence of the same keys does not hold."""
    return claims.join(evidence.select(*keys, "kind", "value").distinct(), [*keys, "kind", "value"], "left_anti")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Of facts (key, value, url, confidence, ...) that are equal in key, value and url without case, the most confident."""
    rest = [c for c in facts.columns if c != "confidence"]
    best = F.max_by(F.struct(*facts.columns), F.struct(confidence_rank(F.col("confidence")).alias("c"), F.hash(*rest).alias("h")))
    return facts.groupBy(*(F.lower(c).alias(f"_{c}") for c in ("key", "value", "url"))).agg(best.alias("_b")).select("_b.*")


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(1)
    for name, rank in CONFIDENCE.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def page_facts(pages: DataFrame) -> DataFrame:
    """(key, value, url, title, confidence) of official pages (title, section_title, url, text): versions that release
    notes and engine pack pages name, and the highest hotfix of hotfix pages; none of another product's pages."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat_ws(" ", blank("title"), blank("section_title"), blank("url"))
    body = F.concat_ws("\n", blank("title"), blank("section_title"), blank("url"), blank("text"))
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    engine, hotfix = head.rlike(ENGINE_WORDS), head.rlike(HOTFIX_WORDS)
    notes = head.rlike(RELEASE_WORDS) & ~engine & ~hotfix
    numbers = F.transform(every(body, HOTFIX_VERSION), lambda v: F.substring(v, 3, 20).cast("long"))
    highest = F.array_max(F.filter(numbers, lambda n: n.isNotNull()))
    none = F.array().cast("array<string>")
    fact = lambda key, values: F.transform(values, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))
    found = F.concat(
        fact(SAST, F.when(notes, F.concat(every(head, RELEASE_VERSION), every(body, SAST_VERSION))).otherwise(none)),
        fact(ENGINE_PACK, F.when(engine, every(body, ENGINE_VERSION)).otherwise(none)),
        fact(HOTFIX, F.when(hotfix & highest.isNotNull(), F.array(F.concat(F.lit("HF"), highest.cast("string")))).otherwise(none)),
    )
    own = pages.filter(~(head.rlike(OTHER_PRODUCT) & ~head.rlike(OWN_PRODUCT)))
    title = F.when(F.trim(blank("section_title")) == "", F.col("title")).otherwise(F.concat_ws(" - ", "title", "section_title"))
    each = own.select(F.explode(F.array_distinct(found)).alias("f"), "url", title.alias("title"), F.lit("High").alias("confidence"))
    return distinct_facts(each.select("f.key", "f.value", "url", "title", "confidence"))


def answer_readiness(rows: DataFrame) -> DataFrame:
    """Adds readiness to questions with types, requested (fact keys), facts (array of struct(key, status, confidence)),
    missing and conflicts (arrays): AutoAnswerable only if all latest versions asked for are confirmed with high
    confidence; NeedsConfirmation for conflicts, upgrades, procedures and what is partly confirmed; else
    InsufficientEvidence."""
    has = lambda t: F.array_contains("types", t)
    latest = F.filter("requested", lambda k: k.isin(SAST, ENGINE_PACK, HOTFIX))
    sure = F.transform(F.filter("facts", lambda f: (f["status"] == "Confirmed") & (f["confidence"] == "High")), lambda f: f["key"])
    every = (F.size(latest) > 0) & (F.size(F.array_except(latest, sure)) == 0)
    procedural = (F.size("requested") == 0) & F.arrays_overlap("types", F.array(*map(F.lit, PROCEDURAL)))
    confirmed = F.exists("facts", lambda f: f["status"] == "Confirmed")
    readiness = (
        F.when(F.size("conflicts") > 0, "NeedsConfirmation")
        .when(has("UpgradePossibilityQuestion") & F.array_contains("missing", "UpgradePossibility"), "NeedsConfirmation")
        .when(has("LatestVersionQuestion"), F.when(every, "AutoAnswerable").otherwise("InsufficientEvidence"))
        .when(procedural | confirmed, "NeedsConfirmation")
        .otherwise("InsufficientEvidence")
    )
    return rows.withColumn("readiness", readiness)
