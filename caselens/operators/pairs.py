"""Pairs of past questions and answers: normal forms of questions, matching, and dropping repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import bigram_dice, composed

from .incremental import first_per_content

# What goes from a question, in order, and lines that are greetings or signatures.
REMOVED = [
    r"(?i)\b[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}\b",
    r"(?i)(?:サポート番号|案件番号|case\s*id)\s*[:：#]?\s*[a-z0-9_-]+",
    r"\b20\d{2}(?:[./-]\d{1,2}[./-]\d{1,2}|年\d{1,2}月\d{1,2}日)(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?",
    r"[\p{L}\p{N}・()（）\s]{0,50}(?:株式会社|有限会社|合同会社)[\p{L}\p{N}・()（）\s]{0,40}(?:様|御中)",
    r"(?:ご担当者|担当者)\s*様",
]
GREETING_LINE = r"いつもお世話になって|お世話になっております|よろしくお願いいたします|よろしくお願い申し上げます|^(?:以上|以上です)$|^(?:tel|fax|〒)|^[-_= ]*$"
KEPT = r"[^\p{L}\p{Nd}\s.:_\-/\\+#&]"
NEAR, NEAR_BASE, NEAR_SLOPE, KEYWORD_LIMIT = 0.72, 0.70, 0.28, 0.84


def normal_question(text: Column, company: Column | None = None) -> Column:
    """A question in NFKC form and lower case without company, addresses, numbers, dates, salutations, greeting lines and
    odd marks, with single spaces."""

    def lower(value: Column) -> Column:
        return F.lower(composed(value))

    out = F.regexp_replace(lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    if company is not None:
        name = lower(F.coalesce(company, F.lit("")))
        out = F.when(F.trim(name) != "", F.replace(out, name, F.lit(" "))).otherwise(out)
    for pattern in REMOVED:
        out = F.regexp_replace(out, pattern, " ")
    lines = F.transform(F.split(out, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(GREETING_LINE))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), KEPT, " "), r"\s+", " "))


def question_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def matched(rows: DataFrame) -> DataFrame:
    """Adds match_order and score to pairs beside a query (query, normal_query, query_hash, question_text, normal_question,
    question_hash, keyword): equal texts, equal normal forms, equal hashes, alike by bigrams, or the keyword score."""
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    dice = bigram_dice(F.col("normal_question"), F.col("normal_query"))
    ladder = [
        (flat("question_text") == flat("query"), F.lit(1.0)),
        (F.col("normal_question") == F.col("normal_query"), F.lit(0.99)),
        (F.lower("question_hash") == F.lower("query_hash"), F.lit(0.985)),
        (F.col("_dice") >= NEAR, F.least(F.lit(0.98), NEAR_BASE + NEAR_SLOPE * F.col("_dice"))),
        (F.coalesce(F.col("keyword"), F.lit(0.0)) > 0, F.least(F.lit(KEYWORD_LIMIT), F.col("keyword"))),
    ]
    place, score = F.lit(len(ladder) + 1), F.lit(0.0)
    for i, (test, value) in reversed(list(enumerate(ladder, 1))):
        place, score = F.when(test, i).otherwise(place), F.when(test, value).otherwise(score)
    return rows.withColumn("_dice", dice).withColumns({"match_order": place, "score": F.round(score, 6)}).drop("_dice")


def distinct_pairs(pairs: DataFrame, order: list) -> DataFrame:
    """One pair for each question hash and trimmed reply, the first in ``order``."""
    key = F.concat_ws("\n", "question_hash", F.trim(F.col("customer_reply_text")))
    return first_per_content(pairs, key, order)
