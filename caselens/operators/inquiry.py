"""What an inquiry is about, and which evidence speaks to it.

``focused`` analyses each inquiry within its row: the part that asks, its versions, a ranked and bounded list of terms, and
whether it asks for what is newest. ``relevant`` joins inquiries and evidence by the terms that they share: all inquiries'
terms are looked for in one pass over the evidence, and what is found is counted, so no pair without a shared term exists
anywhere.

Defined cases: null and blank inquiries have an empty focus and no terms, and evidence without letters or digits speaks to
none; an inquiry without terms holds all evidence relevant, and is told by ``unbounded`` and not paired; repeated rows are
rows; equal scores go by length and then in code-point order; empty tables give empty results; other columns stay.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import composed
from caselens.scratch import written

from . import containment

# What begins the part that asks, words that say nothing, terms that are known, words that ask for what is
# newest, words of a request, generic words and short strong terms of evidence, patterns and limits.
SECTION_MARKERS = ["[質問]", "【質問】", "質問:", "質問：", "お問い合わせ内容", "問い合わせ内容"]
STOP_WORDS = [
    "よろしく", "お願い", "お世話", "確認", "質問", "件名", "次に", "標準", "できますか", "でしょうか", "ご教示", "いただけますか", "サポートチーム", "何卒", "します", "ください", "したい", "したいです",
]
KNOWN_TERMS = [
    "ライセンス認証エラー", "ライセンスサーバー名", "ライセンスサーバー", "ライセンス", "認証", "エラー", "サーバー名", "サーバー", "ポート番号", "ポート", "ファイアウォール設定", "ファイアウォール", "設定", "起動", "失敗", "成功",
    "権限", "権限不足", "権限不十分", "QAC", "Dashboard", "Validate", "インストール方法", "インストール", "アップロード", "解析結果", "接続確認", "接続", "手順書", "手順", "方法", "permission", "error", "license", "server", "port",
    "firewall", "version",
]
FRESH_WORDS = [
    "最新", "最新版", "最新バージョン", "current version", "latest version", "最新リリース", "latest release", "最新パッチ", "latest patch", "リリース日", "release date", "サポート期限", "eol", "対応バージョン",
]
REQUEST_WORDS = ["手順書", "利用方法", "設定手順", "トラブルシューティング", "マニュアル", "ドキュメント"]
GENERIC_WORDS = [
    "お願い", "お願いします", "ください", "いただけ", "いただけないか", "確認", "情報", "具体的", "今回", "現在", "提供", "連絡", "お手数", "以上", "よろしく", "いつも", "お世話", "担当者様", "株式会社", "テクニカルサポート",
]
SHORT_STRONG = ["qac", "dashboard", "ダッシュボード", "手順書", "対応os", "サポートos"]
SEPARATORS = r"[\s、。．，,;；:：\[\]【】（）()<>＜＞\"'`]+"
NAME = r"[a-zA-Z0-9][a-zA-Z0-9._:/+\-]+"
NUMBER = r"(?<![\p{Nd}.])\p{Nd}{1,4}(?:\.\p{Nd}{1,4}){1,3}(?![\p{Nd}.])"
OPENED, CLOSED = r"\[［(（", r"\]］)）"
CONTACT = r"(?i)(?:^|\b)(?:tel|e-?mail|fax)\b|〒|\d{2,4}-\d{2,4}-\d{3,4}"
JAPANESE = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
KNOWN_SCORE, LACKING = 100, ("権限", "不十分", "権限不足", 120)
NAME_SCORE, JAPANESE_SCORES, OTHER_SCORES, LONG_TERM = 85, (70, 45), (55, 20), 4
LONGEST_JAPANESE = 24
MOST_TERMS, MOST_VERSIONS, MOST_EVIDENCE_TERMS = 24, 8, 32
GRAM_SIZES, LONGEST_GRAMMED, STRONG_SIZE, LEAST_SHARED = range(2, 9), 40, 5, 2


def bare(text: Column) -> Column:
    """A text in lower case without white space, punctuation and symbols; it is given in NFKC form."""
    return F.regexp_replace(F.lower(text), r"[\p{IsWhite_Space}\p{P}\p{S}]", "")


def bare_word(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKC", word).lower() if not c.isspace() and unicodedata.category(c)[0] not in "PS")


def held(text: Column, words: list[str]) -> Column:
    """The words of a list whose bare form a bare text has, in order."""
    return F.filter(F.array(*(F.when(_has(text, bare_word(w)), F.lit(w)) for w in words)), lambda x: x.isNotNull())


def _has(text: Column, word: str) -> Column:
    """Whether a text of bare tokens, parted by blanks, has a bare word; a port must be a token or be numbered."""
    whole = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {word} "))
    if word == "ポート":
        return whole | F.contains(text, F.lit("ポート番号"))
    return whole if word == "port" else F.contains(text, F.lit(word))


def _lines(text: Column) -> Column:
    """The lines that are neither blank nor a greeting or signature: short ones, and those of a word that says nothing and of
    none that is known, unless they name something or ask for a document."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")), lambda x: x != "")
    any_of = lambda x, words: F.coalesce(*[F.when(F.contains(x, F.lit(w)), True) for w in words], F.lit(False))

    def stays(x: Column) -> Column:
        named = x.rlike(NAME) | any_of(x, REQUEST_WORDS)
        flat = bare(x)
        idle = any_of(flat, [bare_word(w) for w in STOP_WORDS]) & ~any_of(flat, [bare_word(w) for w in KNOWN_TERMS])
        return named | ((F.char_length(flat) > 2) & ~idle)

    return F.filter(lines, stays)


def focus_text(text: Column) -> Column:
    """What follows the first kind of marker that stands in the text, else the lines that say something, else the text."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    trimmed = lambda x: F.regexp_replace(x, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")
    lines = _lines(text)
    out = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(text)
    for marker in reversed(SECTION_MARKERS):
        at = F.instr(F.lower(text), marker.lower())
        out = F.when(at > 0, F.substr(text, at + len(marker))).otherwise(out)
    return trimmed(out)


def versions(text: Column) -> Column:
    """The first eight different numbers of two to four parts that are no steps in brackets and no dates."""
    step = rf"(?<=[{OPENED}])(?=\p{{Nd}}[\p{{Nd}}.]*(?<!\.)(?:[\s{CLOSED}]))"
    found = F.regexp_extract_all(text, F.lit(rf"(?!{step}){NUMBER}"), 0)
    parts = lambda v, i: F.split(v, r"\.")[i].cast("int")
    dated = lambda v: (F.size(F.split(v, r"\.")) == 3) & v.rlike(r"^\p{Nd}{4}\.") & parts(v, 0).between(1900, 2200) & parts(v, 1).between(1, 12) & parts(v, 2).between(1, 31)
    return F.slice(F.array_distinct(F.filter(found, lambda v: ~dated(v))), 1, MOST_VERSIONS)


def _score(token: Column) -> Column:
    long = F.char_length(token) >= LONG_TERM
    return (
        F.when(token.rlike(NAME), NAME_SCORE)
        .when(token.rlike(JAPANESE), F.when(long, JAPANESE_SCORES[0]).otherwise(JAPANESE_SCORES[1]))
        .otherwise(F.when(long, OTHER_SCORES[0]).otherwise(OTHER_SCORES[1]))
    )


def once(values: Column) -> Column:
    """An array without members that repeat an earlier one but for case."""
    lower = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def focused(rows: DataFrame, text: str = "text", own: list[str] | None = None) -> DataFrame:
    """``rows`` with focus_text, important_terms (versions first, then by score, 24 at most), excluded_terms, target_versions,
    fresh and fresh_words (which ask for what is newest). ``own`` names columns whose values are no terms: the customer's
    own names and numbers."""
    stop = [bare_word(w) for w in STOP_WORDS]
    rows = rows.withColumn("focus_text", focus_text(F.col(text))).withColumn("target_versions", versions(F.col("focus_text")))
    tokens = F.filter(F.split(composed(F.col("focus_text")), SEPARATORS), lambda t: F.char_length(t) >= 2)
    rows = rows.withColumn("_tokens", tokens).withColumn("_flat", F.array_join(F.transform("_tokens", bare), " "))
    entry = lambda score, term: F.struct((-score).alias("score"), (-F.char_length(term)).alias("size"), term.alias("term"))
    known = F.transform(held(F.col("_flat"), KNOWN_TERMS), lambda t: entry(F.char_length(t) + KNOWN_SCORE, t))
    word, missing, term, score = LACKING
    lacking = F.when(F.contains("_flat", F.lit(word)) & F.contains("_flat", F.lit(missing)), F.array(entry(F.lit(score), F.lit(term)))).otherwise(F.array().cast("array<struct<score:int,size:int,term:string>>"))
    keep = lambda t: (bare(t) != "") & ~bare(t).isin(stop) & ~F.contains(t, F.lit("@")) & ~t.rlike(CONTACT) & ~(t.rlike(JAPANESE) & (F.char_length(t) > LONGEST_JAPANESE))
    free = F.transform(F.filter(F.array_distinct("_tokens"), keep), lambda t: entry(_score(t), t))
    every = F.array_sort(F.concat(lacking, known, free))
    names = F.array_distinct(F.transform(every, lambda e: e["term"]))  # a term stands where its best score puts it
    for column in own or []:
        names = F.filter(names, lambda t: ~t.eqNullSafe(F.trim(F.col(column))))  # noqa: B023
    rows = rows.withColumn("_terms", F.slice(names, 1, MOST_TERMS))
    fresh = held(F.col("_flat"), FRESH_WORDS)
    return rows.withColumns(
        {
            "important_terms": F.slice(once(F.concat("target_versions", "_terms")), 1, MOST_TERMS),
            "excluded_terms": held(F.col("_flat"), STOP_WORDS),
            "fresh_words": fresh,
            "fresh": F.size(fresh) > 0,
        }
    ).drop("_tokens", "_flat", "_terms")


def evidence_terms(rows: DataFrame) -> DataFrame:
    """``rows`` of ``focused`` with evidence_terms, by which evidence is told to speak to an inquiry: versions, important
    terms, and the tokens of the focus with the 2- to 8-grams of Japanese ones; without generic ones, 32 at most."""
    rows = rows.withColumn("_composed", composed(F.col("focus_text")))
    generic = [bare_word(w) for w in GENERIC_WORDS]
    given = lambda t: (F.char_length(t) >= 2) & (bare(t) != "") & ~bare(t).isin(generic)
    none = F.array().cast("array<string>")

    def grams(token: Column) -> Column:
        size = F.char_length(token)
        runs = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(token, i, F.lit(n)))).otherwise(none) for n in GRAM_SIZES]
        return F.when(token.rlike(JAPANESE) & (size <= LONGEST_GRAMMED), F.concat(F.array(token), *runs)).otherwise(F.array(token))

    tokens = F.filter(F.split("_composed", SEPARATORS), given)
    every = F.filter(F.concat("target_versions", "important_terms", F.flatten(F.transform(tokens, grams))), given)
    return rows.withColumn("evidence_terms", F.slice(once(every), 1, MOST_EVIDENCE_TERMS)).drop("_composed")


def relevant(inquiries: DataFrame, evidence: DataFrame, most: int = containment.BYTES) -> tuple[DataFrame, DataFrame]:
    """(pairs, unbounded): pairs (query_id, evidence_id, matched, strong) of the evidence (evidence_id, text) that holds one strong
    term of a focused inquiry (query_id, ``focused``'s columns), or two; unbounded (query_id) are inquiries without terms."""
    terms = written(evidence_terms(inquiries).select("query_id", F.col("evidence_terms").alias("_terms")), "inquiry-terms")
    each = terms.select("query_id", F.explode("_terms").alias("term")).withColumn("key", bare(composed(F.col("term"))))
    each = written(each.withColumn("strong", (F.char_length("key") >= STRONG_SIZE) | F.col("key").isin(SHORT_STRONG)), "inquiry-keys")
    texts = evidence.select(F.col("evidence_id").alias("_key"), bare(composed(F.coalesce("text", F.lit("")))).alias("text"))
    hits = containment.found(texts, each.select(F.col("key").alias("term"), F.lit(False).alias("bounded")).distinct(), most)
    shared = hits.withColumnRenamed("term", "key").join(each, "key")
    pairs = shared.groupBy("query_id", F.col("_key").alias("evidence_id")).agg(F.count("*").alias("matched"), F.max("strong").alias("strong"))
    return pairs.filter(F.col("strong") | (F.col("matched") >= LEAST_SHARED)), terms.filter(F.size("_terms") == 0).select("query_id")
