"""What questions need to be covered and texts cover, and the scope of negations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import fold, fold_all

from . import topics

# Requirements of the two kinds of questions, and the words that cover each item. An item may need a word
# of each of several lists.
UPLOAD = ["Command", "Options", "Authentication", "Connection", "UploadProcedure", "ValidateVerification", "Troubleshooting"]
STREAM = ["StreamOverview", "Purpose", "StreamCreation", "QacAssociation", "Configuration", "Verification"]
COMMAND, OPTION = r"(?i)(?<![A-Za-z0-9_])qacli(?:\s+[A-Za-z0-9_.+/-]+){1,4}", r"(?<![A-Za-z0-9_])--[A-Za-z0-9][A-Za-z0-9_-]*"
VALIDATE, QAC, STREAM_WORDS = ["validate"], ["qac", "qacli", "perforce qac"], ["stream", "ストリーム"]
OBSERVED: list[tuple[list[str], list[list[str]]]] = [
    (["Authentication"], [["qacli auth", "認証", "ログイン", "credential", "token", "authentication"]]),
    (["Connection", "Association"], [["validate connect", "接続", "connection", "connect", "server url", "サーバーurl"]]),
    (["UploadProcedure", "Execution"], [VALIDATE, ["validate build", "validate ibuild", "アップロード", "upload", "build"]]),
    (["ValidateVerification", "Verification"], [VALIDATE, ["確認", "verify", "verification", "portal", "build一覧", "表示"]]),
    (["Troubleshooting"], [["失敗", "エラー", "原因", "対処", "ログ", "troubleshoot", "failure", "failed", "error", "check"]]),
    (["StreamOverview"], [STREAM_WORDS, ["概要", "とは", "overview", "definition"]]),
    (["Purpose"], [STREAM_WORDS, ["用途", "目的", "利用", "purpose", "use case"]]),
    (["StreamCreation"], [STREAM_WORDS, ["作成", "create", "creation", "new stream"]]),
    (["QacAssociation"], [STREAM_WORDS, QAC, ["関連付け", "紐付け", "associate", "association", "link"]]),
    (["Configuration"], [STREAM_WORDS, ["設定", "構成", "configure", "configuration", "setup"]]),
    (["Verification"], [STREAM_WORDS, ["確認", "検証", "verify", "verification", "check"]]),
]
OPTION_WORDS = ["オプション", "option", "parameter"]
# What excludes the clause before it, what begins a clause, and the marks around an excluded part.
EXCLUSION = "(?:ではなく(?:て)?|ではない|ではありません|以外(?:は|の)?|を除く)"
CLAUSE, CLAUSE_END = "[^。！？!?\\n\\r;；]", "[。！？!?\\n\\r;；]"
MARKS = "^[ 、,。]+|[ 、,。]+$"
# The items that a question about an upload may have covered, with their words, and scores of types.
CODE, STEP = r"```|`[^`]+`", r"(?m)^\s*\d+[.)、]"
UPLOAD_FLAGS = {
    "C": ["auth", "authentication", "login", "credential", "token", "認証", "ログイン"],
    "D": ["project", "プロジェクト", "associate", "関連付け"],
    "G": ["fail", "error", "check", "失敗", "エラー", "確認事項", "troubleshoot"],
}
HOW_TO = [
    ["prerequisite", "事前", "前提"], ["auth", "login", "認証", "接続"], ["execute", "run", "実行"], ["success", "complete", "完了", "成功"], ["verify", "confirm", "確認"],
]
TYPE_WORDS = {
    "ConfigurationQuestion": ["設定", "config", "option"],
    "TroubleshootingQuestion": ["原因", "対処", "error", "失敗"],
    "VersionQuestion": ["version", "バージョン", "release"],
    "PermissionQuestion": ["permission", "権限", "role", "access"],
    "ErrorMessageQuestion": ["error message", "error code", "エラーメッセージ", "エラーコード"],
}


def has_any(folded: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(folded, F.lit(w.lower()))
    return out


def listed(flags: list[tuple[str, Column]]) -> Column:
    """The names whose flag holds, each once, in order."""
    return F.array_distinct(F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in flags)), lambda x: x.isNotNull()))


def required(question: Column, profile: Column) -> Column:
    """What an answer to a question must cover: an upload's or a stream's items, or nothing."""
    folded = fold(F.coalesce(question, F.lit("")))
    upload = F.array_contains(profile["operations"], "Upload") | F.array_contains(profile["features"], "Build upload") | (has_any(folded, VALIDATE) & has_any(folded, ["upload", "アップロード"]))
    items = lambda names: F.array(*map(F.lit, names))
    return F.when(upload, items(UPLOAD)).when(F.array_contains(profile["features"], "Stream"), items(STREAM)).otherwise(F.array().cast("array<string>"))


def observed(text: Column, folded: Column | None = None) -> Column:
    """The items that a text covers. Within arrays its ``folded`` form is given."""
    text = F.coalesce(text, F.lit(""))
    folded = fold(text) if folded is None else folded
    option = text.rlike(OPTION) | has_any(folded, OPTION_WORDS)
    flags = [("Command", text.rlike(COMMAND)), ("Options", option), ("Option", option)]
    for names, needs in OBSERVED:
        test = F.lit(True)
        for words in needs:
            test = test & has_any(folded, words)
        flags += [(name, test) for name in names]
    return listed(flags)


def observed_in_all(texts: Column) -> Column:
    """The items that any of an array of texts covers."""
    both = F.arrays_zip(texts.alias("t"), fold_all(texts).alias("f"))
    return F.array_distinct(F.flatten(F.transform(both, lambda x: observed(x["t"], x["f"]))))


def group_coverage(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., coverage): the items that the texts of each group cover, sorted."""
    given = F.coalesce(F.col(text), F.lit(""))
    own = rows.select(*keys, given.alias("_text"), fold(given).alias("_folded"))  # a column, as all words look into it
    each = own.select(*keys, F.explode_outer(observed(F.col("_text"), F.col("_folded"))).alias("item")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("coverage"))


def negation(text: Column) -> Column:
    """struct(primary, excluded): a text in which each clause is blank up to the end of its last exclusion, and for each
    exclusion what stands before it in its clause, earlier exclusions included, without marks around it."""
    text = F.coalesce(text, F.lit(""))
    clauses = F.regexp_extract_all(text, F.lit(f"{CLAUSE}*{CLAUSE_END}?"), 0)

    def before(clause: Column) -> Column:
        parts, found = F.split(clause, EXCLUSION), F.regexp_extract_all(clause, F.lit(EXCLUSION), 0)
        upto = lambda k: F.array_join(F.flatten(F.transform(F.slice(parts, F.lit(1), k), lambda p, i: F.array(F.coalesce(F.get(found, i - 1), F.lit("")), p))), "")
        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), upto)).otherwise(F.array().cast("array<string>"))

    def blanked(clause: Column) -> Column:
        parts = F.split(clause, EXCLUSION)
        rest = F.element_at(parts, -1)
        return F.when(F.size(parts) > 1, F.concat(F.repeat(F.lit(" "), F.char_length(clause) - F.char_length(rest)), rest)).otherwise(clause)

    excluded = F.transform(F.flatten(F.transform(clauses, before)), lambda x: F.regexp_replace(x, MARKS, ""))
    return F.struct(F.array_join(F.transform(clauses, blanked), "").alias("primary"), F.filter(excluded, lambda x: x != "").alias("excluded"))


def profiles_overlap(a: Column, b: Column) -> Column:
    """Whether two profiles share a product, component, feature, object or entity."""
    return F.coalesce(*[F.when(F.arrays_overlap(a[d], b[d]), True) for d in [*topics.DIMENSIONS, "entities"]], F.lit(False))


def excluded_overlap(text: Column, candidate: Column, catalog: topics.Catalog) -> Column:
    """Whether a candidate's profile, a column of a table, shares a topic or entity with what the text excludes."""
    parts = negation(text)["excluded"]
    both = F.arrays_zip(parts.alias("t"), fold_all(parts).alias("f"))
    return F.exists(both, lambda x: profiles_overlap(topics.profile(x["t"], catalog, x["f"]), candidate))


def upload_flags(question: Column, text: Column) -> Column:
    """The letters A to G of what a text covers of an upload, if that is what the question is about."""
    asked, folded = fold(F.coalesce(question, F.lit(""))), fold(F.coalesce(text, F.lit("")))
    command = has_any(folded, ["qacli", "command", "コマンド"]) | text.rlike(CODE)
    flags = [
        ("A", command & has_any(folded, ["upload", "アップロード", "validate"])),
        ("B", text.rlike(OPTION) | has_any(folded, ["option", "オプション", "parameter", "引数"])),
        ("C", has_any(folded, UPLOAD_FLAGS["C"])),
        ("D", has_any(folded, UPLOAD_FLAGS["D"])),
        ("E", command | has_any(folded, ["execute", "run", "実行"])),
        ("F", has_any(folded, ["validate"]) & has_any(folded, ["confirm", "verify", "portal", "確認", "表示"])),
        ("G", has_any(folded, UPLOAD_FLAGS["G"])),
    ]
    upload = has_any(asked, ["upload", "アップロード"]) & has_any(asked, VALIDATE)
    return F.when(upload, listed(flags)).otherwise(F.array().cast("array<string>"))


def type_score(types: Column, text: Column) -> Column:
    """How well a text suits the types of a question: the best of their shares of features."""
    text = F.coalesce(text, F.lit(""))
    folded = fold(text)
    share = lambda tests: sum((t.cast("int") for t in tests), F.lit(0)) / len(tests)
    command = [text.rlike(CODE), text.rlike(OPTION), has_any(folded, ["qacli", "cli", "command", "コマンド"]), has_any(folded, ["parameter", "option", "引数", "オプション"])]
    scores = [("CommandQuestion", share(command)), ("HowToQuestion", share([text.rlike(STEP), *(has_any(folded, w) for w in HOW_TO)]))]
    scores += [(name, has_any(folded, words).cast("double")) for name, words in TYPE_WORDS.items()]
    return F.greatest(F.lit(0.0), *(F.when(F.array_contains(types, name), score).otherwise(0.0) for name, score in scores))
