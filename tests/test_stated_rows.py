"""Operators over a few rows made by hand, for what no driver table holds (Japanese texts, products, versions), with the rows
they must give."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.text import redact
from caselens.functions.text import fold
from caselens.operators import coverage, facts, pairs, quality, replies, retrieval, search, selection, sources

CANDIDATE = (
    "query_id string, candidate_id string, original_rank int, coverage array<string>, quality double, source_type string, document_id string, section string, "
    "file_path string, content_hash string, text string, technical_tokens array<string>, manually_selected boolean, excluded boolean, estimated_chars int"
)


def _row(case: str, name: str, rank: int, covers: str, quality: float, **more) -> tuple:
    get = more.get
    return (case, name, rank, list(covers), quality, get("kind", "Manual"), get("document"), get("section"), get("file"), None, get("text", name), [], get("manual", False), get("out", False), get("chars", 0))


#: Case: (required, base, budget, expected, candidates). Each asks for one rule of the choice.
SELECTION = {
    "repeats": ("ABC", 3, 2000, ["a1", "b1", "c1"], [("a1", 1, "A", 0.9, {"document": "d1", "section": "s", "text": "one two three"}), ("a2", 2, "A", 0.89, {"document": "d1", "section": "s", "text": "one two three"}), ("b1", 3, "B", 0.75, {"document": "d2", "section": "t"}), ("c1", 4, "C", 0.7, {"document": "d3", "section": "u"})]),
    "three": ("ABC", 3, 2000, ["a", "b", "c"], [("a", 1, "A", 0.9, {}), ("b", 2, "B", 0.8, {}), ("c", 3, "C", 0.7, {}), ("more", 4, "D", 0.65, {})]),
    "four": ("ABCD", 3, 2000, ["a", "b", "c", "d"], [("a", 1, "A", 0.9, {}), ("b", 2, "B", 0.8, {}), ("c", 3, "C", 0.7, {}), ("d", 4, "D", 0.6, {})]),
    "five": ("ABCDEF", 3, 2000, ["a", "b", "c", "d", "e"], [("a", 1, "A", 0.9, {}), ("b", 2, "B", 0.8, {}), ("c", 3, "C", 0.7, {}), ("d", 4, "D", 0.6, {}), ("e", 5, "E", 0.5, {})]),
    "excluded": ("AB", 2, 2000, ["a", "b"], [("x", 1, "B", 0.99, {"out": True}), ("a", 2, "A", 0.8, {}), ("b", 3, "B", 0.7, {})]),
    "weak": ("AB", 2, 2000, ["a"], [("a", 1, "A", 0.8, {}), ("low", 2, "B", 0.1, {})]),
    "neighbours": ("A", 3, 2000, ["p1"], [("p1", 1, "A", 0.9, {"document": "m", "section": "s", "text": "the same words"}), ("p2", 2, "A", 0.85, {"document": "m", "section": "s", "text": "the same words"})]),
    "sections": ("AB", 2, 2000, ["p1", "p2"], [("p1", 1, "A", 0.9, {"document": "m", "section": "s", "text": "first words"}), ("p2", 2, "B", 0.8, {"document": "m", "section": "t", "text": "other things"})]),
    "by_hand": ("ABC", 3, 2000, ["h1", "h2", "c"], [("h1", 1, "A", 0.2, {"manual": True}), ("h2", 2, "B", 0.2, {"manual": True}), ("again", 3, "A", 0.95, {}), ("c", 4, "C", 0.7, {})]),
    "over_limit": ("A", 3, 2000, [f"h{i}" for i in range(1, 7)], [(f"h{i}", i, "A" if i == 1 else "", 0.5, {"manual": True}) for i in range(1, 7)]),
    "characters": ("AB", 2, 200, ["a", "small"], [("a", 1, "A", 0.9, {"chars": 100}), ("large", 2, "B", 0.8, {"chars": 150}), ("small", 3, "", 0.7, {"chars": 50})]),
    "archive": ("AB", 2, 2000, ["zip", "plain"], [("plain", 1, "B", 0.8, {"file": "m.pdf"}), ("zip", 2, "A", 0.85, {"file": "a.zip!/g.pdf"})]),
}


def _selection(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [_row(case, name, rank, covers, q, **more) for case, v in SELECTION.items() for name, rank, covers, q, more in v[4]]
    required = [(k, list(v[0]), v[1], v[2]) for k, v in SELECTION.items()]
    return spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(required, "query_id string, required_coverage array<string>, base_items int, character_budget int")


def coverage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage_selection(*_selection(spark)).select("query_id", "pick", "candidate_id")


def coverage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, required = _selection(spark)
    required = required.withColumn("corpus_coverage", F.when(F.col("query_id") == "five", F.array(*map(F.lit, "ABCDE"))))
    found = selection.coverage_outcome(rows, required)
    return found.select("query_id", F.array_join("missing", "").alias("missing"), F.array_join("statuses", ",").alias("statuses"), F.array_join("warnings", ",").alias("warnings"), "redundant")


ANSWERS = [
    ("upload", "QACの解析結果をValidateへアップロードするコマンドと認証、接続、確認方法は？", "まずtokenで認証してprojectを接続します。qacli validate build --project Demo を実行してアップロードし、portalで表示を確認してください。", ["qacli validate build --project Demo でアップロードする。", "tokenで認証し、projectを接続する。portalで確認する。"], "CustomerReady", 0),
    ("stream", "Validate Streamの概要と設定、関連付けの確認方法を教えてください。", "Validate Streamの概要は解析結果を整理する機能です。Streamを作成して設定し、projectを関連付け、画面で状態を確認してください。よろしくお願いいたします。", ["Validate Streamとは整理する機能です。作成して設定し、projectを関連付けて確認します。"], "CustomerReady", 0),
    ("nothing", "Validateの機能Yを設定する方法は？", "今ある情報では設定方法を確認できません。", [], "InsufficientEvidence", 0),
    ("command", "Validateへ解析結果をアップロードする方法は？", "qacli validate publish --force を実行してアップロードし、portalで確認してください。", ["qacli validate build --project Demo を実行し、Validate portalで確認します。"], "Blocked", 2),
    ("versions", "Validate StreamをVersion 9.2で設定する方法は？", "Version 9.2ではValidate Streamを作成して設定し、projectを関連付けます。Version 8.1とは違うため、状態を確認してください。", ["Version 9.2ではValidate Streamを作成し関連付けて確認します。", "Version 8.1ではValidate Streamの設定が違います。"], "NeedsReview", 0),
    ("topic", "Validate Streamの概要と設定方法は？", "Validate License Serverを設定し、ライセンスを確認してください。", ["Validate Streamの概要と作成、設定、確認です。"], "Blocked", 2),
    ("style", "Validateへ解析結果をアップロードするコマンドと認証、接続、確認方法は？", "token authentication; project connection; qacli validate build --project Demo; upload; verify in Validate portal", ["token authentication; project connection; qacli validate build --project Demo; upload; verify in Validate portal"], "NeedsReview", 0),
    ("leak", "Validate Streamの概要は？", "概要として、Evidence scoreが高いのでValidate Streamは結果を整理する機能だと回答します。", ["Validate Streamは結果を整理する機能です。"], "NeedsReview", 0),
]


def answer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([a[:4] for a in ANSWERS], "id string, question string, answer string, evidence array<string>").withColumn("insufficient_reasons", F.array().cast("array<string>"))
    return quality.evaluated(rows, "HelixQAC").select("id", "decision", "unsupported_claims")


def negation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "LicenseではなくStreamの設定。Eclipse以外は不要"), (2, "改行\nBackupを除く手順"), (3, "普通の文"), (4, None)], "id int, text string")
    n = coverage.negation(F.col("text"))
    return rows.select("id", F.regexp_replace(F.trim(n["primary"]), " +", " ").alias("kept"), F.array_join(n["excluded"], "|").alias("excluded"))


def redaction_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "mail a.b@example.co.jp or +81-090-1234-5678"), (2, "C:\\work\\log.txt and sk-abcdefghijkl1234"), (3, "apikey = ABCDEFGH99, Bearer abcdefghijklmnop"), (4, "12345 stays, 03-1234-5678 not")], "id int, text string")
    return rows.select("id", redact(F.col("text")).alias("text"))


def fullwidth_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width Latin letters are found by plain ones; product and version are compared folded."""
    rows = spark.createDataFrame([(1, 0, "ＣＣＴ 生成", "ＱＡＣ", "１.２"), (2, 0, "cct の別の話題です", "qac", "1.3"), (3, 0, "ライセンス認証", "Other", None)], "document_id long, chunk_index int, text string, product string, version string")
    queries = spark.createDataFrame([(1, "CCT 生成", " QAC", "1.2"), (2, "ライセンス", None, None)], "query_id long, query string, product string, version string")
    scores = retrieval.bm25(rows, queries)
    out = None
    for mode in retrieval.FILTER_MODES:
        part = retrieval.ranked(retrieval.filtered(scores, rows, queries, mode), 3).select(F.lit(mode).alias("mode"), "query_id", "document_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def japanese_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "ライセンス認証エラーの対処", "license.pdf", "サーバー名とポート番号を設定します。"), (2, "概要", "intro.pdf", "ライセンスの説明"), (3, "アップロード", "up.pdf", "Validateへ送る")], "id long, title string, file_name string, text string")
    queries = spark.createDataFrame([(1, "ライセンス認証エラーを確認したい"), (2, "Validate アップロード")], "query_id long, query string")
    found = search.scored(rows, ["id"], [("title", 3.4, "title"), ("file_name", 2.0, "metadata"), ("text", 1.0, "body")], queries)
    return found.select("query_id", "id", (F.col("score") > 0.42).alias("strong"), (F.size("matched_terms") <= 12).alias("told"))


def procedure_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(
        [
            (1, "How to generate CCT", "CCT generate: クリック してください"),
            (2, "How to generate CCT in GUI and CLI", "CCT generate クリック QA GUI qacli"),
            (3, "What is CCT", "CCT generate クリック"),
            (4, "create CCT", "CCT " + "x" * 200 + " generate クリック"),
            (5, "ValidateへGUIでアップロードする方法", "ポータル > Validate > 解析結果をアップロード"),
            (6, "Validate upload by GUI and CLI", "Portals > Validate > Upload Results; qacli validate build --qaf-project x"),
        ],
        "id int, query string, content string",
    )
    return rows.select("id", search.procedure_boost("query", "content").alias("boost"))


def japanese_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "株式会社テスト 様\nいつもお世話になっております。\nサポート番号：AB-77 のＣＣＴ生成、2024年1月2日 10:30 に失敗！\n以上です\n-----"
    rows = spark.createDataFrame([(1, text, None), (2, "Acme社のCCT & qacli", "Acme社"), (3, None, None)], "id int, text string, company string")
    return rows.select("id", pairs.normal_question(F.col("text"), F.col("company")).alias("normal"))


def technical_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "v9.2.1 と HF-12、QAC-404、C:\\a\\b.txt", "V9.2.1 の /opt/qac/bin と 5 MB、`qacli analyze`。"), (2, "", None)], "id int, a string, b string")
    d = facts.technical_diff(F.col("a"), F.col("b"))
    return rows.select("id", F.array_join(d["removed"], "|").alias("removed"), F.array_join(d["added"], "|").alias("added"))


def upload_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(
        [
            (1, "Validateへのupload手順", "```\nqacli validate build --project x\n```\n1. login\n確認はportal", ["HowToQuestion", "CommandQuestion"]),
            (2, "Validate upload", "エラー時の対処", ["TroubleshootingQuestion"]),
            (3, "設定は？", "qacli config", ["ConfigurationQuestion"]),
            (4, "?", "x", []),
        ],
        "id int, question string, text string, types array<string>",
    )
    return rows.select("id", F.array_join(coverage.upload_flags(F.col("question"), F.col("text")), "").alias("flags"), F.round(coverage.type_score(F.col("types"), F.col("text")), 6).alias("score"))


def reply_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "社内メモ: 秘密\nC:\\a\\b.txt を evidence id: E12 で確認"), (2, "問題ありません。 "), (3, None)], "id int, text string")
    return rows.select("id", replies.clean_reply(F.col("text")).alias("reply"), F.array_join(replies.reply_warnings(F.col("text")), ",").alias("warnings"))


def cell_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "設定する", False), (2, "=A1", True), (3, " ", False), (4, "plain", False), (5, "詳細 https://a/b", False)], "id int, value string, formula boolean")
    return rows.select("id", replies.translatable(F.col("value"), F.col("formula")).alias("t")).select("id", "t.*")


def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, '<think>{"no": 1}</think>```json\n{"status": "ok", "answer": "yes", "confidence": 0.5, "evidence": ["a", "b"]}\n``` bye'), (2, '{"status": 3, "confidence": "x"}'), (3, "no object"), (4, None)], "id int, text string")
    r = replies.answer_fields(F.col("text"))
    return rows.select("id", r["status"].alias("status"), r["answer"].alias("answer"), r["confidence"].alias("confidence"), F.array_join(r["evidence"], ",").alias("evidence"))


def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "SASTの最新バージョンとEngine Packは？"), (2, "現在 9.2 からアップグレード可能ですか"), (3, "qacli の使い方"), (4, "こんにちは"), (5, "error code の原因")], "id int, text string")
    c = replies.classified(F.col("text"))
    return rows.select("id", F.array_join(c["types"], ",").alias("types"), F.array_join(c["requested"], ",").alias("requested"))


def product_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, " QAC "), (2, "a/b:c"), (3, None), (4, "..")], "id int, product string")
    return rows.select("id", replies.product_folder(F.col("product")).alias("folder"))


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = sources.query_variants("Stream の設定", {"Stream": ["ストリーム", "STREAM"]})
    return spark.createDataFrame(list(enumerate(forms)), "n int, query string")


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "ＡＢＣ ①"), (2, "Straße ÉCOLE"), (3, "ｶﾞｲﾄﾞ"), (4, "Ⅳ ﬁ"), (5, None)], "id int, text string")
    return rows.select("id", fold(F.col("text")).alias("folded"))


CASES = {
    "coverage_cases": (coverage_cases, ("query_id, pick, candidate_id", [(k, i, c) for k, v in SELECTION.items() for i, c in enumerate(v[3], 1)])),
    "coverage_outcomes": (
        coverage_outcomes,
        (
            "query_id, missing, statuses, warnings, redundant",
            [
                ("repeats", "", "CoverageSatisfied", "", 0),
                ("three", "", "CoverageSatisfied", "", 0),
                ("four", "", "CoverageSatisfied", "", 0),
                ("five", "F", "MissingCoverageInCorpus,MissingCoverageInSearchResults,CoverageInsufficient", "", 0),
                ("neighbours", "", "CoverageSatisfied", "", 1),
                ("by_hand", "", "CoverageSatisfied", "", 0),
                ("over_limit", "", "CoverageSatisfied", "ManualSelectionExceedsLimit", 0),
                ("excluded", "", "CoverageSatisfied", "", 0),
                ("weak", "B", "CoverageInsufficient", "", 0),
                ("sections", "", "CoverageSatisfied", "", 0),
                ("characters", "B", "SelectionBudgetExceeded", "", 0),
                ("archive", "", "CoverageSatisfied", "", 0),
            ],
        ),
    ),
    "answer_cases": (answer_cases, ("id, decision, unsupported_claims", [(a[0], a[4], a[5]) for a in ANSWERS])),
    "negation_cases": (negation_cases, ("id, kept, excluded", [(1, "Streamの設定。 不要", "License|Eclipse"), (2, "改行\n 手順", "Backup"), (3, "普通の文", ""), (4, "", "")])),
    "redaction_cases": (
        redaction_cases,
        ("id, text", [(1, "mail [メールアドレス] or [電話番号]"), (2, "[Windowsパス] and [APIキー]"), (3, "[APIキー], [APIキー]"), (4, "12345 stays, [電話番号] not")]),
    ),
    "fullwidth_search": (
        fullwidth_search,
        ("mode, query_id, document_id, rank", [("none", 1, 1, 1), ("none", 1, 2, 2), ("none", 2, 3, 1), ("product", 1, 1, 1), ("product", 1, 2, 2), ("product", 2, 3, 1), ("product_and_version", 1, 1, 1), ("product_and_version", 2, 3, 1)]),
    ),
    "japanese_search": (japanese_search, ("query_id, id, strong, told", [(1, 1, True, True), (1, 2, False, True), (2, 3, True, True)])),
    "procedure_boosts": (procedure_boosts, ("id, boost", [(1, 0.22), (2, 0.34), (3, 0.0), (4, 0.0), (5, 0.22), (6, 0.34)])),
    "japanese_questions": (japanese_questions, ("id, normal", [(1, "のcct生成 に失敗"), (2, "のcct & qacli"), (3, "")])),
    "technical_diffs": (technical_diffs, ("id, removed, added", [(1, "c:\\a\\b.txt|hf-12|qac-404", "/opt/qac/bin|5 mb|qacli analyze"), (2, "", "")])),
    "reply_cases": (reply_cases, ("id, reply, warnings", [(1, "[内部パス削除] を [根拠ID削除] で確認", "InternalPath,EvidenceId,InternalMemo"), (2, "問題ありません。", ""), (3, "", "")])),
    "cell_cases": (cell_cases, ("id, translate, reason", [(1, True, ""), (2, False, "formula"), (3, False, "blank"), (4, False, "not Japanese"), (5, False, "address")])),
    "reply_json": (reply_json, ("id, status, answer, confidence, evidence", [(1, "ok", "yes", 0.5, "a,b"), (2, "3", None, None, None), (3, None, None, None, None), (4, None, None, None, None)])),
    "question_classes": (
        question_classes,
        (
            "id, types, requested",
            [
                (1, "LatestVersionQuestion", "LatestSastVersion,LatestEnginePackVersion"),
                (2, "UpgradePossibilityQuestion", "UpgradePossibility,CurrentInstalledVersion"),
                (3, "HowToQuestion,CommandQuestion", ""),
                (4, "GeneralSupportQuestion", ""),
                (5, "TroubleshootingQuestion,ErrorMessageQuestion", ""),
            ],
        ),
    ),
    "product_folders": (
        product_folders,
        ("id, folder", [(1, "QAC"), (2, "a_b_c_" + hashlib.sha256(b"a/b:c").hexdigest()[:8]), (3, "Default"), (4, "Product_" + hashlib.sha256(b"..").hexdigest()[:8])]),
    ),
    "query_variants": (query_variants, ("n, query", [(0, "Stream の設定"), (1, "ストリーム の設定")])),
    "folded_texts": (folded_texts, ("id, folded", [(1, "abc 1"), (2, "strasse école"), (3, "ガイド"), (4, "iv fi"), (5, None)])),
    "upload_flags": (upload_flags, ("id, flags, score", [(1, "ABCDEF", 0.75), (2, "G", 1.0), (3, "", 1.0), (4, "", 0.0)])),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_gives_the_stated_rows(spark, name):
    function, (columns, want) = CASES[name]
    got = function(spark, "")
    assert got.columns == columns.split(", ")
    plain = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got.collect()) == plain(want)
