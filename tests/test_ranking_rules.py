"""Ranks in large groups, kept bests, folding, exclusions, inquiries, sentences and phases, beside plain versions or by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stated_rows import ANSWERS

from caselens.functions.text import fold_all
from caselens.operators import coverage, evaluation, evidence, inquiry, phases, quality, ranks, retrieval, scoring, sentences, topics
from caselens.scratch import written


def test_global_ranks(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), round(rng.random(), 2), i) for i in range(800)]
    frame = spark.createDataFrame(rows, "k string, score double, id long")
    got = {r.id: r["rank"] for r in ranks.global_ranks(frame, ["k"], [F.desc("score"), F.asc("id")]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = place
    assert got == want
    assert ranks.global_ranks(frame.limit(0), ["k"], [F.desc("score")]).collect() == []


def test_best_of_batches():
    rng = np.random.default_rng(4)
    best, scores, ids = scoring.Best(5, 7), [], []
    for at in range(6):
        part = np.round(rng.normal(size=(40, 5)), 1)
        own = rng.permutation(40) + 100 * at
        best.add(part, [own, own % 3])
        scores.append(part)
        ids.append(own)
    scores, ids = np.concatenate(scores), np.concatenate(ids)
    for q in range(5):
        want = sorted((-s, i) for s, i in zip(scores[:, q], ids, strict=True) if s > 0)[:7]
        mine = best.rows[0] == q
        assert sorted(zip(-best.rows[1][mine], best.rows[2][mine], strict=True)) == want


def test_searches_by_name(spark):
    index = retrieval.indexed(spark.createDataFrame([(1, 0, "ＡＬＰＨＡ beta"), (2, 0, "alpha gamma"), (3, 0, None)], "document_id long, chunk_index int, text string"))
    queries = spark.createDataFrame([(7, "Alpha Beta"), (8, ""), (9, None)], "query_id long, query string")
    for method in retrieval.SEARCHES:
        for reranker in retrieval.RERANKERS:
            got = retrieval.search(index, queries, 1, method, reranker).collect()
            assert [(r.query_id, r.document_id, r["rank"]) for r in got] == [(7, 1, 1)], (method, reranker)
    for bad in ({"method": "x"}, {"reranker": "x"}, {"top": 0}):
        with pytest.raises(ValueError):
            retrieval.search(index, queries, **({"top": 1} | bad))


def test_texts_are_folded_by_nfkc(spark):
    rows = spark.createDataFrame([(1, ["ＣＣＴ", None, "Straße", "a\x1eb"]), (2, []), (3, None)], "id int, a array<string>")
    assert {r.id: r.f for r in rows.select("id", fold_all(F.col("a")).alias("f")).collect()}[1] == ["cct", "", "strasse", "a b"]
    text = spark.createDataFrame([("ＶＡＬＩＤＡＴＥ へ ＵＰＬＯＡＤ Straße --force ERR-404 qacli  analyze",)], "t string")
    p = text.select(topics.profile(F.col("t"), {"products": {"Validate": ["validate"]}, "features": {"Way": ["strasse"]}}).alias("p")).first().p
    assert (p.products, p.features, p.operations) == (["Validate"], ["Way"], ["Upload"])
    assert {"option:--force", "error:err-404", "command:qacli analyze"} <= set(p.entities)
    assert text.select(coverage.observed(F.col("t")).alias("o")).first().o == ["Command", "Options", "Option", "Authentication"][:3] + ["UploadProcedure", "Execution"]
    assert {(c.kind, c.value) for c in text.select(quality.claims(F.col("t"), {"products": {"Validate": []}}).alias("c")).first().c} >= {("ProductFeature", "validate"), ("Option", "--force")}


def test_metrics_fold_terms_and_names(spark):
    top = spark.createDataFrame([(1, 1, "Die Straße und ＣＣＴ", "ＱＡＣ", "9.2")], "query_id long, rank int, text string, product string, version string")
    cases = spark.createDataFrame([(1, "qac", " 9.2", ["STRASSE", "cct ", "ＣＣＴ", "none"], ["ｓｔｒａｓｓｅ", "x"])], "query_id long, product string, version string, required_terms array<string>, excluded_terms array<string>")
    r = evaluation.term_metrics(top, cases).first()
    assert (r.required_term_coverage_at_k, r.required_terms_missing, r.excluded_terms_found, r.product_confusion_count, r.version_mismatch_count) == (0.75, ["none"], ["ｓｔｒａｓｓｅ"], 0, 0)
    rows = spark.createDataFrame([(1, "ＱＡＣ", "１.２", "2024-01-01", 0.5, "qac", "1.2", ["a"])], "query_id long, product string, version string, updated string, confidence double, asked_product string, asked_version string, matched_terms array<string>")
    r = evaluation.annotated(rows, "2024-02-01", 365).first()
    assert r.product_match and r.version_match and r.warnings == []


def test_exclusions_of_one_clause(spark):
    rows = spark.createDataFrame([(1, "LicenseではなくStreamではなくCの設定。Eclipse以外は不要"), (2, None), (3, "普通")], "id int, t string")
    n = coverage.negation(F.col("t"))
    got = {r.id: (r.p, r.e) for r in rows.select("id", n["primary"].alias("p"), n["excluded"].alias("e")).collect()}
    text = "LicenseではなくStreamではなくCの設定。Eclipse以外は不要"
    assert got[1][1] == ["License", "LicenseではなくStream", "Eclipse"] and len(got[1][0]) == len(text) and got[1][0].split() == ["Cの設定。", "不要"]
    assert got[2] == ("", []) and got[3] == ("普通", [])
    catalog = {"features": {"Stream": [], "License": []}}
    table = written(rows.filter("id = 1").withColumns({"a": topics.profile(F.lit("the STREAM"), catalog), "b": topics.profile(F.lit("none"), catalog)}), "profiles")
    over = table.select(*(coverage.excluded_overlap(F.col("t"), F.col(c), catalog).alias(c) for c in "ab")).first()
    assert over.a and not over.b


MAIL = "株式会社テスト 様\r\nいつもお世話になっております。\r\nＱＡＣ ９.２ のライセンス認証エラー、[1.1] 2024.1.3 の権限が不十分\r\n何卒よろしくお願いします\r\n以上"


def test_inquiry_focus(spark):
    rows = spark.createDataFrame([(1, MAIL, "テスト"), (2, "前置き\n【質問】 QAC 10.2.1 の最新版は?", None), (3, None, None), (4, " \n ", None), (5, "何卒", None), (6, "port 22 と ポート番号 report", "report")], "id int, text string, company string")
    got = {r.id: r for r in inquiry.focused(rows, own=["company"]).collect()}
    assert "お世話" not in got[1].focus_text and got[1].focus_text.startswith("株式会社テスト 様") and "以上" not in got[1].focus_text
    assert got[1].target_versions == [] or got[1].target_versions == ["９.２"]
    assert got[1].important_terms[: 1 + len(got[1].target_versions)][-1] == "権限不足" and "ライセンス認証エラー" in got[1].important_terms
    assert got[2].focus_text == "QAC 10.2.1 の最新版は?" and got[2].target_versions == ["10.2.1"] and got[2].fresh and got[2].important_terms[0] == "10.2.1"
    assert all((got[i].focus_text, got[i].important_terms, got[i].fresh) == ("", [], False) for i in (3, 4)) and got[5].focus_text == "何卒"
    assert "ポート番号" in got[6].important_terms and "port" in got[6].important_terms and "report" not in got[6].important_terms


def test_evidence_shares_terms(spark):
    rows = spark.createDataFrame([(1, "接続確認できない"), (2, "ab"), (3, None), (4, "alpha beta x1")], "query_id long, text string")
    focused = inquiry.focused(rows)
    terms = {r.query_id: r.evidence_terms for r in inquiry.evidence_terms(focused).collect()}
    assert {"接続", "接続確認", "できない"} <= set(terms[1]) and "確認" not in terms[1] and len(terms[1]) <= 32 and terms[3] == []
    evidence_rows = spark.createDataFrame([(10, "サーバーとの接続 確認"), (11, "何もない"), (12, "ALPHA!"), (13, "x1 of ＢＥＴＡ"), (14, "x1"), (15, None), (16, "ab")], "evidence_id long, text string")
    for most in (0, 1 << 20):
        pairs, unbounded = inquiry.relevant(focused, evidence_rows, most)
        found = {(r.query_id, r.evidence_id): (r.matched, r.strong) for r in pairs.collect()}
        assert {k for k in found if k[0] != 1} == {(4, 12), (4, 13)} and found[4, 12] == (1, True) and found[4, 13] == (2, False)
        assert (1, 10) in found and (1, 11) not in found and [r.query_id for r in unbounded.collect()] == [3]


def test_sentences(spark):
    rows = spark.createDataFrame([(1, "短い。いつもお世話になっております、長い文ですがこれは違う。対応内容を確認しました、以上の手順。これは普通の長い文章であり何も述べない文です"), (2, None), (3, "!? ")], "id int, t string")
    got = {r.id: (r.u, r.a) for r in rows.select("id", sentences.past_case_sentence(F.col("t")).alias("u"), sentences.past_case_sentence(F.col("t"), True).alias("a")).collect()}
    assert got == {1: ("対応内容を確認しました、以上の手順",) * 2, 2: (None, None), 3: (None, None)}
    sources = [(1, 0, "Manual", "First analysis of alpha. Other text! Alpha again here.", ["alpha"], ["other"]), (1, 1, "OfficialDoc", "Alpha analyze now. Beta.", ["alpha"], None), (2, 0, "Other", "nothing", ["alpha"], []), (3, 0, None, "alpha " * 100, ["alpha"], [])]
    frame = spark.createDataFrame(sources, "query_id long, source_index int, source_type string, text string, terms array<string>, excluded array<string>")
    found = {r.query_id: (r.sentence, r.score, r.source) for r in sentences.best_sentences(frame).collect()}
    assert found == {1: ("First analysis of alpha.", 24, 0)} or found == {1: ("Alpha analyze now.", 24, 1)}
    assert found[1][0] == "Alpha analyze now.", "equal scores go to the shorter"
    gui = spark.createDataFrame([(1, 0, "Manual", "解析を実行するにはメニューから選択します。ライセンスの解析をクリックします。")], "query_id long, source_index int, source_type string, text string")
    r = sentences.best_sentences(gui, lambda s: sentences.gui_score(s, F.col("source_type"), F.col("source_index"))).first()
    assert (r.sentence, r.score) == ("解析を実行するにはメニューから選択します。", 8 * 2 + 6 + 2)


def test_rank_changes(spark):
    before = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "a", 9), (2, "x", 1), (1, "n", None)], "q int, id string, rank int")
    after = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "d", 3), (3, "y", 1)], "q int, id string, rank int")
    got = {(r.q, r.id): (r.change, r.moved) for r in phases.rank_changes(before, after, ["q"], ["id"]).collect()}
    assert got == {(1, "a"): ("left", None), (1, "b"): ("same", 0), (1, "c"): ("risen", 2), (1, "d"): ("entered", None), (2, "x"): ("left", None), (3, "y"): ("entered", None)}
    s = {r.q: (r["items"], r.overlap, r.farthest) for r in phases.change_summary(phases.rank_changes(before, after, ["q"], ["id"]), ["q"]).collect()}
    assert s == {1: (4, 0.5, 2), 2: (1, 0.0, 0), 3: (1, 0.0, 0)}


def test_phases_of_answers(spark):
    """The stated answers as one phase, and empty ones as another: the gate counts what is not as expected."""
    rows = [(a[0], a[1], a[3], [], a[4], a[5], {"good": a[2], "none": ""}) for a in ANSWERS]
    cases = spark.createDataFrame(rows, "case_id string, question string, evidence array<string>, insufficient_reasons array<string>, expected_decision string, expected_unsupported int, answers map<string,string>")
    found = {r.phase: r for r in phases.phase_report(phases.phase_answers(cases, ["good", "none"], "HelixQAC")).collect()}
    good, none = found["good"], found["none"]
    assert (good.answers, good.status, good.mismatches, good.false_positives) == (len(ANSWERS), "passed", 0, 0)
    assert good.Blocked == sum(a[4] == "Blocked" for a in ANSWERS) and good.CustomerReady == 2
    assert none.status == "failed" and none.mismatches > 0 and none.CustomerReady == 0


def test_evidence_payload(spark):
    rows = [(1, 1, 0.5, "d1", "s", "QAC", None, None, None, None, "t", ["b", "aaa"], "qac", "9"), (1, 2, 0.4, "d1", "s", "QAC", "9", "Manual", "2020-01-01", 0.5, "u", [], "qac", "9"), (1, 3, 0.3, "d2", None, "X", "9", "Manual", "2020-01-01", 0.5, "v", [], "qac", "9")]
    schema = "query_id long, rank int, score double, document_id string, support_id string, product string, version string, source_type string, updated string, confidence double, text string, matched_terms array<string>, asked_product string, asked_version string"
    items = evidence.payload_items(spark.createDataFrame(rows, schema), 2, "2024-01-01", 365)
    got = {r.document_id: r for r in items.collect()}
    assert set(got) == {"d1", "d2"} and got["d1"].selection_reason == "検索順位1位、スコア0.500000。製品一致=True、バージョン一致=False、キーワード一致=2件。"
    assert got["d1"].source_type == "Unknown" and len(got["d1"].open_texts) == 3 and len(got["d2"].warning_texts) == 2
    text = evidence.payloads(items, spark.createDataFrame([(1, "q")], "query_id long, query string")).first().payload
    assert text.startswith('{"query":"q","selectedEvidence":[{"sourceType":"Unknown","documentId":"d1"') and '"keywordMatches":["aaa","b"]' in text
