"""The sentence of a text that says most: of past cases, and as evidence for a how-to question.

Sentences are cut, scored and compared within the row of their text, so a text of any length gives one row; the best of
a query's sources is a minimum over them, taken on the map side first.

Defined cases: a null or blank text, and one without a fitting sentence, gives null; equal scores go to the shorter sentence,
of past cases then to the earlier place, as evidence then to the earlier source and the sentence that sorts first; repeated rows are rows; null terms are no terms; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import has_any

# Where sentences end, what marks administrative text, actions and worth, and the scores.
PAST_END, PAST_TRIM = r"[。．!！?？]\s*|\s{2,}", r"^[ 、。\-_*]+|[ 、。\-_*]+$"
SENTENCE_END = r"(?<=[。！？])\s*|(?<=[.!?])\s+(?=[A-Z0-9])"
ADMINISTRATIVE = ["いつもお世話になっております", "よろしくお願いいたします", "技術サポート担当", "e-mail", "受付", "件名"]
ACTIONS = ["対応内容", "回答内容", "回答案", "返信案", "確認結果", "対応済", "対応しました", "送付", "添付", "アップロード", "キュー追加", "ご案内", "案内しました", "解決", "クローズ", ".zip", ".pdf"]
WORTH = [(40, ["対応", "回避", "設定", "確認", "原因"]), (35, ["qac", "cxsast", "validate", "hotfix", "ep", "hf", "コンパイラ"])]
LEAST_SIZE, MOST_SIZE_SCORE = 12, 120
ANALYSIS = ["解析", "analyze", "analysis"]
LONGEST, LONG, LONG_COST = 480, 320, 8
BASE, PER_TERM, FOR_ANALYSIS = 10, 4, 8
BY_TYPE = {"officialdoc": 3, "manual": 2}
GUI_NOT = ["validate", "アップロード", "ライセンス", "license", "環境変数"]
GUI_ACTIONS = ["クリック", "選択", "メニュー", "ダイアログ", "qagui", "qa·gui", "gui", "ideから", "analyze project", "run analysis"]
GUI_RUN, PER_ACTION, FOR_RUN = ["実行", "開始", "確認", "run"], 8, 6

Scored = "struct<less:int,size:int,place:int,sentence:string>"


def best_of(sentences: Column, score, placed: bool = True) -> Column:
    """The struct (less, size, place, sentence) of the sentence of the greatest score, then of the fewest characters, then the
    first by place or, unless ``placed``, in the order of texts; ``score`` is a function of a sentence, and null leaves it out."""

    def told(s: Column, i: Column) -> Column:
        last = [i.alias("place"), s.alias("sentence")]
        return F.struct((-score(s)).cast("int").alias("less"), F.char_length(s).alias("size"), *(last if placed else last[::-1]))

    scored = F.transform(sentences, lambda s, i: F.when(score(s).isNotNull(), told(s, i)))
    return F.array_min(F.filter(scored, lambda x: x.isNotNull()))


def past_case_sentence(text: Column, action: bool = False) -> Column:
    """The sentence of a past case that is worth most, of twelve characters or more and not administrative; with ``action`` only
    of those that say what was done."""
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), PAST_END), lambda s: F.regexp_replace(s, PAST_TRIM, ""))

    def score(s: Column) -> Column:
        lower = F.lower(s)
        fits = (F.char_length(s) >= LEAST_SIZE) & ~has_any(lower, ADMINISTRATIVE)
        if action:
            fits = fits & has_any(lower, ACTIONS)
        worth = sum((F.when(has_any(lower, words), n).otherwise(0) for n, words in WORTH), F.least(F.char_length(s), F.lit(MOST_SIZE_SCORE)))
        return F.when(fits, worth)

    return best_of(sentences, score)["sentence"]


def sentences_of(text: Column) -> Column:
    """The sentences of a text with white space joined, of 480 characters at most."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, SENTENCE_END), lambda s: F.trim(s)), lambda s: (s != "") & (F.char_length(s) <= LONGEST))


def _source_worth(s: Column, source_type: Column, place: Column) -> Column:
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    by_type = F.when(kind == "officialdoc", BY_TYPE["officialdoc"]).when(kind == "manual", BY_TYPE["manual"]).otherwise(0)
    return by_type - place - F.when(F.char_length(s) > LONG, LONG_COST).otherwise(0)


def evidence_score(s: Column, terms: Column, excluded: Column, source_type: Column, place: Column, analysis: bool = False) -> Column:
    """What a sentence is worth as evidence: null unless it has a term and no excluded one (and tells of an analysis, if it
    must) and the score is above 0."""
    lower = F.lower(s)
    among = lambda words: F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda t: F.contains(lower, F.lower(t)))
    tells = has_any(lower, ANALYSIS)
    score = BASE + PER_TERM * F.size(among(terms)) + F.when(tells, FOR_ANALYSIS).otherwise(0) + _source_worth(s, source_type, place)
    able = (F.size(among(terms)) > 0) & (F.size(among(excluded)) == 0) & (score > 0)
    return F.when(able & tells if analysis else able, score)


def gui_score(s: Column, source_type: Column, place: Column) -> Column:
    """What a sentence is worth as an instruction for the window: null unless it tells of an analysis and an action there."""
    lower = F.lower(s)
    actions = sum((F.contains(lower, F.lit(w)).cast("int") for w in GUI_ACTIONS), F.lit(0))
    score = PER_ACTION * actions + F.when(has_any(lower, GUI_RUN), FOR_RUN).otherwise(0) + _source_worth(s, source_type, place)
    return F.when(has_any(lower, ANALYSIS) & ~has_any(lower, GUI_NOT) & (actions > 0) & (score > 0), score)


def best_sentences(sources: DataFrame, score=None, analysis: bool = False) -> DataFrame:
    """(query_id, sentence, score, source): the best sentence of each query's sources (query_id, source_index, source_type, text,
    and terms and excluded unless ``score``, a function of a sentence, is given). Queries without one are left out."""
    of = score or (lambda s: evidence_score(s, F.col("terms"), F.col("excluded"), F.col("source_type"), F.col("source_index"), analysis))
    rows = sources.select("query_id", "source_index", best_of(sentences_of(F.col("text")), of, placed=False).alias("_b")).filter("_b IS NOT NULL")
    order = F.struct(F.col("_b.less").alias("less"), F.col("_b.size").alias("size"), "source_index", F.col("_b.sentence").alias("sentence"))
    best = rows.groupBy("query_id").agg(F.min(order).alias("_m"))
    return best.select("query_id", F.col("_m.sentence").alias("sentence"), (-F.col("_m.less")).alias("score"), F.col("_m.source_index").alias("source"))
