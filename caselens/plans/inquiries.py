"""Queries on inquiries: what they are about, and which evidence speaks to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators import inquiry, sentences
from caselens.scratch import written

from .retrieval import asked, documents, read


def _inquiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as mails: greetings, markers, versions, dates and steps stand around them by their numbers."""
    n, turn = F.coalesce("conv_id", F.lit(0)), F.coalesce("turn", F.lit(0))
    text = F.concat(
        F.when(turn % 3 == 0, "いつもお世話になっております。\nサポートチーム\n").otherwise(""),
        F.when(n % 5 == 0, "【質問】 ").when(n % 5 == 1, "質問: 件名 ").otherwise(""),
        F.coalesce("text", F.lit("")),
        F.lit("\nQAC "), (n % 9).cast("string"), F.lit("."), turn.cast("string"), F.lit(" と ["), turn.cast("string"), F.lit(".1] 2024."), (turn + 1).cast("string"), F.lit(".3 (v10.2) TEL 03-1234-5678 a@b"),
        F.when(n % 4 == 0, "\n権限が不十分 latest release の最新バージョン").when(n % 4 == 1, "\nポート 22 と port に接続\n設定手順").otherwise("\n何卒よろしくお願いします"),
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def inquiry_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inquiry.focused(_inquiries(spark, sf_dir))
    listed = [F.array_join(c, "|").alias(c) for c in ("important_terms", "excluded_terms", "target_versions", "fresh_words")]
    return found.select("conv_id", "turn", "focus_text", "fresh", *listed)


def relevant_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` as inquiries against all ``documents``: how many terms each shares with which."""
    inquiries = written(inquiry.focused(asked(spark, sf_dir).withColumnRenamed("query", "text")), "inquiries")
    evidence = documents(spark, sf_dir).select(F.col("doc_id").alias("evidence_id"), "text")
    return inquiry.relevant(inquiries, evidence)[0]


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BARE = r"regexp_replace(lower({}), '[\s\p{{P}}\p{{S}}]', '', 'g')"
_NAME = "'[a-zA-Z0-9][a-zA-Z0-9._:/+-]+'"
_SPLIT = r"""'[\s、。．，,;；:：\[\]【】（）()<>＜＞"''`]+'"""
_CONTACT = r"'(?i)(?:^|\b)(?:tel|e-?mail|fax)\b|〒|\d{2,4}-\d{2,4}-\d{3,4}'"
_KANA = "'[぀-ヿ㐀-鿿]'"


def _bare_list(words: list[str]) -> str:
    return _list([inquiry.bare_word(w) for w in words])


def _any(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda w: contains({text}, w))) > 0"


def _held(words: list[str]) -> str:
    whole = "contains(' ' || flat || ' ', ' ' || w.b || ' ')"
    pairs = "[" + ", ".join(f"{{'w': '{w}', 'b': '{inquiry.bare_word(w)}'}}" for w in words) + "]"
    return f"list_transform(list_filter({pairs}, lambda w: CASE WHEN w.b = 'ポート' THEN {whole} OR contains(flat, 'ポート番号') WHEN w.b = 'port' THEN {whole} ELSE contains(flat, w.b) END), lambda w: w.w)"


def focus_sql(source: str, key: str) -> str:
    """CTEs down to ``focus`` (key, focus_text, versions, important, flat) for rows (key, t) of ``source``."""
    marker = " ".join(f"WHEN strpos(lower(t), '{m}') > 0 THEN substr(t, strpos(lower(t), '{m}') + {len(m)})" for m in inquiry.SECTION_MARKERS)
    keep = f"""regexp_matches(x, {_NAME}) OR {_any("x", _list(inquiry.REQUEST_WORDS))} OR (length({_BARE.format("x")}) > 2 AND NOT ({_any(_BARE.format("x"), _bare_list(inquiry.STOP_WORDS))}
               AND NOT {_any(_BARE.format("x"), _bare_list(inquiry.KNOWN_TERMS))}))"""
    score = f"CASE WHEN regexp_matches(t, {_NAME}) THEN 85 WHEN regexp_matches(t, {_KANA}) THEN CASE WHEN length(t) >= 4 THEN 70 ELSE 45 END WHEN length(t) >= 4 THEN 55 ELSE 20 END"
    entry = "{{'s': -({s}), 'z': -length({t}), 't': {t}}}"
    fits = f"""{_BARE.format("t")} <> '' AND NOT list_contains({_bare_list(inquiry.STOP_WORDS)}, {_BARE.format("t")}) AND NOT contains(t, '@') AND NOT regexp_matches(t, {_CONTACT})
               AND NOT (regexp_matches(t, {_KANA}) AND length(t) > 24)"""
    return rf"""lines AS (SELECT {key}, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '' AND ({keep})) AS kept FROM ({source})),
        cut AS (SELECT {key}, {_TRIM.format(f"CASE {marker} WHEN len(kept) > 0 THEN array_to_string(kept, chr(10)) ELSE t END")} AS focus_text FROM lines),
        numbers AS (
            SELECT *, regexp_extract_all(' ' || regexp_replace(focus_text, '([^0-9.])', '\1\1', 'g') || ' ', '[^0-9.][0-9]{{1,4}}(?:\.[0-9]{{1,4}}){{1,3}}[^0-9.]') AS found,
                   list_filter(string_split_regex(focus_text, {_SPLIT}), lambda x: length(x) >= 2) AS tokens FROM cut),
        plain AS (
            SELECT {key}, focus_text, tokens, array_to_string(list_transform(tokens, lambda x: {_BARE.format("x")}), ' ') AS flat,
                   list_filter(list_transform(list_filter(found, lambda x: NOT (x[1] IN ('[', '［', '(', '（') AND (x[-1] IN (']', '］', ')', '）') OR regexp_matches(x[-1], '\s')))), lambda x: x[2:-2]),
                       lambda v: NOT (regexp_full_match(v, '[0-9]{{4}}\.[0-9]+\.[0-9]+') AND TRY_CAST(split_part(v, '.', 1) AS INT) BETWEEN 1900 AND 2200
                                      AND TRY_CAST(split_part(v, '.', 2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(split_part(v, '.', 3) AS INT) BETWEEN 1 AND 31)) AS v FROM numbers),
        counted AS (
            SELECT {key}, focus_text, tokens, flat, list_filter(v, lambda x, i: list_position(v, x) = i)[1:8] AS versions, {_held(inquiry.KNOWN_TERMS)} AS known FROM plain),
        scored AS (
            SELECT *, list_transform(list_sort(list_concat(list_concat(
                CASE WHEN contains(flat, '権限') AND contains(flat, '不十分') THEN [{entry.format(s="120", t="'権限不足'")}] ELSE [] END,
                list_transform(known, lambda t: {entry.format(s="100 + length(t)", t="t")})),
                list_transform(list_filter(list_distinct(tokens), lambda t: {fits}), lambda t: {entry.format(s=score, t="t")}))), lambda e: e.t) AS names FROM counted),
        named AS (SELECT *, list_concat(versions, list_filter(names, lambda x, i: list_position(names, x) = i)[1:24]) AS every FROM scored),
        focus AS (SELECT *, list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i)[1:24] AS important FROM named)"""


_MAILS = r"""SELECT conv_id, turn, CASE WHEN b % 3 = 0 THEN 'いつもお世話になっております。' || chr(10) || 'サポートチーム' || chr(10) ELSE '' END
    || CASE WHEN a % 5 = 0 THEN '【質問】 ' WHEN a % 5 = 1 THEN '質問: 件名 ' ELSE '' END || coalesce(text, '') || chr(10) || 'QAC ' || a % 9 || '.' || b || ' と [' || b || '.1] 2024.' || (b + 1) || '.3 (v10.2) TEL 03-1234-5678 a@b'
    || CASE a % 4 WHEN 0 THEN chr(10) || '権限が不十分 latest release の最新バージョン' WHEN 1 THEN chr(10) || 'ポート 22 と port に接続' || chr(10) || '設定手順' ELSE chr(10) || '何卒よろしくお願いします' END AS t
    FROM (SELECT *, coalesce(conv_id, 0) AS a, coalesce(turn, 0) AS b FROM conversations)"""

QUERIES = {
    "inquiry_focus": (
        inquiry_focus,
        f"""WITH {focus_sql(_MAILS, "conv_id, turn")},
            told AS (SELECT *, {_held(inquiry.FRESH_WORDS)} AS fresh_list, {_held(inquiry.STOP_WORDS)} AS idle FROM focus)
            SELECT conv_id, turn, focus_text, len(fresh_list) > 0 AS fresh, array_to_string(important, '|') AS important_terms, array_to_string(idle, '|') AS excluded_terms,
                   array_to_string(versions, '|') AS target_versions, array_to_string(fresh_list, '|') AS fresh_words FROM told""",
    ),
    "relevant_evidence": (
        relevant_evidence,
        f"""WITH {focus_sql("SELECT item_id, coalesce(text, '') AS t FROM benchmark", "item_id")},
            given AS (
                SELECT item_id, list_filter(list_concat(list_concat(versions, important), tokens), lambda t: length(t) >= 2 AND {_BARE.format("t")} <> ''
                       AND NOT list_contains({_bare_list(inquiry.GENERIC_WORDS)}, {_BARE.format("t")})) AS g FROM focus),
            terms AS (SELECT item_id, unnest(list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: lower(y)), lower(x)) = i)[1:32]) AS term FROM given),
            keyed AS (SELECT item_id, {_BARE.format("term")} AS k FROM terms),
            texts AS (SELECT doc_id, {_BARE.format("coalesce(text, '')")} AS t FROM documents),
            hits AS (SELECT doc_id, k FROM texts JOIN (SELECT DISTINCT k FROM keyed) ON contains(t, k))
            SELECT item_id AS query_id, doc_id AS evidence_id, count(*) AS matched, bool_or(length(k) >= 5 OR list_contains({_list(inquiry.SHORT_STRONG)}, k)) AS strong
            FROM hits JOIN keyed USING (k) GROUP BY ALL HAVING strong OR matched >= 2""",
    ),
}


def _past_text():
    """Turns as notes of past cases: full stops become Japanese ones; what was done stands where their numbers say."""
    n, turn = F.coalesce("conv_id", F.lit(0)), F.coalesce("turn", F.lit(0))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("。"))
    return F.concat(
        F.when(turn % 2 == 0, "いつもお世話になっております。").otherwise("受付  "), text,
        F.when(n % 3 == 0, "。-* 対応内容 QAC の設定を確認しました *").when(n % 3 == 1, "!patch.ZIP を送付 hotfix。").otherwise(""),
    )


def past_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _past_text()
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", sentences.past_case_sentence(text).alias("useful"), sentences.past_case_sentence(text, action=True).alias("action"))


def how_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each conversation's answers that best speaks to the long words of its first question."""
    rows = read(spark, sf_dir, "conversations")
    first = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    words = F.array_sort(F.array_distinct(F.filter(F.split("question", r"[\s.,]+"), lambda w: F.char_length(w) >= 4)))
    asked_for = first.select("conv_id", words.alias("terms"), F.array(F.lit("worthless"), F.lit("trash")).alias("excluded"))
    answers = rows.filter("role = 'assistant'").select("conv_id", F.col("turn").cast("int").alias("source_index"), F.element_at(F.array(F.lit("OfficialDoc"), F.lit("Manual"), F.lit("Other")), (F.col("turn") % 3 + 1).cast("int")).alias("source_type"), "text")
    sources = answers.join(asked_for, "conv_id").withColumnRenamed("conv_id", "query_id")
    return sentences.best_sentences(sources)


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


_PAST = r"""SELECT conv_id, turn, CASE WHEN b % 2 = 0 THEN 'いつもお世話になっております。' ELSE '受付  ' END || replace(coalesce(text, ''), '. ', '。')
    || CASE a % 3 WHEN 0 THEN '。-* 対応内容 QAC の設定を確認しました *' WHEN 1 THEN '!patch.ZIP を送付 hotfix。' ELSE '' END AS t
    FROM (SELECT *, coalesce(conv_id, 0) AS a, coalesce(turn, 0) AS b FROM conversations)"""
_WORTH = "least(length(x), 120) + " + " + ".join(f"CASE WHEN {_has('x', words)} THEN {n} ELSE 0 END" for n, words in sentences.WORTH)
_EACH = "list_filter({list}, lambda x: {test})"
_BEST = "list_transform({list}, lambda x, i: {{'less': -({score}), 'size': length(x), 'place': i, 's': x}})"

QUERIES |= {
    "past_sentences": (
        past_sentences,
        rf"""WITH p AS ({_PAST}),
            s AS (SELECT conv_id, turn, list_transform(string_split_regex(t, '[。．!！?？]\s*|\s{{2,}}'), lambda x: regexp_replace(x, '^[ 、。_*-]+|[ 、。_*-]+$', '', 'g')) AS s FROM p),
            u AS (SELECT conv_id, turn, {_EACH.format(list="s", test=f"length(x) >= 12 AND NOT {_has('x', sentences.ADMINISTRATIVE)}")} AS u FROM s),
            v AS (SELECT *, {_EACH.format(list="u", test=_has("x", sentences.ACTIONS))} AS a FROM u)
            SELECT conv_id, turn, list_min({_BEST.format(list="u", score=_WORTH)}).s AS useful, list_min({_BEST.format(list="a", score=_WORTH)}).s AS action FROM v""",
    ),
    "how_to_sentences": (
        how_to_sentences,
        rf"""WITH q AS (
                SELECT conv_id, list_distinct(list_filter(string_split_regex(arg_min(text, turn), '[\s.,]+'), lambda w: length(w) >= 4)) AS terms FROM conversations WHERE role = 'user' GROUP BY conv_id),
            a AS (
                SELECT conv_id, turn, terms, unnest(string_split(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([。！？])\s*', '\1' || chr(10), 'g'),
                       '([.!?])\s+([A-Z0-9])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS raw FROM conversations JOIN q USING (conv_id) WHERE role = 'assistant'),
            s AS (SELECT conv_id, turn, trim(raw) AS x, len(list_filter(terms, lambda t: contains(lower(trim(raw)), lower(t)))) AS hits FROM a WHERE length(trim(raw)) BETWEEN 1 AND 480),
            r AS (
                SELECT *, 10 + 4 * hits + CASE WHEN {_has("x", sentences.ANALYSIS)} THEN 8 ELSE 0 END + CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END - turn - CASE WHEN length(x) > 320 THEN 8 ELSE 0 END AS score
                FROM s WHERE hits > 0 AND NOT {_has("x", ["worthless", "trash"])})
            SELECT conv_id AS query_id, x AS sentence, score::INTEGER AS score, turn::INTEGER AS source FROM r WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, length(x), turn, x) = 1""",
    ),
}
