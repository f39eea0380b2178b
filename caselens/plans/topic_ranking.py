"""Queries that rank the best chunks of ``benchmark`` passages by topic, choose among them and tell what the choice lacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators import aliases, coverage, selection, topic_rank, topics
from caselens.scratch import written

from .catalogs import _COMPARABLE, _MARKED, _WORDS, _pairs_of_words
from .ranking import _CANDIDATES, _candidates
from .retrieval import read

#: What stands behind a candidate's text, by the number of its document, and behind a question, by its own.
EVIDENCE = ["overview of the definition", "used for a purpose", "configure step by step", "link the project", "verify the status", "qacli validate build --force upload to the portal, confirm", "Brand#11 and Brand#21", "version 9.2.1", "9.3"]
QUESTIONS = ["what is Brand#11", "how to configure the procedure", "validate upload command how to", "version 9.2 --force", ""]


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are the beginnings of passages, components those of one word by a number, products the parts' brands."""
    items = _pairs_of_words(read(spark, sf_dir, "benchmark"), "text").select(F.lit("features").alias("dimension"), F.lower(F.split("alias", " ")[1]).alias("name"), "alias")
    fixed = spark.createDataFrame([("components", "Validate", "validate"), ("features", "Build upload", "validate build")], aliases.CATALOG)
    parts = read(spark, sf_dir, "part").select(F.lit("products").alias("dimension"), F.col("p_brand").alias("name"), F.col("p_brand").alias("alias"))
    return items.unionByName(fixed).unionByName(parts)


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    n, d = F.col("query_id").cast("long"), F.col("document_id")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    question = F.concat_ws(" ", "query", at(QUESTIONS, n))
    text = F.concat_ws(" ", "text", at(EVIDENCE, d), at(EVIDENCE, d + 3))
    rows = rows.select(
        "query_id", "candidate_id", F.col("rank").cast("long").alias("original_rank"), question.alias("question"), text.alias("text"), F.col("relative").alias("base_score"), at(["OfficialDoc", "Manual", "PastCaseNote"], d).alias("source_type"),
        d.cast("string").alias("document_id"), F.col("chunk_index").cast("string").alias("section"), F.when(n % 3 == 0, " brand#11").alias("requested_product"), F.when(d % 4 > 0, F.concat(F.lit("Brand #1"), (d % 2 + 1).cast("string"))).alias("product_name"),
        F.when(n % 2 == 0, "v9.2").alias("requested_version"), F.when(d % 5 == 0, F.concat(F.lit("9."), (d % 3 + 1).cast("string"))).alias("version"), selection.technical_tokens(at(QUESTIONS, n)).alias("technical_tokens"),
        (d % 11 == 0).alias("excluded"), (d % 13 == 0).alias("manually_selected"), aliases.comparable(text).alias("folded"),
    )
    rows = written(rows, "topic-candidates")
    catalog = _catalog(spark, sf_dir)
    asked = topics.profiled(rows.select("query_id", "question").distinct(), "query_id", "question", catalog, "query_profile").select("query_id", "query_profile")
    keyed = rows.withColumn("_key", F.concat_ws("/", "query_id", "candidate_id"))
    return written(topic_rank.assessed(topics.profiled(keyed, "_key", "text", catalog).drop("_key").join(asked, "query_id")), "topic-assessed")


def topic_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir)
    joined = [F.array_join(c, ",").alias(c) for c in ("conflict_kinds", "covers")]
    return rows.select("query_id", "candidate_id", "topic_score", F.round("entity_score", 6).alias("entity_score"), "final_score", "has_topic_match", "product_match", "version_match", *joined)


def topic_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = topic_rank.chosen(_assessed(spark, sf_dir))
    return picks.select("query_id", "candidate_id", "pick", "score", F.array_join("covered", ",").alias("covered"))


def topic_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each query's choice by topic falls short, and what a choice by coverage would need and not find."""
    rows = _assessed(spark, sf_dir)
    reasons = topic_rank.insufficient_reasons(rows, topic_rank.chosen(rows))
    candidates = written(topic_rank.adapted(rows), "adapted")
    needs = rows.groupBy("query_id").agg(F.any_value("question").alias("question"), F.any_value("query_profile").alias("p"))
    needed = needs.select("query_id", coverage.required(F.col("question"), F.col("p")).alias("required_coverage"))
    picks = selection.coverage_selection(candidates, needed, least=0.2)
    told = topic_rank.coverage_shortfalls(candidates, needed, picks).join(reasons, "query_id")
    return told.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("reasons", "needed", "not_found")))


def _at(values: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({i}) % {len(values)} + 1]"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _named(text: str, names: dict[str, list[str]]) -> str:
    """The names of which a marked text has a word: ASCII ones stand between other characters than letters and digits."""

    def test(words: list[str]) -> str:
        plain = [w for w in words if w.isascii()]
        marked = [f"contains(m_{text}, {_MARKED.format(chr(39) + w + chr(39))})" for w in plain]
        return " OR ".join(marked + [f"contains(t_{text}, '{w}')" for w in words if not w.isascii()])

    return "list_filter([" + ", ".join(f"CASE WHEN {test(words)} THEN '{name}' END" for name, words in names.items()) + "], lambda x: x IS NOT NULL)"


def _profile(side: str) -> str:
    kinds = ", ".join(f"coalesce(list(DISTINCT name ORDER BY name) FILTER (dimension = '{d}'), []) AS {side}_{d}" for d in ("products", "components", "features"))
    return f"SELECT k, {kinds} FROM hits JOIN entries USING (alias) WHERE side = '{side}' GROUP BY k"


_OVERLAP = "(len(list_intersect(q_{d}, e_{d})) > 0)"
_SHARE = "CASE WHEN len(q_{d}) > 0 THEN len(list_intersect(q_{d}, e_{d})) / len(q_{d}) ELSE 0 END"


def _weighted(parts: list[tuple[float, str, str]]) -> str:
    top = " + ".join(f"CASE WHEN {applies} THEN {w} * least(1, greatest(0, {score})) ELSE 0 END" for w, score, applies in parts)
    return f"(({top}) / (" + " + ".join(f"CASE WHEN {applies} THEN {w} ELSE 0 END" for w, _, applies in parts) + "))"


_S = topics.SCORE
_SHARES = {d: _SHARE.format(d=d) for d in ("features", "components", "operations", "intents", "entities")}
_TOPIC = [(_S["features"], _SHARES["features"], "len(q_features) > 0"), (_S["components"], _SHARES["components"], "len(q_components) > 0"), (_S["product"], "CASE WHEN pm THEN 1 ELSE 0 END", "pm IS NOT NULL")]
_WEIGHTS = [
    *_TOPIC, (_S["entities"], _SHARES["entities"], "len(q_entities) > 0"), (_S["operations"], _SHARES["operations"], "len(q_operations) > 0"), (_S["intents"], _SHARES["intents"], "len(q_intents) > 0"),
    (_S["technical"], "CASE WHEN len(tokens) > 0 THEN held / len(tokens) ELSE 0 END", "len(tokens) > 0"), (_S["trust"], "trust", "true"), (_S["version"], "CASE vm WHEN 'exact' THEN 1 WHEN 'near' THEN 0.5 ELSE 0 END", "vm <> 'not_requested'"),
    (_S["base"], "base", "true"),
]
#: The last part stands for a question without any, whose score is 0.
_TOPICS = [*_TOPIC, (_S["operations"], _SHARES["operations"], "len(q_operations) > 0"), (1e-12, "0", "true")]
_COMMAND = _any("t_e", topic_rank.COMMAND_WORDS)
_COVERS = [(k, f"feature AND {_any('t_e', words)}") for k, words in topic_rank.FEATURE_ITEMS.items()] + [
    ("U-A", f"up AND {_COMMAND} AND {_any('t_e', topic_rank.UPLOAD_WORDS)}"), ("U-B", f"up AND (regexp_matches(text, '(^|[^A-Za-z0-9_])--[A-Za-z0-9]') OR {_any('t_e', topic_rank.OPTION_WORDS)})"),
    ("U-C", f"up AND {_any('t_e', topic_rank.UPLOAD_ITEMS['U-C'])}"), ("U-D", f"up AND {_any('t_e', topic_rank.UPLOAD_ITEMS['U-D'])}"), ("U-E", f"up AND ({_COMMAND} OR {_any('t_e', topic_rank.RUN_WORDS)})"),
    ("U-F", f"up AND contains(t_e, 'validate') AND {_any('t_e', topic_rank.SHOWN_WORDS)}"), ("U-G", f"up AND {_any('t_e', topic_rank.UPLOAD_ITEMS['U-G'])}"),
]
_CONFLICTS = ", ".join(f"CASE WHEN len(q_{d}) > 0 AND len(e_{d}) > 0 AND NOT {_OVERLAP.format(d=d)} THEN '{n}' END" for d, n in (("products", "Product"), ("components", "Component"), ("features", "Feature")))
#: The entities that questions can have, with the texts that have them too.
_ENTITIES = "list_filter([CASE WHEN regexp_matches({t}, '(^|[^A-Za-z0-9_.])9\\.2($|[^A-Za-z0-9_.])') THEN 'version:9.2' END, CASE WHEN regexp_matches({t}, '(^|[^A-Za-z0-9_])--force($|[^A-Za-z0-9_-])') THEN 'option:--force' END], lambda x: x IS NOT NULL)"
_TOKENS = [sorted({t for pattern in (r"--[A-Za-z0-9][A-Za-z0-9_-]*", r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_.+#/-]{2,}(?![A-Za-z0-9_])") for t in re.findall(pattern, q.lower()) if t not in selection.IGNORED_TOKENS}) for q in QUESTIONS]
_ASSESSED = rf"""{_CANDIDATES},
    ids AS (SELECT query_id::VARCHAR AS q, document_id AS d, chunk_index AS c, rank AS r, round(score / max(score) OVER (PARTITION BY query_id), 6) AS base FROM bm25_ranks WHERE rank <= 20),
    rows AS (
        SELECT ids.*, lpad(d::VARCHAR, 12, '0') || '-' || ids.c AS id, concat_ws(' ', x.text, {_at(EVIDENCE, "d")}, {_at(EVIDENCE, "d + 3")}) AS text, concat_ws(' ', b.text, {_at(QUESTIONS, "q::BIGINT")}) AS question,
               [{", ".join("[" + ", ".join(f"'{t}'" for t in ts) + "]::VARCHAR[]" for ts in _TOKENS)}][q::BIGINT % {len(QUESTIONS)} + 1] AS tokens,
               CASE WHEN d % 4 > 0 AND q::BIGINT % 3 = 0 THEN d % 2 + 1 = 1 END AS pm, q::BIGINT % 2 = 0 AS versioned, CASE WHEN d % 5 = 0 THEN '9.' || d % 3 + 1 END AS version, [1.0, 0.88, 0.56][d % 3 + 1] AS trust, d % 11 = 0 AS shunned, d % 13 = 0 AS manual
        FROM ids JOIN chunks x ON x.document_id = d AND x.chunk_index = ids.c JOIN benchmark b ON b.item_id = q::BIGINT),
    items AS (SELECT DISTINCT {_WORDS} AS alias FROM benchmark),
    catalog AS (SELECT 'features' AS dimension, lower(split_part(alias, ' ', 2)) AS name, alias FROM items WHERE alias <> '' UNION SELECT 'components', 'Validate', 'validate' UNION SELECT 'features', 'Build upload', 'validate build'
                UNION SELECT 'products', p_brand, p_brand FROM part),
    named AS (SELECT * FROM catalog UNION SELECT dimension, name, name FROM catalog),
    entries AS (SELECT DISTINCT dimension, name, {_COMPARABLE.format("alias")} AS alias FROM named),
    known AS (SELECT DISTINCT alias, regexp_full_match(alias, '[a-z0-9](.*[a-z0-9])?') AS bounded, {_MARKED.format("alias")} AS marked FROM entries WHERE alias <> ''),
    sides AS (SELECT DISTINCT 'q' AS side, q AS k, {_COMPARABLE.format("question")} AS t FROM rows UNION ALL SELECT 'e', q || '/' || id, {_COMPARABLE.format("text")} FROM rows),
    marked AS (SELECT *, {_MARKED.format("t")} AS m FROM sides),
    hits AS (SELECT DISTINCT side, k, alias FROM marked JOIN known ON CASE WHEN bounded THEN contains(m, marked) ELSE contains(t, alias) END),
    qp AS ({_profile("q")}), ep AS ({_profile("e")}),
    full_rows AS (
        SELECT r.*, qm.t AS t_q, qm.m AS m_q, em.t AS t_e, em.m AS m_e, {", ".join(f"coalesce({s}_{d}, []) AS {s}_{d}" for s in "qe" for d in ("products", "components", "features"))}
        FROM rows r JOIN marked qm ON qm.side = 'q' AND qm.k = r.q JOIN marked em ON em.side = 'e' AND em.k = r.q || '/' || id LEFT JOIN qp ON qp.k = r.q LEFT JOIN ep ON ep.k = r.q || '/' || id),
    acted AS (
        SELECT *, {", ".join(f"{_named(s, names)} AS {s}_{n}" for s in "qe" for n, names in (("operations", topics.OPERATIONS), ("intents", topics.INTENTS)))},
               {_ENTITIES.format(t="question")} AS q_entities, {_ENTITIES.format(t="text")} AS e_entities, len(list_filter(tokens, lambda x: contains(t_e, x))) AS held,
               regexp_extract(coalesce(version, ' ' || regexp_replace(text, '([^A-Za-z0-9_.])', '\1\1', 'g') || ' '), '(?i)(?:^|[^A-Za-z0-9_.])v?(\d+(?:\.\d+){{1,3}})(?:$|[^A-Za-z0-9_.])', 1) AS num FROM full_rows),
    matched AS (
        SELECT *, {_OVERLAP.format(d="features")} OR (len(q_features) = 0 AND {_OVERLAP.format(d="components")}) OR (len(q_features) = 0 AND len(q_components) = 0 AND {_OVERLAP.format(d="products")}) AS topic,
               list_filter([{_CONFLICTS}], lambda x: x IS NOT NULL) AS kinds, list_contains(q_features, 'Build upload') OR (list_contains(q_operations, 'Upload') AND list_contains(q_components, 'Validate')) AS up_question,
               CASE WHEN NOT versioned THEN 'not_requested' WHEN num = '' THEN 'unknown' WHEN num = '9.2' THEN 'exact' WHEN split_part(num, '.', 1) = '9' AND split_part(num, '.', 2) = '2' THEN 'near' ELSE 'mismatch' END AS vm FROM acted),
    scored AS (
        SELECT *, len(q_features) > 0 AND len(e_features) > 0 AND topic AS feature, up_question AND len(kinds) = 0 AS up, round({_weighted(_TOPICS)}, 6) AS topic_score,
               {_SHARES["entities"]} AS entity_score,
               round(least(1, greatest(0, {_weighted(_WEIGHTS)} - CASE WHEN NOT pm THEN 0.65 ELSE 0 END
                   - CASE WHEN list_contains(kinds, 'Feature') THEN 0.55 WHEN list_contains(kinds, 'Component') THEN 0.30 WHEN (len(q_features) > 0 OR len(q_components) > 0) AND NOT topic THEN 0.20 ELSE 0 END
                   - CASE WHEN vm = 'mismatch' THEN 0.18 ELSE 0 END - CASE WHEN shunned AND NOT manual THEN 0.90 ELSE 0 END)), 6) AS final FROM matched),
    assessed AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in _COVERS)}], lambda x: x IS NOT NULL) AS covers FROM scored),
    able AS (SELECT * FROM assessed WHERE manual OR (coalesce(pm, true) AND len(kinds) = 0))"""


def _rounds() -> str:
    out = ["p0 AS (SELECT DISTINCT q, []::VARCHAR[] AS covered, []::VARCHAR[] AS seen FROM able)"]
    for n in range(1, 6):
        out.append(
            f"""p{n} AS (
                SELECT q, b.id AS id, b.final AS score, list_distinct(list_concat(b.covered, b.covers)) AS covered, list_append(b.seen, b.t_e) AS seen FROM (
                    SELECT q, arg_max({{'id': able.id, 'final': final, 'covers': covers, 'covered': covered, 'seen': seen, 't_e': t_e}},
                           {{'v': round(final + 0.06 * len(list_filter(covers, lambda x: NOT list_contains(covered, x))), 6), 't': topic_score, 'e': entity_score, 'b': base, 'r': -r, 'i': able.id}}) AS b
                    FROM able JOIN p{n - 1} USING (q) WHERE NOT list_contains(seen, t_e) GROUP BY q))"""
        )
    out.append("picks AS (" + " UNION ALL ".join(f"SELECT q, id, {n} AS pick, score, covered FROM p{n}" for n in range(1, 6)) + ")")
    return ",\n    ".join(out)


_CHOICE = f"{_ASSESSED},\n    {_rounds()}"
_REASONS = f"""{_CHOICE},
    sets AS (SELECT q, arg_max(covered, pick) AS covered, count(*) AS n FROM picks GROUP BY q),
    told AS (
        SELECT a.q, any_value(q_features) AS f, any_value(q_components) AS c, any_value(q_intents) AS i, any_value(up_question) AS up, any_value(versioned) AS versioned, any_value(question) AS question, any_value(q_operations) AS ops,
               coalesce(bool_or(topic) FILTER (p.id IS NOT NULL), false) AS topic, bool_or(len(kinds) > 0) AS conflict, bool_and(coalesce(NOT pm, false)) AS other, max(final) FILTER (p.id IS NOT NULL) AS best,
               coalesce(bool_or(vm IN ('exact', 'near')) FILTER (p.id IS NOT NULL), false) AS near, count(DISTINCT version) FILTER (p.id IS NOT NULL) AS versions
        FROM assessed a LEFT JOIN picks p ON p.q = a.q AND p.id = a.id GROUP BY a.q),
    full_told AS (SELECT told.*, coalesce(covered, []) AS covered, coalesce(n, 0) AS n FROM told LEFT JOIN sets USING (q)),
    flagged AS (
        SELECT *, list_contains(i, 'HowTo') OR list_contains(i, 'Configuration') AS setup, list_contains(ops, 'Upload') OR list_contains(f, 'Build upload') OR (contains(lower(question), 'validate') AND contains(lower(question), 'upload')) AS needs_upload,
               list_contains(f, 'Stream') AS needs_stream FROM full_told),
    reasons AS (
        SELECT *, concat_ws(',', CASE WHEN (len(f) > 0 OR len(c) > 0) AND NOT topic THEN 'NoTopicMatch' END, CASE WHEN n = 0 AND conflict THEN 'TopicConflict' END, CASE WHEN other THEN 'ProductMismatch' END,
               CASE WHEN len(f) > 0 AND list_contains(i, 'Overview') AND NOT list_contains(covered, 'A') THEN 'MissingOverview' END,
               CASE WHEN len(f) > 0 AND setup AND NOT list_contains(covered, 'C') THEN 'MissingSetupProcedure' END,
               CASE WHEN len(f) > 0 AND setup AND NOT list_contains(covered, 'E') THEN 'MissingVerification' END, CASE WHEN len(f) > 0 AND len(covered) < 3 THEN 'LowCoverage' END,
               CASE WHEN up AND list_contains(i, 'Command') AND NOT list_contains(covered, 'U-A') THEN 'MissingCommand' END,
               CASE WHEN up AND list_contains(i, 'HowTo') AND NOT (list_contains(covered, 'U-E') AND list_contains(covered, 'U-F')) AND NOT (len(f) > 0 AND setup AND NOT list_contains(covered, 'C')) THEN 'MissingSetupProcedure' END,
               CASE WHEN n > 0 AND best < 0.25 THEN 'LowConfidence' END, CASE WHEN versioned AND n > 0 AND NOT near THEN 'VersionMismatch' END, CASE WHEN versions > 1 THEN 'ConflictingEvidence' END) AS reasons FROM flagged)"""
_OBSERVED = [
    ("Command", r"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])qacli(\s+[A-Za-z0-9_.+/-]+)')"), ("Options", r"(regexp_matches(text, '(^|[^A-Za-z0-9_])--[A-Za-z0-9]') OR " + _any("t_e", coverage.OPTION_WORDS) + ")"),
    *((n, " AND ".join(_any("t_e", words) for words in needs)) for names, needs in coverage.OBSERVED for n in names),
]

QUERIES = {
    "topic_ranking": (
        topic_ranking,
        f"""WITH {_ASSESSED} SELECT q AS query_id, id AS candidate_id, topic_score, round(entity_score, 6) AS entity_score, final AS final_score, topic AS has_topic_match, pm AS product_match, vm AS version_match,
            array_to_string(kinds, ',') AS conflict_kinds, array_to_string(covers, ',') AS covers FROM assessed""",
    ),
    "topic_choice": (topic_choice, f"WITH {_CHOICE} SELECT q AS query_id, id AS candidate_id, pick::INTEGER AS pick, score, array_to_string(list_sort(covered), ',') AS covered FROM picks"),
    "topic_shortfalls": (
        topic_shortfalls,
        f"""WITH {_REASONS},
            needs AS (SELECT q, reasons, CASE WHEN needs_upload THEN [{", ".join(f"'{x}'" for x in coverage.UPLOAD)}] WHEN needs_stream THEN [{", ".join(f"'{x}'" for x in coverage.STREAM)}] ELSE [] END AS needed FROM reasons),
            seen AS (SELECT q, unnest(list_filter([{", ".join(f"CASE WHEN {test} THEN '{n}' END" for n, test in _OBSERVED)}], lambda x: x IS NOT NULL)) AS item FROM assessed),
            found AS (SELECT q, list(DISTINCT item) AS found FROM seen GROUP BY q)
            SELECT q AS query_id, reasons, array_to_string(list_sort(needed), ',') AS needed, array_to_string(list_sort(list_filter(needed, lambda x: NOT list_contains(coalesce(found, []), x))), ',') AS not_found FROM needs LEFT JOIN found USING (q)""",
    ),
}
