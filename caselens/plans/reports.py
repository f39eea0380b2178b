"""Queries on reports, facts of pages, evidence scores and the application's chunks over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators import chunking, coverage, evaluation, facts, selection

from .retrieval import documents, read

METRICS = ["mean_recall_at_k", "mrr", "mean_ndcg_at_k"]


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as configurations of a report, with metrics from their customers."""
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("top_k")).agg(
        F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 4).alias("mean_recall_at_k"), F.round(F.avg((F.col("c_acctbal") > 2000).cast("int")), 4).alias("mrr"), F.round(F.avg((F.col("c_acctbal") > 5000).cast("int")), 4).alias("mean_ndcg_at_k")
    )
    return rows.withColumn("product_confusion_count", (F.col("top_k") % 4).cast("long") - 1)


_REPORT = """r AS (SELECT c_nationkey AS top_k, round(avg((c_acctbal > 0)::INT), 4) AS mean_recall_at_k, round(avg((c_acctbal > 2000)::INT), 4) AS mrr,
    round(avg((c_acctbal > 5000)::INT), 4) AS mean_ndcg_at_k, c_nationkey % 4 - 1 AS product_confusion_count FROM customer GROUP BY c_nationkey),
    b AS (SELECT * FROM r WHERE top_k % 5 > 0), n AS (SELECT top_k, mean_recall_at_k, CASE WHEN top_k % 3 = 0 THEN mrr / 2 WHEN top_k % 3 = 1 THEN mrr ELSE mrr + 0.25 END AS mrr, mean_ndcg_at_k FROM r WHERE top_k % 7 > 0)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _report(spark, sf_dir)
    changed = F.when(F.col("top_k") % 3 == 0, F.col("mrr") / 2).when(F.col("top_k") % 3 == 1, F.col("mrr")).otherwise(F.col("mrr") + 0.25)
    return rows.filter("top_k % 5 > 0"), rows.filter("top_k % 7 > 0").withColumn("mrr", changed)


def regression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _pair(spark, sf_dir)
    return evaluation.status_counts(evaluation.regression(base, new, METRICS, keys=["top_k"]))


def baseline_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _pair(spark, sf_dir)
    blocked = evaluation.readiness(base, new, new.withColumn("mrr", F.col("mrr") + F.when(F.col("top_k") == 1, 0.5).otherwise(0.0)), METRICS, ["top_k"])
    ready = evaluation.readiness(base, base, base.orderBy(F.desc("top_k")), METRICS, ["top_k"])
    return ready.unionByName(blocked).select("status", "reproducible", "missing", "new", "regressed", "improved", "unchanged")


def baseline_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir).withColumn("mrr", F.col("mrr") * 2)
    return evaluation.baseline_violations(rows.unionByName(rows.filter("top_k = 3")))


def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as files: what was to be read and what was, by flags; copies share a hash."""
    rows = read(spark, sf_dir, "lineitem")
    path = F.when(F.col("l_linenumber") == 2, "a.zip!/../x").when(F.col("l_linenumber") == 3, "a.zip!/docs/x.md").when(F.col("l_linenumber") == 4, "plain.txt").otherwise("b.ZIP!/x")
    rows = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), (F.col("l_returnflag") == "N").alias("expected_included"), (F.col("l_linestatus") == "O").alias("actual_included"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("AB")).otherwise(F.lit("ab")), F.col("l_orderkey").cast("string")).alias("sha256"), (F.col("l_linenumber") > 1).alias("is_archive_entry"), path.alias("source_path"),
    )
    return evaluation.ingestion_report(rows)


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return documents(spark, sf_dir).select("doc_id", evaluation.content_fingerprint(text).alias("fingerprint"))


def term_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nation asks for terms; the documents of its number are what was found."""
    docs = documents(spark, sf_dir, "lang", "source").filter("text is not null").select((F.col("doc_id") % 25).alias("query_id"), F.floor(F.col("doc_id") / 25).alias("rank"), "text", F.upper("lang").alias("product"), F.concat(F.lit(" "), F.col("source")).alias("version"))
    cases = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("query_id"), F.when(F.col("n_nationkey") % 3 > 0, "en").alias("product"), F.when(F.col("n_nationkey") % 2 > 0, "web").alias("version"),
        F.when(F.col("n_nationkey") % 4 > 0, F.array(F.lit("The "), F.lit("und"), F.lit("zzzz"), F.lower("n_name"))).alias("required_terms"), F.array(F.lit("QQQQ"), F.lit(" Der ")).alias("excluded_terms"),
    )
    rows = evaluation.term_metrics(docs, cases)
    return rows.select("query_id", F.round("required_term_coverage_at_k", 6).alias("required_term_coverage_at_k"), F.size("required_terms_missing").alias("missing"), F.size("excluded_terms_found").alias("excluded"), "product_confusion_count", "version_mismatch_count")


def evidence_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beside what suppliers' nations ask for: brand as product, size as version."""
    rows = read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("query_id"), "p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("product"), F.when(F.col("p_size") % 5 > 0, (F.col("p_size") % 3).cast("string")).alias("version"),
        F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("20"), F.lpad((F.col("p_size") % 20 + 10).cast("string"), 2, "0"), F.lit("-01-01"))).alias("updated"), F.when(F.col("p_size") % 2 > 0, F.lit(0.5)).alias("confidence"),
        F.when(F.col("p_partkey") % 3 > 0, F.lit(" BRAND#11 ")).alias("asked_product"), F.when(F.col("p_partkey") % 4 > 0, F.lit("1")).alias("asked_version"), F.split("p_name", " ").alias("matched_terms"),
    )
    found = evaluation.annotated(rows, "2026-01-01", 365 * 8)
    return found.select("p_partkey", "product_match", "version_match", "possibly_stale", "possible_conflict", F.array_join("keyword_matches", " ").alias("keywords"), F.array_join("warnings", ",").alias("warnings"), F.array_join("unverified", ",").alias("unverified"))


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as official ones: release notes, engine packs and hotfixes by their number, some of another product."""
    kind, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    title = F.when(kind == 0, F.concat(F.lit("Release Notes for 9."), n, F.lit(".0"))).when(kind == 1, F.lit("Engine Pack")).when(kind == 2, "All Hotfixes").when(kind == 3, "SCA Release Notes 1.2.3").otherwise("Other")
    text = F.concat(F.lit("CxSAST 9."), n, F.lit(".1 and Engine Pack version 9."), n, F.lit(".2, HF"), n, F.lit(" and hf1. "), F.coalesce("html", F.lit("")))
    rows = read(spark, sf_dir, "pages").select(title.alias("title"), F.lit("").alias("section_title"), F.concat(F.lit("u/"), n).alias("url"), text.alias("text"))
    return facts.page_facts(rows).select("key", "value", "url", "title", "confidence")


def catalog_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.concat(F.lit("9."), F.col("p_size").cast("string"), F.lit(".1")).alias("value"), (F.col("p_partkey") % 3).alias("confidence"))
    return facts.resolved(rows, "Candidate").select("key", "value", "status")


def distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_size").cast("string").alias("value"), F.when(F.col("p_partkey") % 2 == 0, "URL").otherwise("url").alias("url"), F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("confidence"))
    return facts.distinct_facts(rows).select("key", "value", F.lower("url").alias("url"), "confidence")


def answer_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: their keys say of which types they are, what they ask for and what is known."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    types = F.when(k % 5 == 0, F.array(F.lit("LatestVersionQuestion"))).when(k % 5 == 1, F.array(F.lit("UpgradePossibilityQuestion"))).when(k % 5 == 2, F.array(F.lit("HowToQuestion"))).otherwise(F.array(F.lit("VersionQuestion")))
    known = lambda key: F.struct(F.lit(key).alias("key"), F.when(k % 3 == 0, "Confirmed").otherwise("Conflict").alias("status"), F.when(k % 2 == 0, "High").otherwise("Low").alias("confidence"))
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", types.alias("types"), F.when(k % 7 > 0, F.array(F.lit(facts.SAST), F.lit("Other"))).otherwise(none).alias("requested"), F.array(known(facts.SAST)).alias("facts"),
        F.when(k % 4 == 0, F.array(F.lit("UpgradePossibility"))).otherwise(none).alias("missing"), F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(none).alias("conflicts"),
    )
    return facts.answer_readiness(rows).select("o_orderkey", "readiness")


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates: version status, source trust and the evidence score."""
    types = ["OfficialDoc", "manual_page", "Manufacturer-Reply", "ExactPastAnswer", "PastCaseNote", "InternalNote", "else"]
    kind = F.element_at(F.array(*map(F.lit, types)), F.col("l_linenumber"))
    asked = F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("9."), (F.col("l_suppkey") % 3).cast("string"), F.lit(".1")))
    actual = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("Version v9."), (F.col("l_partkey") % 3).cast("string"), F.lit("."), (F.col("l_partkey") % 2).cast("string")))
    rows = read(spark, sf_dir, "lineitem").withColumns({"version": selection.version_status(asked, actual), "trust": selection.source_trust(kind)})
    match = F.when(F.col("l_quantity") > 25, F.col("l_quantity") > 35)
    score = selection.evidence_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5), F.col("trust"), F.coalesce(match, F.lit(True)), F.col("version"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "version", "trust", F.round(score, 6).alias("score"))


def observed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's documents cover of the items of uploads and streams."""
    return coverage.group_coverage(documents(spark, sf_dir, "source"), ["source"], "text").select("source", F.array_join("coverage", ",").alias("coverage"))


def app_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("intro\n## First ##\n"), F.coalesce("text", F.lit("")), F.lit("\n#### no\n# Last\n"))
    rows = documents(spark, sf_dir).select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("path"), text.alias("text"))
    return chunking.app_chunks(rows, "path").select("path", "chunk_index", "chunk_id", "section_title", F.char_length("text").alias("n_chars"))


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fields in columns, in their text or nowhere, by their number."""
    kind = F.col("doc_id") % 3
    line = F.element_at(F.split("text", "\n", 2), 1)
    text = F.when(kind == 1, F.concat(F.lit("before\n## 質問： short\n"), line, F.lit("\n原因\n\n回答:\n"), line)).otherwise(F.col("text"))
    rows = documents(spark, sf_dir).filter("text is not null").select("doc_id", F.when(kind == 0, F.concat(F.lit(" "), line)).alias("question"), F.when(kind == 0, F.lit("because")).alias("cause"), F.lit("").alias("resolution"), text.alias("text"))
    return chunking.structured_chunks(rows, "doc_id").select("doc_id", "chunk_index", "chunk_id", "section_title", F.char_length("text").alias("n_chars"))


_STATUS = """SELECT *, CASE WHEN n.top_k IS NULL THEN 'missing' WHEN b.top_k IS NULL THEN 'new' WHEN round(n.mrr - b.mrr, 6) < 0 THEN 'regressed' WHEN round(n.mrr - b.mrr, 6) > 0 THEN 'improved' ELSE 'unchanged' END AS status
    FROM b FULL JOIN n ON b.top_k = n.top_k"""
_TRUST = "[1.0, 0.88, 0.78, 0.7, 0.56, 0.35, 0.45][l_linenumber]::DOUBLE"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + ")"


_OBSERVED = [
    ("Command", r"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])qacli(\s+[A-Za-z0-9_.+/-]+)')"),
    *((n, r"(regexp_matches(text, '(^|[^A-Za-z0-9_])--[A-Za-z0-9]') OR " + _has(coverage.OPTION_WORDS) + ")") for n in ("Options", "Option")),
    *((n, " AND ".join(map(_has, needs))) for names, needs in coverage.OBSERVED for n in names),
]

QUERIES = {
    "regression_counts": (regression_counts, f"WITH {_REPORT} SELECT status, count(*) AS rows FROM ({_STATUS}) GROUP BY status"),
    "baseline_readiness": (
        baseline_readiness,
        f"""WITH {_REPORT}, s AS ({_STATUS}), c AS (SELECT count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'regressed') AS regressed,
                count(*) FILTER (status = 'improved') AS improved, count(*) FILTER (status = 'unchanged') AS unchanged FROM s)
            SELECT 'blocked' AS status, false AS reproducible, * FROM c UNION ALL SELECT 'ready', true, 0, 0, 0, 0, count(*) FROM b""",
    ),
    "baseline_violations": (
        baseline_violations,
        f"""WITH {_REPORT}, v AS (SELECT top_k, mrr * 2 AS mrr, product_confusion_count AS p FROM r UNION ALL SELECT top_k, mrr * 2, product_confusion_count FROM r WHERE top_k = 3)
            SELECT top_k, 'mrr out of range' AS violation FROM v WHERE mrr > 1 UNION ALL SELECT top_k, 'product_confusion_count negative' FROM v WHERE p < 0
            UNION ALL SELECT top_k, 'repeated configuration' FROM v GROUP BY top_k HAVING count(*) > 1""",
    ),
    "ingestion_report": (
        ingestion_report,
        """WITH f AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_returnflag = 'N' AS e, l_linestatus = 'O' AS a, 'ab' || l_orderkey AS h, l_linenumber > 1 AS z, l_linenumber AS n FROM lineitem),
            g AS (SELECT h, count(*) AS n, count(*) FILTER (a) AS i, bool_or(NOT z) AS o, bool_or(z) AS z, bool_or(a AND NOT z) AS k FROM f GROUP BY h)
            SELECT 'false_positive' AS kind, id FROM f WHERE a AND NOT e UNION ALL SELECT 'false_negative', id FROM f WHERE e AND NOT a
            UNION ALL SELECT 'invalid_archive_source', id FROM f WHERE n IN (2, 4) UNION ALL SELECT 'duplicate_group', h FROM g WHERE n > 1
            UNION ALL SELECT 'duplicate_violation', h FROM g WHERE i > 1 UNION ALL SELECT 'external_preference_violation', h FROM g WHERE o AND z AND NOT k""",
    ),
    "content_fingerprints": (content_fingerprints, r"SELECT doc_id, sha256(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, chr(10), chr(13)) END, '\r\n?', chr(10), 'g')) AS fingerprint FROM documents"),
    "term_metrics": (
        term_metrics,
        """WITH d AS (SELECT doc_id % 25 AS q, doc_id // 25 AS k, replace(lower(text), 'ß', 'ss') AS t, lang, source FROM documents WHERE text IS NOT NULL),
            a AS (SELECT q, string_agg(trim(t, ' '), chr(10) ORDER BY k, t) AS t FROM d GROUP BY q),
            c AS (SELECT n_nationkey AS q, n_nationkey % 4 > 0 AS asks, ['the', 'und', 'zzzz', lower(n_name)] AS terms, n_nationkey % 3 > 0 AS p, n_nationkey % 2 > 0 AS v FROM nation),
            m AS (SELECT c.q, asks, p, v, len(list_filter(terms, lambda w: contains(coalesce(t, ''), w))) AS hit, CASE WHEN contains(coalesce(t, ''), 'der') THEN 1 ELSE 0 END AS excluded FROM c LEFT JOIN a USING (q))
            SELECT q::BIGINT AS query_id, CASE WHEN asks THEN round(hit / 4, 6) ELSE 1 END::DOUBLE AS required_term_coverage_at_k, CASE WHEN asks THEN 4 - hit ELSE 0 END::INTEGER AS missing, excluded,
                   (SELECT count(*) FROM d WHERE d.q = m.q AND m.p AND lang IS DISTINCT FROM 'en') AS product_confusion_count, (SELECT count(*) FROM d WHERE d.q = m.q AND m.v AND source IS DISTINCT FROM 'web') AS version_mismatch_count FROM m""",
    ),
    "evidence_annotations": (
        evidence_annotations,
        """WITH e AS (SELECT p_partkey // 40 AS q, p_partkey, CASE WHEN p_size > 3 THEN p_brand END AS product, CASE WHEN p_size % 5 > 0 THEN (p_size % 3)::VARCHAR END AS version, CASE WHEN p_size % 4 > 0 THEN 2010 + p_size % 20 END AS y,
                p_size % 2 > 0 AS sure, p_partkey % 3 > 0 AS ap, p_partkey % 4 > 0 AS av, string_split(p_name, ' ') AS terms FROM part),
            s AS (SELECT *, min(version) OVER w <> max(version) OVER w AS several FROM e WINDOW w AS (PARTITION BY q, product)),
            m AS (SELECT *, CASE WHEN ap THEN coalesce(lower(product) = 'brand#11', false) END AS pm, CASE WHEN av THEN coalesce(version = '1', false) END AS vm, CASE WHEN y IS NOT NULL THEN make_timestamp(y, 1, 1, 0, 0, 0) < TIMESTAMP '2026-01-01' - INTERVAL 2920 DAY END AS st,
                version IS NOT NULL AND coalesce(several, false) AND product IS NOT NULL AS cf FROM s)
            SELECT p_partkey, pm AS product_match, vm AS version_match, st AS possibly_stale, cf AS possible_conflict, array_to_string(list_transform(list_sort(list_transform(list_distinct(terms), lambda t: {'n': -length(t), 't': t})), lambda x: x.t), ' ') AS keywords,
                   concat_ws(',', CASE WHEN NOT pm THEN 'ProductMismatch' END, CASE WHEN NOT vm THEN 'VersionMismatch' END, CASE WHEN st THEN 'PossiblyStale' END, CASE WHEN cf THEN 'PossibleConflict' END) AS warnings,
                   concat_ws(',', CASE WHEN version IS NULL THEN 'version' END, CASE WHEN y IS NULL THEN 'updated' END, CASE WHEN NOT sure THEN 'confidence' END) AS unverified FROM m""",
    ),
    "page_facts": (
        page_facts,
        """WITH p AS (SELECT page_id, page_id % 5 AS k FROM pages)
            SELECT key, value, 'u/' || page_id AS url, title, 'High' AS confidence FROM (
                SELECT page_id, 'LatestSastVersion' AS key, '9.' || page_id || '.0' AS value, 'Release Notes for 9.' || page_id || '.0' AS title FROM p WHERE k = 0
                UNION ALL SELECT page_id, 'LatestSastVersion', '9.' || page_id || '.1', 'Release Notes for 9.' || page_id || '.0' FROM p WHERE k = 0
                UNION ALL SELECT page_id, 'LatestEnginePackVersion', '9.' || page_id || '.2', 'Engine Pack' FROM p WHERE k = 1
                UNION ALL SELECT page_id, 'LatestHotfixVersion', 'HF' || greatest(page_id, 1), 'All Hotfixes' FROM p WHERE k = 2)""",
    ),
    "catalog_facts": (
        catalog_facts,
        """WITH v AS (SELECT p_brand AS key, p_size, max(p_partkey % 3) AS c FROM part GROUP BY ALL)
            SELECT key, '9.' || p_size || '.1' AS value, CASE WHEN count(*) OVER (PARTITION BY key) = 1 THEN 'Confirmed' ELSE 'Candidate' END AS status FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, p_size DESC) = 1""",
    ),
    "distinct_facts": (
        distinct_facts,
        "SELECT p_brand AS key, p_size::VARCHAR AS value, 'url' AS url, ['Low', 'Medium', 'High'][max(p_partkey % 3) + 1] AS confidence FROM part GROUP BY p_brand, p_size",
    ),
    "answer_readiness": (
        answer_readiness,
        """SELECT o_orderkey, CASE WHEN k % 11 = 0 THEN 'NeedsConfirmation' WHEN k % 5 = 1 AND k % 4 = 0 THEN 'NeedsConfirmation'
                WHEN k % 5 = 0 THEN CASE WHEN k % 7 > 0 AND k % 3 = 0 AND k % 2 = 0 THEN 'AutoAnswerable' ELSE 'InsufficientEvidence' END
                WHEN (k % 5 = 2 AND k % 7 = 0) OR k % 3 = 0 THEN 'NeedsConfirmation' ELSE 'InsufficientEvidence' END AS readiness FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    ),
    "evidence_scores": (
        evidence_scores,
        f"""WITH v AS (SELECT *, {_TRUST} AS trust, CASE WHEN l_suppkey % 4 = 0 THEN 'not_requested' WHEN l_partkey % 5 = 0 THEN 'unknown' WHEN l_suppkey % 3 = l_partkey % 3 THEN CASE WHEN l_partkey % 2 = 1 THEN 'exact' ELSE 'near' END ELSE 'mismatch' END AS version FROM lineitem)
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, version, trust, round(greatest(0, least(1, 0.43 * least(1, l_discount * 10) + 0.24 * (l_tax * 10) + 0.16 * (l_quantity / 50) + 0.11 * 0.5 + 0.06 * trust
                   - CASE WHEN l_quantity > 25 AND l_quantity <= 35 THEN 0.45 ELSE 0 END + CASE version WHEN 'exact' THEN 0.04 WHEN 'mismatch' THEN -0.12 ELSE 0 END)), 6) AS score FROM v""",
    ),
    "observed_coverage": (
        observed_coverage,
        "WITH i AS ("
        + " UNION ALL ".join(f"SELECT DISTINCT source, '{n}' AS item FROM documents WHERE {test}" for n, test in _OBSERVED)
        + ") SELECT s.source, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS coverage FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN i ON i.source IS NOT DISTINCT FROM s.source GROUP BY s.source",
    ),
    "app_chunks": (
        app_chunks,
        r"""WITH s AS (SELECT doc_id, unnest([{'n': 0, 'title': '', 'text': 'intro'}, {'n': 1, 'title': 'First', 'text': '## First ##' || chr(10) || coalesce(text, '') || chr(10) || '#### no'}, {'n': 2, 'title': 'Last', 'text': '# Last' || chr(10)}], recursive := true) FROM documents),
            c AS (SELECT doc_id, n, title, i, substr(text, (i * 2450 + 1)::INTEGER, 2600) AS t FROM s, unnest(range(0, CASE WHEN length(text) <= 2600 THEN 1 ELSE CAST(ceil((length(text) - 150) / 2450.0) AS BIGINT) END)) AS u(i)),
            d AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1)::INTEGER AS chunk_index FROM c WHERE regexp_replace(t, '\s', '', 'g') <> '')
            SELECT '/m/' || doc_id AS path, chunk_index, substr(sha256('/m/' || doc_id || '|' || chunk_index || '|' || title), 1, 24) AS chunk_id, title AS section_title, length(t)::INTEGER AS n_chars FROM d""",
    ),
    "structured_chunks": (
        structured_chunks,
        r"""WITH l AS (SELECT doc_id, doc_id % 3 AS k, text, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, 0 AS n, '質問' AS title, '質問' || chr(10) || trim(' ' || line) AS t FROM l WHERE k = 0 UNION ALL SELECT doc_id, 1, '原因', '原因' || chr(10) || 'because' FROM l WHERE k = 0
                  UNION ALL SELECT doc_id, 0, '質問', '質問' || chr(10) || regexp_replace('short' || chr(10) || line, '^\s+|\s+$', '', 'g') FROM l WHERE k = 1
                  UNION ALL SELECT doc_id, 1, 'お客様向け最終回答', 'お客様向け最終回答' || chr(10) || regexp_replace(line, '^\s+|\s+$', '', 'g') FROM l WHERE k = 1 AND regexp_replace(line, '\s', '', 'g') <> ''
                  UNION ALL SELECT doc_id, 0, NULL, text FROM l WHERE k = 2),
            c AS (SELECT doc_id, n, title, i, substr(t, (i * 1200 + 1)::INTEGER, 1200) AS text FROM s, unnest(range(0, CAST(ceil(length(t) / 1200.0) AS BIGINT))) AS u(i)),
            d AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1)::INTEGER AS chunk_index FROM c)
            SELECT doc_id, chunk_index, doc_id || ':structured:' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, 'structured', chunk_index::VARCHAR, coalesce(title, ''), text)), 1, 20) AS chunk_id, title AS section_title, length(text)::INTEGER AS n_chars FROM d""",
    ),
}
