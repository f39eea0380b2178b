"""Queries that build evidence: payload items, choices within a budget, and all registered searches and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators import evidence, retrieval

from .ranking import _CANDIDATES, _candidates
from .retrieval import _FOLD, BM25, HASHED, KEYWORD, POOL, TOP, asked, chunks

TYPES = ["OfficialDoc", "Manual", "ExactPastAnswer", "PastAnswer", "PastCaseNote"]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    n, d = F.col("query_id").cast("long"), F.col("document_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (d % 5 + 1).cast("int"))
    return rows.select(
        "query_id", "candidate_id", "document_id", "chunk_index", "rank", F.col("relative").alias("score"), "text", F.col("source").alias("title"), "lang", F.when(d % 7 > 0, kind).alias("source_type"), F.when(d % 3 > 0, F.upper("lang")).alias("product"),
        F.when(d % 4 > 0, (d % 2).cast("string")).alias("version"), F.when(d % 5 > 0, F.concat((d % 10 + 2015).cast("string"), F.lit("-06-01"))).alias("updated"), F.when(d % 2 > 0, F.lit(0.5)).alias("confidence"),
        F.concat(F.lit("S"), d.cast("string")).alias("support_id"), F.slice(F.split("query", " "), 1, 6).alias("matched_terms"), F.when(n % 3 > 0, " en").alias("asked_product"), F.when(n % 2 > 0, "1").alias("asked_version"), "query",
    )


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.payload_items(_found(spark, sf_dir), 3, "2026-01-01", 365 * 4)
    joined = [F.array_join(c, "|").alias(c) for c in ("warning_texts", "open_texts")]
    return found.select("query_id", "place", "document_id", "source_type", "selection_reason", *joined, F.array_join("keyword_matches", " ").alias("keywords"))


def built_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir).withColumnsRenamed({"candidate_id": "source_id"}).withColumn("product_name", F.col("product"))
    n = F.col("query_id").cast("long") % 3
    types = F.when(n == 0, F.array(F.lit("LatestVersionQuestion"))).when(n == 1, F.array(F.lit("TroubleshootingQuestion"))).otherwise(F.array(F.lit("HowToQuestion")))
    found = evidence.built(rows.withColumn("types", types), F.when(F.col("query_id").cast("long") % 2 > 0, "en"), F.col("types"), 1500, 3)
    return found.select("query_id", "source_id", "pick", F.char_length("excerpt").alias("n_chars"), "used", F.round("relevance", 6).alias("relevance"))


def taken_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``evidence_items`` as if made elsewhere, for questions of which some rest on no ready baseline."""
    rows = evidence.payload_items(_found(spark, sf_dir), 5, "2026-01-01", 365 * 4).withColumns({"warnings": F.col("warning_texts"), "ready": F.col("query_id").cast("long") % 7 > 0})
    rows = rows.withColumn("text", F.when(F.col("document_id") % 6 > 0, F.col("text")))
    found = evidence.taken_over(rows.withColumn("version_match", F.lit(None).cast("boolean")))
    return found.select("query_id", "place", "document_id", "state", F.size("warnings").alias("warnings"))


def registered_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three chunks of each passage by each registered search and reranker, over one index."""
    index, queries = retrieval.indexed(chunks(spark, sf_dir)), asked(spark, sf_dir)
    out = None
    for method, candidates in retrieval.searches(index, queries, TOP, POOL).items():
        for reranker, again in retrieval.RERANKERS.items():
            found = again(candidates, index, queries, TOP)
            part = found.select(F.lit(method).alias("search_method"), F.lit(reranker).alias("reranker"), "query_id", "document_id", "chunk_index", "score", "rank")
            out = part if out is None else out.unionByName(part)
    return out


_FOUND = rf"""{_CANDIDATES},
    ids AS (SELECT query_id::VARCHAR AS query_id, document_id AS d, chunk_index, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS s FROM bm25_ranks WHERE rank <= 20),
    found AS (
        SELECT i.*, i.query_id::BIGINT AS n, lpad(d::VARCHAR, 12, '0') || '-' || i.chunk_index AS id, c.text, x.source AS title, b.text AS query, CASE WHEN d % 7 > 0 THEN ['OfficialDoc', 'Manual', 'ExactPastAnswer', 'PastAnswer', 'PastCaseNote'][d % 5 + 1] END AS kind,
               CASE WHEN d % 3 > 0 THEN lang END AS product, CASE WHEN d % 4 > 0 THEN (d % 2)::VARCHAR END AS version, CASE WHEN d % 5 > 0 THEN d % 10 + 2015 END AS y, d % 2 > 0 AS sure
        FROM ids i JOIN chunks c ON c.document_id = d AND c.chunk_index = i.chunk_index JOIN documents x ON x.doc_id = d JOIN benchmark b ON b.item_id = i.query_id::BIGINT)"""
_BUILT = rf"""{_FOUND},
    cleaned AS (
        SELECT *, array_to_string(list_filter(list_transform(string_split_regex(text, '[\r\n]'), lambda x: trim(x)), lambda x: x <> ''), ' ') AS flat,
               list_distinct(list_transform(list_filter(string_split_regex(text, '[ \r\n\t。、,.:;/\\_-]+'), lambda w: length(w) > 1)[1:200], lambda w: lower(w))) AS words FROM found),
    able AS (
        SELECT query_id, id, s, words, length(title) + CASE WHEN length(flat) <= 240 THEN length(flat) ELSE 243 END AS cost, CASE WHEN length(flat) <= 240 THEN length(flat) ELSE 243 END AS size,
               {{'p': CASE n % 3 WHEN 1 THEN coalesce(list_position(['exactpastanswer', 'manual', 'officialdoc', 'pastanswer', 'pastcasenote'], lower(kind)), 6) WHEN 2 THEN coalesce(list_position(['manual', 'officialdoc', 'exactpastanswer', 'pastanswer', 'pastcasenote'], lower(kind)), 6)
                          ELSE coalesce(list_position(['officialdoc', 'manual', 'exactpastanswer', 'pastanswer', 'pastcasenote'], lower(kind)), 6) END, 's': -s, 'i': id}} AS key
        FROM cleaned WHERE (product IS NULL OR n % 2 = 0 OR product = 'en') AND NOT (n % 3 = 0 AND coalesce(kind, '') IN ('ExactPastAnswer', 'PastAnswer', 'PastCaseNote'))),
    p1 AS (SELECT query_id, arg_min({{'id': id, 'size': size, 'cost': cost, 's': s, 'words': words, 'key': key}}, key) AS b FROM able GROUP BY query_id),
    s1 AS (SELECT query_id, 1 AS pick, b, b.cost AS used, [b.words] AS kept FROM p1)"""


def _round(n: int) -> str:
    return f""",
    p{n} AS (
        SELECT query_id, arg_min({{'id': a.id, 'size': a.size, 'cost': a.cost, 's': a.s, 'words': a.words, 'key': a.key}}, a.key) AS b, any_value(used) AS before, any_value(kept) AS kept
        FROM able a JOIN s{n - 1} USING (query_id) WHERE a.key > b.key AND used + a.cost <= 750
             AND len(list_filter(kept, lambda w: len(w) > 0 AND len(a.words) > 0 AND len(list_intersect(w, a.words)) >= 0.88 * (len(w) + len(a.words) - len(list_intersect(w, a.words))))) = 0 GROUP BY query_id),
    s{n} AS (SELECT query_id, {n} AS pick, b, before + b.cost AS used, list_append(kept, b.words) AS kept FROM p{n})"""


_LISTED = f"""{BM25}{KEYWORD}{HASHED},
    fused AS (SELECT query_id, document_id, chunk_index, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM bm25_ranks WHERE rank <= 50 UNION ALL SELECT * FROM hashed_ranks WHERE rank <= 50) GROUP BY ALL),
    fused_ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM fused),
    listed AS (
        SELECT 'bm25' AS search_method, query_id, document_id, chunk_index, score, rank FROM bm25_ranks UNION ALL SELECT 'keyword', query_id, document_id, chunk_index, score, rank FROM keyword_ranks
        UNION ALL SELECT 'hash_embedding', query_id, document_id, chunk_index, score, rank FROM hashed_ranks UNION ALL SELECT 'hybrid', query_id, document_id, chunk_index, score, rank FROM fused_ranks),
    pool AS (SELECT *, score / max(score) OVER (PARTITION BY search_method, query_id) AS base FROM listed WHERE rank <= 20),
    shared AS (SELECT search_method, p.query_id, p.document_id, p.chunk_index, count(*) AS common FROM pool p JOIN q USING (query_id) JOIN tf USING (document_id, chunk_index, term) GROUP BY ALL),
    rescored AS (
        SELECT search_method, query_id, document_id, chunk_index, round(0.7 * base + 0.3 * coalesce(common, 0) / size + CASE WHEN contains({_FOLD.format("c.text")}, trim({_FOLD.format("b.text")})) THEN 0.1 ELSE 0 END, 6) AS score
        FROM pool LEFT JOIN shared USING (search_method, query_id, document_id, chunk_index) JOIN sizes USING (query_id) JOIN chunks c USING (document_id, chunk_index) JOIN benchmark b ON b.item_id = query_id)"""

QUERIES = {
    "evidence_items": (
        evidence_items,
        f"""WITH {_FOUND},
            one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, d ORDER BY rank) = 1),
            placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS place FROM one QUALIFY place <= 3),
            told AS (
                SELECT *, CASE WHEN n % 3 > 0 THEN coalesce(product = 'en', false) END AS pm, CASE WHEN n % 2 > 0 THEN coalesce(version = '1', false) END AS vm, make_timestamp(y, 6, 1, 0, 0, 0) < TIMESTAMP '2026-01-01' - INTERVAL 1460 DAY AS stale,
                       version IS NOT NULL AND product IS NOT NULL AND coalesce(min(version) OVER w <> max(version) OVER w, false) AS clash, list_distinct(string_split(query, ' ')[1:6]) AS terms FROM placed WINDOW w AS (PARTITION BY query_id, product))
            SELECT query_id, place, d AS document_id, coalesce(kind, 'Unknown') AS source_type, '検索順位' || rank || '位、スコア' || printf('%.6f', s) || '。製品一致=' || CASE WHEN pm IS NULL THEN '未指定' WHEN pm THEN 'True' ELSE 'False' END
                   || '、バージョン一致=' || CASE WHEN vm IS NULL THEN '未指定' WHEN vm THEN 'True' ELSE 'False' END || '、キーワード一致=' || len(terms) || '件。' AS selection_reason,
                   concat_ws('|', CASE WHEN NOT pm THEN '{evidence.WARNINGS["ProductMismatch"]}' END, CASE WHEN NOT vm THEN '{evidence.WARNINGS["VersionMismatch"]}' END, CASE WHEN stale THEN '{evidence.WARNINGS["PossiblyStale"]}' END,
                             CASE WHEN clash THEN '{evidence.WARNINGS["PossibleConflict"]}' END) AS warning_texts,
                   concat_ws('|', CASE WHEN version IS NULL THEN '{evidence.OPEN["version"]}' END, CASE WHEN y IS NULL THEN '{evidence.OPEN["updated"]}' END, CASE WHEN NOT sure THEN '{evidence.OPEN["confidence"]}' END) AS open_texts,
                   array_to_string(list_transform(list_sort(list_transform(terms, lambda t: {{'n': -length(t), 't': t}})), lambda x: x.t), ' ') AS keywords FROM told""",
    ),
    "taken_evidence": (
        taken_evidence,
        f"""WITH {_FOUND},
            one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, d ORDER BY rank) = 1),
            placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS place FROM one QUALIFY place <= 5),
            told AS (
                SELECT *, CASE WHEN n % 3 > 0 THEN coalesce(product = 'en', false) END AS pm, CASE WHEN n % 2 > 0 THEN coalesce(version = '1', false) END AS vm, make_timestamp(y, 6, 1, 0, 0, 0) < TIMESTAMP '2026-01-01' - INTERVAL 1460 DAY AS stale,
                       version IS NOT NULL AND product IS NOT NULL AND coalesce(min(version) OVER w <> max(version) OVER w, false) AS clash FROM placed WINDOW w AS (PARTITION BY query_id, product)),
            outs AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'NotReady' WHEN d % 6 = 0 THEN 'Incomplete' WHEN NOT pm THEN 'OtherProduct' END AS o,
                            coalesce(NOT pm, false)::INTEGER + coalesce(NOT vm, false)::INTEGER + coalesce(stale, false)::INTEGER + clash::INTEGER AS w FROM told)
            SELECT query_id, place, d AS document_id, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY query_id, o IS NULL ORDER BY place) <= 3 THEN 'Taken' ELSE 'Beyond' END) AS state,
                   (w + CASE WHEN n % 2 > 0 AND version <> '1' AND NOT (coalesce(NOT vm, false) OR clash) THEN 1 ELSE 0 END)::INTEGER AS warnings FROM outs""",
    ),
    "built_evidence": (
        built_evidence,
        f"""WITH {_BUILT}{_round(2)}{_round(3)}
            SELECT query_id, b.id AS source_id, pick, b.size::INTEGER AS n_chars, used::INTEGER AS used, least(1, greatest(0, b.s)) AS relevance FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)""",
    ),
    "registered_searches": (
        registered_searches,
        f"""WITH {_LISTED},
            again AS (SELECT *, row_number() OVER (PARTITION BY search_method, query_id ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM rescored)
            SELECT search_method, 'none' AS reranker, query_id, document_id, chunk_index, score, rank FROM listed WHERE rank <= 3 UNION ALL SELECT search_method, 'lexical', query_id, document_id, chunk_index, score, rank FROM again WHERE rank <= 3""",
    ),
}
