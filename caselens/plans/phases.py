"""Queries that compare phases: the same search before and after reranking, and answers of several phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators import phases, retrieval
from caselens.scratch import written

from .retrieval import _FOLD, BM25, HASHED, asked, chunks, dealt, read

TOP = 10


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each passage by hashed vectors, by BM25 and by BM25 reranked."""
    index, queries = retrieval.indexed(chunks(spark, sf_dir)), asked(spark, sf_dir)
    best = retrieval.lists(index, queries, {"bm25": 4 * TOP, "cosine": TOP})
    found = written(best["bm25"], "bm25")
    again = retrieval.reranked(found, index, queries, TOP)
    lists = {"vectors": best["cosine"], "bm25": found.filter(F.col("rank") <= TOP), "reranked": again}
    out = None
    for name, rows in lists.items():
        part = rows.select(F.lit(name).alias("phase"), "query_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "rank")
        out = part if out is None else out.unionByName(part)
    return written(out, "phases")


def phase_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phases.all_changes(_lists(spark, sf_dir), ["vectors", "bm25", "reranked"], ["query_id"], ["document_id", "chunk_index"])
    return found.withColumnsRenamed({"from": "phase", "to": "next_phase"})


def phase_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = phase_changes(spark, sf_dir)
    return phases.change_summary(changes, ["phase", "next_phase", "query_id"])


def quality_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of all conversations in three phases: as they are, with what follows from the question, and with what
    nothing supports."""
    rows = read(spark, sf_dir, "conversations")
    first = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    answers = rows.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    told = F.concat("text", F.lit(" 設定を確認してください。qacli validate build を実行し、portalで表示を確認します。"))
    each = dealt(answers.join(first, "conv_id")).select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.concat(F.coalesce("question", F.lit("")), F.lit(" Validateへアップロードするコマンドの方法は?")).alias("question"),
        F.array("text", F.lit("qacli validate build を実行し、Validate portalで表示を確認する。tokenで認証し、projectを接続する。")).alias("evidence"), F.array().cast("array<string>").alias("insufficient_reasons"),
        F.lit("Blocked").alias("expected_decision"), F.lit(1).alias("expected_unsupported"),
        F.create_map(F.lit("plain"), F.col("text"), F.lit("told"), told, F.lit("unsupported"), F.concat(told, F.lit(" --force を付けます。"))).alias("answers"),
    )
    return phases.phase_report(phases.phase_answers(each, ["plain", "told", "unsupported"]))


_LISTS = f"""{BM25}{HASHED},
    lists AS (
        SELECT 'vectors' AS phase, query_id, document_id, chunk_index, rank FROM hashed_ranks WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, document_id, chunk_index, rank FROM bm25_ranks WHERE rank <= 10
        UNION ALL SELECT 'reranked', query_id, document_id, chunk_index, rank FROM again WHERE rank <= 10),
    steps AS (SELECT * FROM (VALUES ('vectors', 'bm25'), ('bm25', 'reranked')) t(phase, next_phase)),
    olds AS (SELECT s.*, query_id, document_id, chunk_index, rank AS before FROM steps s JOIN lists USING (phase)),
    news AS (SELECT s.*, query_id, document_id, chunk_index, rank AS after FROM steps s JOIN lists l ON l.phase = s.next_phase),
    changes AS (
        SELECT phase, next_phase, query_id, document_id, chunk_index, before, after, before - after AS moved,
               CASE WHEN before IS NULL THEN 'entered' WHEN after IS NULL THEN 'left' WHEN before > after THEN 'risen' WHEN before < after THEN 'fallen' ELSE 'same' END AS change
        FROM olds FULL JOIN news USING (phase, next_phase, query_id, document_id, chunk_index))"""
_AGAIN = f""",
    pool AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS base FROM bm25_ranks WHERE rank <= 40),
    held AS (SELECT p.query_id, p.document_id, p.chunk_index, count(*) AS m FROM pool p JOIN q USING (query_id) JOIN tf USING (document_id, chunk_index, term) GROUP BY ALL),
    sizes AS (SELECT query_id, count(*) AS size FROM q GROUP BY query_id),
    rescored AS (
        SELECT query_id, document_id, chunk_index, round(0.7 * base + 0.3 * coalesce(m, 0) / size + CASE WHEN contains({_FOLD.format("c.text")}, trim({_FOLD.format("b.text")})) THEN 0.1 ELSE 0 END, 6) AS score
        FROM pool LEFT JOIN held USING (query_id, document_id, chunk_index) JOIN sizes USING (query_id) JOIN chunks c USING (document_id, chunk_index) JOIN benchmark b ON b.item_id = query_id),
    again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM rescored),
    lists AS ("""
_LISTS = _LISTS.replace(",\n    lists AS (", _AGAIN, 1)

QUERIES = {
    "phase_changes": (phase_changes, f"WITH {_LISTS} SELECT * FROM changes"),
    "phase_change_summary": (
        phase_change_summary,
        f"""WITH {_LISTS} SELECT phase, next_phase, query_id, count(*) AS items, {", ".join(f"count(*) FILTER (change = '{k}') AS {k}" if k != "left" else "count(*) FILTER (change = 'left') AS left" for k in ("entered", "left", "risen", "fallen", "same"))},
            round(count(moved) / count(*), 6) AS overlap, coalesce(max(abs(moved)), 0) AS farthest FROM changes GROUP BY ALL""",
    ),
    "quality_phases": (quality_phases, None),
}
