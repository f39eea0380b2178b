"""Web page queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.text import excerpt, redact
from caselens.sources import html

from .retrieval import read


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(read(spark, sf_dir, "pages"), "page_id", "url", "html")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.sections(read(spark, sf_dir, "pages"), "page_id", "html")
    return rows.select("page_id", "section", F.col("title").isNotNull().alias("titled"), F.size(F.split("text", " ")).alias("words"))


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.primary_text(F.col("html")).alias("text"))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", redact(F.col("text")).alias("redacted"))
    return rows.select("doc_id", (F.col("text") != F.col("redacted")).alias("changed"), F.sha2("redacted", 256).alias("text_sha256"))


def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 240 characters around the first full stop of each document."""
    return read(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text"), F.lit("."), 240, 60).alias("excerpt"))


_SHOWN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HF = " + ".join(f"CASE WHEN contains(lower(link || ' ' || t), '{w}') THEN 20 ELSE 0 END" for w in html.IMPORTANT_WORDS)

QUERIES = {
    "page_links": (
        page_links,
        rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages),
            h AS (SELECT page_id, url, trim(replace(regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1), '&amp;', '&')) AS h,
                  trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a),
            l AS (SELECT page_id, t, regexp_extract(url, '^(https?://[^/?#]+)') || h AS link, h FROM h WHERE starts_with(h, '/') AND NOT starts_with(h, '//'))
            SELECT page_id, regexp_replace(link, '#.*$', '') AS link, max({_HF})::INTEGER AS priority FROM l
            WHERE NOT regexp_matches(regexp_replace(h, '[?#].*$', ''), '(?i)(login|signin|logout|auth)')
              AND NOT regexp_matches(regexp_replace(h, '[?#].*$', ''), '(?i)\.({"|".join(html.SKIPPED_EXTENSIONS)})$') GROUP BY 1, 2""",
    ),
    "page_titles": (page_titles, r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages"),
    "page_sections": (
        page_sections,
        rf"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS c FROM pages),
            p AS (SELECT page_id, string_split(regexp_replace(c, '(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM c),
            s AS (SELECT page_id, len(parts) > 1 AS titled, unnest(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE parts END) AS part, generate_subscripts(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE parts END, 1) - 1 AS section FROM p),
            t AS (SELECT page_id, section::INTEGER AS section, titled, {_SHOWN.format("part")} AS t FROM s)
            SELECT page_id, section, titled, len(string_split(t, ' '))::INTEGER AS words FROM t WHERE t <> ''""",
    ),
    "page_bodies": (
        page_bodies,
        rf"""WITH p AS (SELECT page_id, {_SHOWN.format(r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)', 1)")} AS main, {_SHOWN.format("html")} AS whole FROM pages)
            SELECT page_id, CASE WHEN length(main) >= 80 OR length(main) >= length(whole) THEN main ELSE whole END AS text FROM p""",
    ),
    "redacted_documents": (
        redacted_documents,
        r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[メールアドレス]', 'g') AS t FROM documents),
            b AS (SELECT doc_id, text, regexp_replace(t, '(^|[^0-9])(?:\+?\d{1,3}[-\s]?)?(?:0\d{1,4}[-\s]?\d{1,4}[-\s]?\d{3,4})($|[^0-9])', '\1[電話番号]\2', 'g') AS t FROM a),
            c AS (SELECT doc_id, text, regexp_replace(t, '[A-Za-z]:\\[^\r\n\t :;"''<>|]+(?:\\[^\r\n\t :;"''<>|]+)*', '[Windowsパス]', 'g') AS t FROM b),
            d AS (SELECT doc_id, text, regexp_replace(t, '(?i)(?:sk-[A-Za-z0-9_-]{12,}|Bearer\s+[A-Za-z0-9._-]{12,}|(?:api[_-]?key|apikey)\s*[:=]\s*[A-Za-z0-9._-]{8,})', '[APIキー]', 'g') AS t FROM c)
            SELECT doc_id, text <> t AS changed, sha256(t) AS text_sha256 FROM d""",
    ),
    "document_excerpts": (
        document_excerpts,
        r"""WITH j AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
            s AS (SELECT doc_id, t, greatest(1, CASE WHEN instr(t, '.') > 0 THEN instr(t, '.') - 60 ELSE 1 END) AS b FROM j)
            SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN b > 1 THEN '...' ELSE '' END || substr(t, b, 240)
                   || CASE WHEN b + 239 < length(t) THEN '...' ELSE '' END END AS excerpt FROM s""",
    ),
}
