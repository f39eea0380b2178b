"""Web pages as tables: sections, titles, links with normalised addresses and priorities."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds that are not followed, words of login pages, and words that make a page important.
SKIPPED_EXTENSIONS = ["pdf", "doc", "docx", "zip", "js", "css", "png", "jpg", "jpeg", "gif", "svg", "ico"]
LOGIN_WORDS = ["login", "signin", "logout", "auth"]
IMPORTANT_WORDS = [
    "release notes", "release-notes", "hotfix", "hotfixes", "hf", "engine pack", "engine-pack", "cct", "auto-cct", "auto cct",
    "compiler compatibility", "version", "versions", "sast", "cxsast", "最新", "最新バージョン", "リリース", "ホットフィックス",
    "エンジンパック", "コンパイラ", "自動生成",
]
#: Least characters of a page's primary content; below, the whole page counts.
LEAST = 80


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def visible(source: Column) -> Column:
    """The page without scripts and styles, tags as spaces, white space joined; references are left."""
    shown = F.regexp_replace(F.regexp_replace(source, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(shown, r"\s+", " "))


def sections(pages: DataFrame, key: str, source: str) -> DataFrame:
    """(key, section, title, text): the page cut before each h1 to h6; a page without headings is one section without
    title, and what stands before the first heading belongs to none."""
    clean = F.regexp_replace(F.col(source), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    heading = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"
    parts = F.split(F.regexp_replace(clean, f"({heading})", "\u0001$1"), "\u0001")
    has = clean.rlike(heading)
    rows = pages.select(key, has.alias("has"), F.posexplode(F.when(has, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.array(clean))).alias("section", "part"))
    title = F.when(F.col("has"), visible(F.regexp_extract("part", r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1)))
    rows = rows.select(key, "section", unescaped(title).alias("title"), unescaped(visible(F.col("part"))).alias("text"))
    return rows.filter(F.col("text") != "")


def page_title(source: Column) -> Column:
    """The title, or else the og:title; references are left."""
    own = F.trim(F.regexp_replace(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    shared = F.regexp_extract(source, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    return F.when(own != "", own).otherwise(shared)


def primary_text(source: Column) -> Column:
    """The visible text of main or article if it is long enough, else of the whole page; references are left."""
    main = visible(F.coalesce(F.nullif(F.regexp_extract(source, r"(?is)<(main|article)\b[^>]*>(.*?)(?:</\1\s*>|\z)", 2), F.lit("")), F.lit("")))
    whole = visible(source)
    return F.when((F.char_length(main) >= LEAST) | (F.char_length(main) >= F.char_length(whole)), main).otherwise(whole)


def priority(url: Column, text: Column) -> Column:
    """20 for each important word in the address or the link's text."""
    where = F.lower(F.concat_ws(" ", url, text))
    return sum((F.when(F.contains(where, F.lit(w)), 20).otherwise(0) for w in IMPORTANT_WORDS), F.lit(0))


def links(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(key, link, priority): each page's links to its own host, absolute, without fragment, each once with its highest
    priority; login pages and files that are not pages are left out."""
    anchors = F.regexp_extract_all(F.col(source), F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), 1)
    rows = pages.select(key, F.col(url).alias("_base"), F.explode(anchors).alias("_a"))
    href = F.trim(F.regexp_replace(F.regexp_extract("_a", r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), "&amp;", "&"))
    rows = rows.select(key, "_base", href.alias("_h"), visible(F.col("_a")).alias("_t"))
    rows = rows.filter((F.col("_h") != "") & ~F.col("_h").rlike(r"(?i)^(#|mailto:|tel:|javascript:)"))
    root = F.regexp_extract("_base", r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("_base", r"[?#].*$", ""), r"(?i)^(https?://[^/]+(?:/.*)?/|https?://[^/]+).*$", "$1")
    whole = (
        F.when(F.col("_h").rlike("(?i)^https?://"), F.col("_h"))
        .when(F.startswith("_h", F.lit("//")), F.concat(F.regexp_extract("_base", r"^(https?:)", 1), F.col("_h")))
        .when(F.startswith("_h", F.lit("/")), F.concat(root, F.col("_h")))
        .when(F.endswith(folder, F.lit("/")), F.concat(folder, F.col("_h")))
        .otherwise(F.concat(root, F.lit("/"), F.col("_h")))
    )
    rows = rows.withColumn("link", F.regexp_replace(whole, "#.*$", ""))
    host = lambda c: F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#]+)", 1))
    path = F.regexp_extract("link", r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    wrong = path.rlike(f"(?i)({'|'.join(LOGIN_WORDS)})") | path.rlike(rf"(?i)\.({'|'.join(SKIPPED_EXTENSIONS)})$")
    rows = rows.filter((host("link") == host("_base")) & (host("link") != "") & ~wrong)
    return rows.groupBy(key, "link").agg(F.max(priority(F.col("link"), F.col("_t"))).alias("priority"))
