"""Files as tables: notes with their encodings, archives read safely, office documents, kinds and inventories."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.names import file_category, file_of, folder_parts

# Limits of an archive (entries, bytes of one and of all, compression ratio) and kinds of files.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 1000, 32 << 20, 256 << 20, 200
KINDS = {
    "text": ["txt", "md", "rst", "adoc", "csv", "tsv", "log"],
    "web": ["html", "htm"],
    "document": ["pdf", "docx"],
    "sheet": ["xlsx"],
    "slides": ["pptx"],
    "archive": ["zip"],
}
ENTRY = "archive string, entry string, size long, compressed long, content binary, rejected string"


def decode(data: bytes | None) -> str | None:
    """UTF-8, else CP932, else UTF-8 with replacement characters; a byte-order mark is dropped."""
    if data is None:
        return None
    for encoding in ("utf-8", "cp932"):
        try:
            return bytes(data).decode(encoding).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return bytes(data).decode("utf-8", "replace").removeprefix("﻿")


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(decode)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind(path: Column) -> Column:
    """text, web, document, sheet, slides, archive or other, by extension."""
    out = F.lit("other")
    for name, endings in KINDS.items():
        out = F.when(extension(path).isin(endings), name).otherwise(out)
    return out


def read_notes(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, modified, text) of the files right in a folder, whatever their encoding, by path; links are passed over."""
    files = without_links(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder), folder).orderBy("path")
    return files.select("path", F.col("modificationTime").alias("modified"), decoded("content").alias("text"))


def inventory(spark: SparkSession, folder: str, warn: int = 20 << 20, exclude: int = 100 << 20) -> DataFrame:
    """(path, modified, size, kind, gate) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    gate = F.when(F.col("size") > exclude, "excluded").when(F.col("size") > warn, "large").otherwise("ok")
    return files.select("path", "modified", "size", kind(F.col("path")).alias("kind"), gate.alias("gate"))


def inside(path: str, root: str) -> str:
    """A path as it is read, if it lies under the root; else an error. Neither may be a link out of it."""
    from pathlib import Path

    top = Path(root).resolve()
    found = (top / path).resolve()
    if not found.is_relative_to(top):
        raise ValueError(f"{path} lies outside of {root}")
    return str(found)


def scan_case_folders(files: DataFrame) -> DataFrame:
    """(path, modified, company, support_number, status, created_on, stamp) of the folders among a listing (path, modified)
    whose names are those of cases; others are passed over. The time is that of the last file below."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    each = files.select("modified", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    found = each.withColumn("_p", folder_parts(file_of(F.col("path")))).filter("_p is not null")
    return found.groupBy("path", "_p").agg(F.max("modified").alias("modified")).select("path", "modified", "_p.*")


def listed_folders(files: DataFrame) -> DataFrame:
    """(path, modified): every folder above a listed file (path, modified), with the time of the last file below. Names are not
    looked at."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    each = files.select("modified", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return each.filter("path <> ''").groupBy("path").agg(F.max("modified").alias("modified"))


#: A folder in the cache of a scan; record is null where the name is none of a case.
SCANNED = "path string, modified timestamp, record struct<company:string,support_number:string,status:string,created_on:string,stamp:string>"


def cached_scan(known: DataFrame, folders: DataFrame, parse=None) -> DataFrame:
    """(path, modified, record, state) from the cache of the last scan and a listing of folders (path, modified). Folders whose
    path and time are in the cache keep their record (state kept); only others reach ``parse``, a function from a path to a
    record or null (parsed); those of the cache that the listing lacks are tombstones (gone). Without the tombstones the
    rows are the next scan's cache; those with a record are its cases.

    The listing is anti-joined before anything is parsed, so a scan costs what has changed. Repeated rows of the cache or
    the listing count once; null times never match and are parsed again; an empty cache parses all, an empty listing leaves
    tombstones alone."""
    parse = parse or (lambda path: folder_parts(file_of(path)))
    known, folders = known.dropDuplicates(["path", "modified"]), folders.dropDuplicates(["path"])
    fresh = folders.join(known, ["path", "modified"], "left_anti").select("path", "modified", parse(F.col("path")).alias("record"), F.lit("parsed").alias("state"))
    kept = known.join(folders, ["path", "modified"], "left_semi").select("path", "modified", "record", F.lit("kept").alias("state"))
    gone = known.join(folders, "path", "left_anti").select("path", "modified", "record", F.lit("gone").alias("state"))
    return fresh.unionByName(kept).unionByName(gone)


def rescanned(known: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``scan_case_folders`` for a listing of files, with those of ``known`` (its last result) whose folder has not
    changed since; names of unchanged folders are not parsed."""
    record = F.struct(*[F.col(c) for c in known.columns if c not in ("path", "modified")])
    found = cached_scan(known.select("path", "modified", record.alias("record")), listed_folders(files))
    return found.filter("state <> 'gone' AND record IS NOT NULL").select("path", "modified", "record.*")


def without_links(files: DataFrame, root: str) -> DataFrame:
    """The listed files (path) that are no links and lie in no linked folder below the root. Only local paths can be links."""
    import os
    from urllib.parse import unquote, urlparse

    top = urlparse(root).path or root

    @F.pandas_udf(T.BooleanType())
    def linked(paths: pd.Series) -> pd.Series:
        seen: dict[str, bool] = {}

        def test(path: str) -> bool:
            if path not in seen:
                seen[path] = len(path) > len(top.rstrip("/")) and (os.path.islink(path) or test(os.path.dirname(path)))
            return seen[path]

        return paths.map(lambda p: urlparse(p).scheme in ("", "file") and test(unquote(urlparse(p).path)))

    return files.filter(~linked("path"))


def read_manuals(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, modified, category, text) of all files under several folders, each once however often it is named, by path; text
    is null for what is not text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dict.fromkeys(folders)))
    rows = files.select("path", F.col("modificationTime").alias("modified"), file_category(F.col("path")).alias("category"), "content")
    rows = rows.withColumn("_key", F.lower("path")).dropDuplicates(["_key"]).orderBy("path").drop("_key")
    plain = kind(F.col("path")).isin("text", "web")
    return rows.select("path", "modified", "category", decoded(F.when(plain, F.col("content"))).alias("text"))


def archive_counters(entries: DataFrame) -> DataFrame:
    """(archive, entries, read, rejected, reasons) of ``read_archives``' rows."""
    bad = F.col("rejected").isNotNull()
    return entries.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if(~bad).alias("read"), F.count_if(bad).alias("rejected"), F.array_sort(F.collect_set("rejected")).alias("reasons"))


def is_safe_entry(path: Column) -> Column:
    """Whether a path in an archive stays inside it: relative, without drive, and without . or .. parts."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: p != "")
    inside = ~F.exists(parts, lambda p: p.isin(".", ".."))
    return F.coalesce((F.trim(path) != "") & ~F.startswith(flat, F.lit("/")) & ~flat.rlike("^[A-Za-z]:") & inside, F.lit(False))


def _safe(path: str) -> bool:
    flat = path.replace("\\", "/")
    return bool(path.strip()) and not flat.startswith("/") and not re.match("[A-Za-z]:", flat) and not {".", ".."} & set(flat.split("/"))


def archive_entries(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of an archive: a content or the reason why it is rejected."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield name, None, None, None, None, "corrupt"
        return
    total = 0
    for n, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
        row = name, info.filename, info.file_size, info.compress_size
        reason = (
            "too many entries" if n >= MAX_ENTRIES
            else "encrypted" if info.flag_bits & 1
            else "unsafe path" if not _safe(info.filename)
            else "too large" if info.file_size > MAX_ENTRY
            else "archive too large" if total + info.file_size > MAX_TOTAL
            else "ratio" if info.file_size > MAX_RATIO * max(1, info.compress_size)
            else None
        )
        if reason is None:
            try:
                with archive.open(info) as f:
                    content = f.read(MAX_ENTRY + 1)
            except (zipfile.BadZipFile, OSError, NotImplementedError):
                reason = "corrupt"
            else:
                if len(content) <= MAX_ENTRY:
                    total += len(content)
                    yield *row, content, None
                    continue
                reason = "too large"
        yield *row, None, reason


def read_archives(files: DataFrame) -> DataFrame:
    """Entries of the archives in ``files`` (path, content), rejected ones with their reason."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in archive_entries(path, content):
                    yield pd.DataFrame([row], columns=names).astype({"size": "Int64", "compressed": "Int64"})

    return files.select("path", "content").mapInPandas(read, ENTRY)


def office_text(name: str, data: bytes) -> list[tuple[str | None, str]]:
    """(title, text) sections of a DOCX (by heading style), XLSX or PPTX file; none if it cannot be read."""
    ending = name.rpartition(".")[2].lower()
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()
        wanted = {"docx": r"word/document\.xml", "xlsx": r"xl/(sharedStrings|worksheets/.*)\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}[ending]
        if len(names) > MAX_ENTRIES or sum(i.file_size for i in archive.infolist()) > MAX_TOTAL:
            return []
        trees = []
        for n in sorted(n for n in names if re.fullmatch(wanted, n)):
            with archive.open(n) as f:
                data = f.read(MAX_ENTRY + 1)
            if len(data) > MAX_ENTRY:
                return []
            trees.append(ElementTree.fromstring(data))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    if ending != "docx":
        texts = [" ".join(e.text for e in tree.iter() if local(e) == "t" and e.text) for tree in trees]
        return [(None, t) for t in texts if t]
    out: list[tuple[str | None, list[str]]] = []
    for tree in trees:
        for p in (e for e in tree.iter() if local(e) == "p"):
            style = next((v for e in p.iter() if local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
            text = "".join(e.text or "" for e in p.iter() if local(e) == "t").strip()
            if text and (re.match("(?i)heading|見出し", style) or not out):
                out.append((text if re.match("(?i)heading|見出し", style) else None, []))
            if text:
                out[-1][1].append(text)
    return [(title, "\n".join(lines)) for title, lines in out]


def read_office(files: DataFrame) -> DataFrame:
    """(path, section, title, text) of the office documents in ``files`` (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, title, text) for p, c in zip(batch["path"], batch["content"], strict=True) for i, (title, text) in enumerate(office_text(p, c))]
            yield pd.DataFrame(rows, columns=["path", "section", "title", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, section int, title string, text string")
