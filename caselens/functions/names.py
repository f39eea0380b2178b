"""Column functions on the names of case folders, files, paths and pages, and on what they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of folder names and of the stamps at the end of a status, and the characters no file name may have.
FOLDER = r"^(\d{8})\((.+)\)(.+)$"
LEGACY_FOLDER = r"^(\d{4,8})\((.+?)\)(.+)$"
LEGACY_INNER = r"^(.*?)(\d{3,})$"
STATUS_STAMP = r"^(.*?)[_\-\s](\d{8})$"
LEGACY_STAMP = r"^(.*?)(\d{4,8})$"
INVALID = '<>:"/\\|?*'
# Categories of files by extension, the first table that has it.
FILE_CATEGORIES = {
    "ImportCandidate": ["txt", "text", "md", "markdown", "csv", "tsv", "html", "htm", "rst", "adoc", "asciidoc", "pdf", "docx", "xlsx", "pptx"],
    "ArchiveCandidate": ["zip"],
    "UnsupportedDocumentFormat": ["png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "doc", "xls", "ppt"],
    "OutOfScopeBinaryOrArchive": ["exe", "dll", "run", "db", "pdb", "bak", "7z", "arc", "tbz2"],
}
OTHER_CATEGORY = "UnsupportedOther"
# What tells a manual from a log, by its name and its lines.
MANUAL_NAME = r"(?i)(?:^|[\s_.\-])(manual|guide|installation[\s_.\-]*notes?|user[\s_.\-]*guide|reference|getting[\s_.\-]*started|installation|configuration|setup|cli[\s_.\-]*reference|command[\s_.\-]*reference)(?:$|[\s_.\-])|(?:手順書|利用手順|設定ガイド)"
LOG_NAME = r"(?i)(?:^|[\s_.\-])(trace|debug|build[\s_.\-]*log|crash[\s_.\-]*dump|console[\s_.\-]*output|execution[\s_.\-]*log|run[\s_.\-]*log|log)(?:$|[\s_.\-])"
SHELL_PROMPT = r"(?i)^\s*PS\s+[A-Z]:\\"
DRIVE_PROMPT = r"(?i)^\s*[A-Z]:\\[^>\r\n]*>"
UNIX_PROMPT = r"(?i)^\s*(?:[\w.-]+@[^\s:]+(?::[^$#]+)?|(?:bash|sh|zsh))?\s*[$#]\s+\S"
EXECUTABLE = r"(?i)\b[\w.\-]+\.exe\b"
LOG_LINE = r"(?i)^\s*(?:\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}|\[?(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\]?(?:\s|:)|at\s+[\w.]+\([^)]*\))"
HEADING_LINE = r"(?i)^\s*(?:#{1,6}\s+|\d+(?:\.\d+)*[.)]?\s+|(?:概要|目的|手順|設定|インストール|トラブルシューティング|確認方法)\s*[:：]?)"
CONSOLE_MARKERS = ["Windows PowerShell Copyright", "Copyright (C) Microsoft Corporation. All rights reserved.", "No framework installation found"]
SENTENCE_END = "[\\u3040-\\u30ff\\u4e00-\\u9fff].*(?:す|ます|します|てください|です)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_status(text: Column, legacy: bool = True) -> Column:
    """struct(status, stamp): a status and the date stamp after it; ``legacy`` stamps are digits without a separator."""
    text = stripped(F.coalesce(text, F.lit("")))
    forms = [STATUS_STAMP] + ([LEGACY_STAMP] if legacy else [])
    status, stamp = text, F.lit("")
    for form in reversed(forms):
        body = F.regexp_replace(F.regexp_extract(text, form, 1), "[_\\- ]+$", "")
        status = F.when(text.rlike(form), F.when(body == "", text).otherwise(body)).otherwise(status)
        stamp = F.when(text.rlike(form), F.regexp_extract(text, form, 2)).otherwise(stamp)
    return F.struct(status.alias("status"), stamp.alias("stamp"))


def folder_parts(name: Column) -> Column:
    """struct(company, support_number, status, created_on, stamp) of a folder name; null if it names no case. A created
    date of five or seven digits is null."""
    full = name.rlike(FOLDER)
    part = lambda i: F.when(full, F.regexp_extract(name, FOLDER, i)).otherwise(F.regexp_extract(name, LEGACY_FOLDER, i))
    inner, date = stripped(part(2)), part(1)
    marked, digits = F.contains(inner, F.lit("_")), inner.rlike(LEGACY_INNER)
    company = F.when(marked, F.regexp_extract(inner, "^(.*)_", 1)).when(digits, F.regexp_extract(inner, LEGACY_INNER, 1)).otherwise(inner)
    number = F.when(marked, F.regexp_extract(inner, "_([^_]*)$", 1)).when(digits, F.regexp_extract(inner, LEGACY_INNER, 2)).otherwise("")
    size = F.char_length(date)
    created = F.when(size == 8, date).when(size == 6, F.concat(date, F.lit("01"))).when(size == 4, F.concat(date, F.lit("0101")))
    state = split_status(part(3))
    out = F.struct(
        stripped(company).alias("company"),
        stripped(number).alias("support_number"),
        state["status"].alias("status"),
        created.alias("created_on"),
        state["stamp"].alias("stamp"),
    )
    return F.when(full | name.rlike(LEGACY_FOLDER), out)


def safe_component(text: Column) -> Column:
    """A text as part of a file name: trimmed, characters that names may not have replaced."""
    return F.translate(stripped(F.coalesce(text, F.lit(""))), INVALID, "_" * len(INVALID))


def folder_name(created: Column, company: Column, support_number: Column, status: Column, stamp: Column) -> Column:
    """``created(company_number)status_stamp`` of safe parts; without number or stamp their mark goes too."""
    number, end = safe_component(support_number), safe_component(stamp)
    inner = F.concat(safe_component(company), F.when(number != "", F.concat(F.lit("_"), number)).otherwise(""))
    state = safe_component(split_status(status, legacy=False)["status"])
    return F.concat(created, F.lit("("), inner, F.lit(")"), state, F.when(end != "", F.concat(F.lit("_"), end)).otherwise(""))


def iso_timestamp(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, with six digits of a second's fraction only if there is one."""
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def note_kind(file_name: Column, kinds: dict[str, list[str]]) -> Column:
    """The kind of note that a file name begins with (its label, or one of the old prefixes, before a "_" or the ending)."""
    stem = F.regexp_replace(file_name, r"(?i)\.txt$", "")
    out = F.lit(None).cast("string")
    for kind, prefixes in reversed(kinds.items()):
        hit = F.lit(False)
        for p in [kind, *prefixes]:
            hit = hit | (stem == p) | stem.startswith(f"{p}_")
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_of(path), r"\.([^.]*)$", 1))


def file_of(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_category(path: Column) -> Column:
    """Whether a file is read as a document or an archive, or why not."""
    ending, out = extension(path), F.lit(OTHER_CATEGORY)
    for name, endings in reversed(FILE_CATEGORIES.items()):
        out = F.when(ending.isin(endings), F.lit(name)).otherwise(out)
    return out


def under_root(path: Column, root: str) -> Column:
    """Whether a path lies anywhere under a root, or is it; case and the kind of slash do not count."""
    flat, top = F.lower(F.translate(path, "\\", "/")), root.replace("\\", "/").rstrip("/").lower()
    return (F.rtrim(flat, F.lit("/")) == top) | flat.startswith(top + "/")


def direct_child(path: Column, root: str) -> Column:
    """Whether a path lies in the root itself."""
    flat, top = F.rtrim(F.lower(F.translate(path, "\\", "/")), F.lit("/")), root.replace("\\", "/").rstrip("/").lower()
    return F.regexp_replace(flat, "/[^/]*$", "") == top


def content_scores(path: Column, text: Column) -> Column:
    """struct(manual, log, command, narrative, heading, excluded): how much a text file looks like a manual, a log or
    commands; it is excluded if it is output and explains less than that."""
    name = F.regexp_replace(file_of(path), r"\.[^.]*$", "")
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1), stripped), lambda x: x != "")
    has = lambda pattern: lambda x: x.rlike(pattern)
    count = lambda test: F.size(F.filter(lines, test))
    told = lambda x: x.rlike("[。．.：:]") | x.rlike(SENTENCE_END) | (F.regexp_count(x, F.lit(r"\b[A-Za-z]{3,}\b")) >= 5)
    narrates = lambda x: (F.char_length(x) >= 12) & ~x.rlike(LOG_LINE) & ~x.rlike(SHELL_PROMPT) & ~x.rlike(DRIVE_PROMPT) & told(x)
    marker = lambda x: sum((F.contains(F.lower(x), F.lit(m.lower())).cast("int") for m in CONSOLE_MARKERS), F.lit(0))
    prompts = count(lambda x: x.rlike(SHELL_PROMPT) | x.rlike(DRIVE_PROMPT) | x.rlike(UNIX_PROMPT) | (x.rlike(EXECUTABLE) & ~narrates(x)))
    logs, headings, size = count(has(LOG_LINE)), count(has(HEADING_LINE)), F.size(lines)
    told_lines = count(lambda x: narrates(x) & (marker(x) == 0))
    commands = F.regexp_count(text, F.lit(EXECUTABLE))
    ratio = lambda n: F.least(F.lit(5), F.round(n / F.greatest(F.lit(1), size) * 5).cast("int"))
    manual = F.when(name.rlike(MANUAL_NAME), 4).otherwise(0) + F.least(F.lit(3), headings) + F.least(F.lit(2), told_lines)
    log = F.when(name.rlike(LOG_NAME), 3).otherwise(0) + F.least(F.lit(4), marker(text) * 2) + ratio(logs)
    command = F.least(F.lit(5), prompts + F.when(commands >= 3, 2).when(commands > 0, 1).otherwise(0))
    heading, narrative = F.least(F.lit(5), headings), ratio(told_lines)
    pure = (size > 0) & (logs + prompts >= F.greatest(F.lit(2), F.ceil(size * 0.65))) & (told_lines <= 1)
    explains = manual + heading + F.least(F.lit(3), told_lines)
    output = log + F.when(pure, 2).otherwise(0)
    excluded = (pure | ((log >= 5) & (narrative <= 1))) & (output > explains)
    return F.struct(manual.alias("manual"), log.alias("log"), command.alias("command"), narrative.alias("narrative"), heading.alias("heading"), excluded.alias("excluded"))
