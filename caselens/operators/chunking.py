"""Documents to chunks, lines and normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import chunk_id, chunk_texts, nfkc

# What makes a line a heading, and the categories of lines in the order in which they are tried.
MARKDOWN_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
PLAIN_HEADING = r"^\s*((?:第[^\s]{1,20}[章節]|質問|お問い合わせ|問い合わせ|原因|対処|対応|解決策|回答|メーカー回答|お客様向け最終回答))\s*[:：]?\s*$"
LINE_CATEGORIES = [
    ("signature", r"(?i)^(?:署名|signature)\s*[:：]?$"),
    ("quoted_mail", r"(?i)^(?:-{2,}\s*Original Message\s*-{2,}|-{2,}\s*転送メッセージ\s*-{2,})$"),
    ("quoted_mail", r"^>"),
    ("greeting", r"(?i)^(?:いつも)?お世話になっております[。.]?$|^Dear\s+[^,]+[,]?$"),
    ("webinar", r"(?i)(?:オンラインセミナー|ウェビナー|\bwebinar\b)"),
    ("generated_header", r"^\s*\*{3,}.*(?:追記部|受付|調査中|回答済み).*\*{3,}\s*$"),
    ("separator", r"^\s*[-=_*]{5,}\s*$"),
]
#: The categories that, once begun, hold to the end of the text (the first two patterns).
BLOCK_RULES = 2


def _cut(rows: DataFrame, keep: list[str], maximum: int, overlap: int, out: str) -> DataFrame:
    """(keep..., out, text): the fixed chunks of each row's text. The texts are cut before they are dealt out, so a chunk
    does not carry the whole of its text."""
    cut = rows.select(*keep, chunk_texts(F.col("text"), maximum, overlap).alias("_texts"))
    return cut.select(*keep, F.posexplode("_texts").alias(out, "text"))


def fixed_chunks(docs: DataFrame, key: str, maximum: int = 1200, overlap: int = 120, columns: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns..., chunk_index, text, chunk_id): pieces of ``maximum`` characters that overlap; an empty text has none."""
    chunks = _cut(docs, [key, *columns], maximum, overlap, "chunk_index")
    return chunks.withColumn("chunk_id", chunk_id(F.col(key), "fixed", F.col("chunk_index"), F.lit(None).cast("string"), F.col("text")))


def _resplit(rows: DataFrame, key: str, strategy: str, order: list[str], maximum: int) -> DataFrame:
    """Cuts each section (key, order..., section_title, text) to ``maximum`` characters and numbers a document's chunks."""
    rows = _cut(rows, [key, *order, "section_title"], maximum, 0, "_n")
    w = Window.partitionBy(key).orderBy(*order, "_n")
    rows = rows.withColumn("chunk_index", F.row_number().over(w) - 1)
    rows = rows.withColumn("chunk_id", chunk_id(F.col(key), strategy, F.col("chunk_index"), F.col("section_title"), F.col("text")))
    return rows.select(key, "chunk_index", "chunk_id", "section_title", "text")


def paragraph_chunks(docs: DataFrame, key: str, maximum: int = 1200) -> DataFrame:
    """(key, chunk_index, chunk_id, section_title, text): paragraphs (parted by blank lines), trimmed and cut."""
    parts = docs.select(key, F.posexplode(F.split("text", r"\n\s*\n")).alias("_p", "text"))
    parts = parts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).withColumn("section_title", F.lit(None).cast("string"))
    return _resplit(parts, key, "paragraph", ["_p"], maximum)


def heading_title(line: Column) -> Column:
    """The title if the line is a Markdown or plain heading, else null."""
    found = F.coalesce(F.nullif(F.regexp_extract(line, MARKDOWN_HEADING, 1), F.lit("")), F.nullif(F.regexp_extract(line, PLAIN_HEADING, 1), F.lit("")))
    return F.trim(found)


def section_lines(docs: DataFrame, key: str, title, first: bool = False) -> DataFrame:
    """(key, section, title, lines): each line for which ``title`` (a function of the line) is not null begins a section
    and is its first line; lines before the first such one are a section too. With ``first`` only the first line of a text
    can have a title, and carriage returns end no line. Sections are found within the row of the document, so nothing is shuffled."""
    lines = F.split(F.col("text") if first else F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1)
    titled = F.transform(F.slice(lines, 1, 1) if first else lines, lambda line, i: F.struct(i.alias("at"), title(line).alias("title")))
    begins = F.filter(titled, lambda x: (x["at"] == 0) | x["title"].isNotNull())
    rows = _spans(docs.select(key, lines.alias("_lines"), begins.alias("_begins")), key, "section")
    return rows.select(key, "section", "_b.title", F.slice("_lines", F.col("_b.at") + 1, F.col("_stop") - F.col("_b.at")).alias("lines"))


def _spans(rows: DataFrame, key: str, out: str) -> DataFrame:
    """(key, _lines, out, _b, _stop): each of ``_begins`` (structs with at, in order) with its number and where the next one stands, or
    the lines end. What begins is paired with what follows it: an array looked up by place in a function of its members is
    computed anew for each of them."""
    behind = F.slice("_begins", 2, F.greatest(F.size("_begins"), F.lit(1)))
    paired = F.zip_with("_begins", behind, lambda own, after: F.struct(own.alias("b"), after["at"].alias("stop")))
    each = rows.select(key, "_lines", F.posexplode(paired).alias(out, "_p"))
    return each.select(key, "_lines", out, F.col("_p.b").alias("_b"), F.coalesce("_p.stop", F.size("_lines")).alias("_stop"))


def sections(docs: DataFrame, key: str, title, first: bool = False) -> DataFrame:
    """(key, section, section_title, text) of ``section_lines``, trimmed."""
    rows = section_lines(docs, key, title, first)
    text = F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")
    return rows.select(key, "section", F.col("title").alias("section_title"), text.alias("text"))


def heading_chunks(docs: DataFrame, key: str, maximum: int = 1200, title=heading_title, first: bool = False) -> DataFrame:
    """(key, chunk_index, chunk_id, section_title, text) by sections of ``title``, with ``first`` by the first line's alone."""
    return _resplit(sections(docs, key, title, first), key, "heading", ["section"], maximum)


def line_category(line: Column) -> Column:
    """The first category whose pattern the trimmed line meets, else null."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LINE_CATEGORIES):
        out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def classified_lines(docs: DataFrame, key: str, excluded: list[str]) -> DataFrame:
    """(key, line_no, line, category): every line, trimmed on the right. A signature or a forwarded mail runs to the
    end of the text if its category is one of ``excluded``."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    own = line_category(F.col("line"))
    begins = F.lit(None).cast("string")
    for name, pattern in reversed(LINE_CATEGORIES[:BLOCK_RULES]):
        if name in excluded:
            begins = F.when(F.regexp_replace("line", r"^\s+", "").rlike(pattern), F.lit(name)).otherwise(begins)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("category", F.coalesce(F.first(begins, ignorenulls=True).over(w), own))


def normalised(docs: DataFrame, key: str, excluded: list[str], blanks: int = 1, compose: bool = False) -> DataFrame:
    """(key, text, removed_lines): the lines of the categories not excluded, trimmed on the right, runs of blank ones cut
    to ``blanks``; with ``compose`` in NFKC form. All within the row of the document."""
    source = nfkc(F.col("text")) if compose else F.col("text")
    lines = docs.select(key, F.transform(F.split(F.regexp_replace(source, r"\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", "")).alias("_lines"))
    block = "|".join(p for n, p in LINE_CATEGORIES[:BLOCK_RULES] if n in excluded)
    begun = F.array_position(F.transform("_lines", lambda x: F.regexp_replace(x, r"^\s+", "").rlike(block)), True) if block else F.lit(0)
    lines = lines.withColumn("_from", begun)
    inside = lambda i: (F.col("_from") == 0) | (i + 1 < F.col("_from"))
    kept = F.filter("_lines", lambda x, i: inside(i) & ~F.coalesce(line_category(x).isin(excluded), F.lit(False)) if excluded else F.lit(True))
    lines = lines.withColumn("_kept", kept)
    text = F.regexp_replace(F.array_join("_kept", "\n"), f"\n{{{blanks + 2},}}", "\n" * (blanks + 1))
    return lines.select(key, F.regexp_replace(text, r"^\n+|\n+$", "").alias("text"), (F.size("_lines") - F.size("_kept")).cast("long").alias("removed_lines"))


# The fields of a support document with the words that head them and their labels, and the application's
# chunks and headings.
STRUCTURED = {
    "question": ("質問", ["質問", "お問い合わせ", "問い合わせ"]),
    "cause": ("原因", ["原因"]),
    "resolution": ("対処", ["対処", "対応", "解決策"]),
    "manufacturer_reply": ("メーカー回答", ["メーカー回答"]),
    "customer_final_reply": ("お客様向け最終回答", ["お客様向け最終回答", "最終回答", "回答"]),
}
APP_MAXIMUM, APP_OVERLAP = 2600, 150
APP_HEADING = r"^\s{0,3}#{1,3}\s+(.+?)\s*#*\s*$"


def field_heading(line: Column) -> Column:
    """struct(label, rest) if a line begins with the word of a field, else null."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s{0,3}#{1,6}\s*", ""), r"^\s+|\s+$", "")
    out = F.lit(None).cast("struct<label:string,rest:string>")
    for label, names in reversed(STRUCTURED.values()):
        for name in reversed(names):
            found = F.struct(F.lit(label).alias("label"), F.regexp_replace(bare, rf"^{name}\s*[:：]?\s*", "").alias("rest"))
            out = F.when(bare.startswith(name), found).otherwise(out)
    return out


def structured_chunks(docs: DataFrame, key: str, maximum: int = 1200) -> DataFrame:
    """(key, chunk_index, chunk_id, section_title, text) by fields: those of the columns named in ``STRUCTURED`` that are
    not empty, each under its label; without any, the parts of the text that a field's word heads; else the whole text."""
    given = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(label).alias("title"), F.concat(F.lit(f"{label}\n"), F.trim(F.col(c))).alias("body"))) for c, (label, _) in STRUCTURED.items() if c in docs.columns]
    kind = "array<struct<title:string,body:string>>"
    columns = F.filter(F.array(*given), lambda x: x.isNotNull()) if given else F.array().cast(kind)
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n", -1)
    begins = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), field_heading(line).alias("head"))), lambda x: x["head"].isNotNull())
    # exploded as one row, so that the lines are split and their heads found once and not anew for each part
    rows = docs.withColumn("_r", F.explode(F.array(F.struct(lines.alias("lines"), begins.alias("begins")))))
    behind = F.slice("_r.begins", 2, F.greatest(F.size("_r.begins"), F.lit(1)))
    stop = lambda after: F.coalesce(after["at"], F.size("_r.lines"))
    rest = lambda own: F.filter(F.array(own["head"]["rest"]), lambda x: x != "")
    body = lambda own, after: F.regexp_replace(F.array_join(F.concat(rest(own), F.slice("_r.lines", own["at"] + 2, F.greatest(F.lit(0), stop(after) - own["at"] - 1))), "\n"), r"^\s+|\s+$", "")
    parsed = F.zip_with("_r.begins", behind, lambda own, after: F.struct(own["head"]["label"].alias("title"), body(own, after).alias("body")))
    parsed = F.transform(F.filter(parsed, lambda x: x["body"] != ""), lambda x: F.struct(x["title"].alias("title"), F.concat(x["title"], F.lit("\n"), x["body"]).alias("body")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("body")))
    rows = rows.select(key, columns.alias("_columns"), parsed.alias("_parsed"), whole.alias("_whole"))
    chosen = F.when(F.size("_columns") > 0, F.col("_columns")).when(F.size("_parsed") > 0, F.col("_parsed")).otherwise(F.col("_whole"))
    each = rows.select(key, F.posexplode(chosen).alias("_s", "_p")).select(key, "_s", F.col("_p.title").alias("section_title"), F.col("_p.body").alias("text"))
    return _resplit(each, key, "structured", ["_s"], maximum)


def app_chunks(files: DataFrame, path: str, maximum: int = APP_MAXIMUM, overlap: int = APP_OVERLAP) -> DataFrame:
    """(path, chunk_index, chunk_id, section_title, text) of the application: sections by Markdown headings of the first
    three levels, cut with an overlap, blank chunks left out; ids are 24 digits of a hash of path, index and section."""
    docs = files.select(F.col(path).alias("_path"), "text")
    title = lambda line: F.nullif(F.trim(F.regexp_extract(line, APP_HEADING, 1)), F.lit(""))
    rows = section_lines(docs, "_path", title).select("_path", "section", F.coalesce("title", F.lit("")).alias("section_title"), F.array_join("lines", "\n").alias("text"))
    cut = _cut(rows, ["_path", "section", "section_title"], maximum, overlap, "_n").filter(F.regexp_replace("text", r"\s", "") != "")
    cut = cut.withColumn("chunk_index", F.row_number().over(Window.partitionBy("_path").orderBy("section", "_n")) - 1)
    material = F.concat_ws("|", "_path", F.col("chunk_index").cast("string"), "section_title")
    return cut.select(F.col("_path").alias(path), "chunk_index", F.substring(F.sha2(material, 256), 1, 24).alias("chunk_id"), "section_title", "text")
