"""The application's queries over the driver tables: folder names, notes, files, search, sources and lists of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import names
from caselens.functions.text import bigram_dice, date_text, fold, jaccard, occurrences, ochiai
from caselens.operators import cases, chunking, incremental, notes, pairs, replies, retrieval, scoring, search, sources

from .retrieval import BM25, TOP, asked, documents, read


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as case folders: names in the present form, in old forms, and some that name no case."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    date, kind = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 8
    status = F.when(F.col("o_orderstatus") == "O", "open case").when(F.col("o_orderstatus") == "F", " closed ").otherwise("pending/part")
    new = names.folder_name(date, F.col("c_name"), F.col("o_orderkey").cast("string"), status, F.date_format("o_orderdate", "yyyyMMdd"))
    name = (
        F.when(kind == 0, F.concat(F.substring(date, 1, 6), F.lit("("), F.col("c_name"), F.lit(")done 2024")))
        .when(kind == 1, F.concat(F.substring(date, 1, 4), F.lit("(Old Company 777)"), F.lit("done")))
        .when(kind == 2, F.concat(F.lit("archive-"), F.col("o_orderkey").cast("string")))
        .when(kind == 3, F.concat(date, F.lit("(Plain)open-20240102")))
        .otherwise(new)
    )
    return rows.select("o_orderkey", name.alias("name"))


_FOLDERS = r"""folders AS (
    SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN strftime(o_orderdate, '%Y%m') || '(' || c_name || ')done 2024'
        WHEN 1 THEN strftime(o_orderdate, '%Y') || '(Old Company 777)done'
        WHEN 2 THEN 'archive-' || o_orderkey
        WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') || '(Plain)open-20240102'
        ELSE strftime(o_orderdate, '%Y%m%d') || '(' || c_name || '_' || o_orderkey || ')'
             || CASE o_orderstatus WHEN 'O' THEN 'open case' WHEN 'F' THEN 'closed' ELSE 'pending_part' END || '_' || strftime(o_orderdate, '%Y%m%d') END AS name
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def case_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folders(spark, sf_dir).withColumn("p", names.folder_parts(F.col("name")))
    return rows.select("o_orderkey", "name", "p.*")


def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(0)
    return read(spark, sf_dir, "events").select("event_id", names.iso_timestamp(F.timestamp_micros(micros)).alias("iso"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("o_orderkey") % 3 == 0, 8).when(F.col("o_orderkey") % 3 == 1, 6).otherwise(4)
    return read(spark, sf_dir, "orders").select("o_orderkey", date_text(F.substr(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(1), size)).alias("created"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as one note: an introduction, then a segment a turn; every third has no time."""
    rows = read(spark, sf_dir, "conversations").filter("conv_id is not null")
    time = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(mins=F.col("turn").cast("int") * 7)
    header = F.when(F.col("turn") % 3 == 2, F.concat(F.lit(notes.HEADER), F.lit("(x)******")))
    entry = notes.entry(time, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    entry = F.when(header.isNotNull(), F.concat_ws("\n", header, F.element_at(F.split(entry, "\n", 2), 2))).otherwise(entry)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), "\n")
    return rows.groupBy("conv_id").agg(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("before\n"), body)).otherwise(body).alias("text"))


_NOTES = r"""turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
    FROM conversations WHERE conv_id IS NOT NULL),
    segments AS (
        SELECT conv_id, n + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS index, body,
               CASE WHEN turn % 3 = 2 THEN '*****追記部_(x)******'
                    ELSE '*****追記部_' || strftime(TIMESTAMP '2024-01-01' + INTERVAL (turn * 7) MINUTE, '%Y/%m/%d %H:%M:%S') || '(' || role || ')******' END AS header,
               CASE WHEN turn % 3 <> 2 THEN TIMESTAMP '2024-01-01' + INTERVAL (turn * 7) MINUTE END AS time
        FROM turns
        UNION ALL SELECT DISTINCT conv_id, 0, 'before', '', NULL FROM turns WHERE conv_id % 2 = 0)"""


def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.ordered(notes.segments(_notes(spark, sf_dir), "conv_id"), "conv_id")
    return rows.select("conv_id", "index", "header", F.char_length("body").alias("n_chars"), F.unix_seconds("time").alias("seconds"), "place")


def note_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.latest(notes.segments(_notes(spark, sf_dir), "conv_id"), "conv_id")
    return rows.select("conv_id", "index", "header")


def note_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers appended to the notes of their questions."""
    rows = read(spark, sf_dir, "conversations").filter("conv_id is not null")
    old = rows.filter("turn = 0").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    new = rows.filter("turn = 1").select("conv_id", F.to_timestamp(F.lit("2024-05-06 07:08:09")).alias("time"), F.lit("done").alias("status"), F.coalesce("text", F.lit("")).alias("body"))
    return notes.appended(old, new, "conv_id").select("conv_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("content"))


ENDINGS = ["txt", "PDF", "zip", "png", "exe", "bin", "Html"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 5 == 0, F.lit("/manuals")).otherwise(F.concat(F.lit("/manuals/"), F.coalesce("source", F.lit("none"))))
    name = F.when(F.col("doc_id") % 4 == 0, "user_guide_").when(F.col("doc_id") % 4 == 1, "build-log ").otherwise("text")
    return documents(spark, sf_dir, "source").select("doc_id", F.concat(folder, F.lit("/"), name, F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


_FILES = """files AS (
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/manuals' ELSE '/manuals/' || coalesce(source, 'none') END || '/'
           || CASE doc_id % 4 WHEN 0 THEN 'user_guide_' WHEN 1 THEN 'build-log ' ELSE 'text' END || doc_id || '.'
           || ['txt', 'PDF', 'zip', 'png', 'exe', 'bin', 'Html'][doc_id % 7 + 1] AS path, coalesce(text, '') AS text
    FROM documents)"""


def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    return rows.select("doc_id", names.file_of(F.col("path")).alias("file"), names.file_category(F.col("path")).alias("category"), names.direct_child(F.col("path"), "/Manuals/").alias("direct"), names.under_root(F.col("path"), "\\manuals\\web").alias("web"))


def content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, every third with lines of a log before them."""
    log = F.concat(F.repeat(F.lit("2024-01-02 03:04:05 INFO started\n$ run x\n"), 40), F.lit("\n"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(log, "text")).otherwise(F.col("text"))
    return _files(spark, sf_dir).select("doc_id", names.content_scores(F.col("path"), text).alias("s")).select("doc_id", "s.*")


def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.build_counters(_scanned(spark, sf_dir))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    first = incremental.first_per_content(rows.select("doc_id", F.sha2("text", 256).alias("content")), F.col("content"), ["doc_id"]).select("doc_id", F.lit(False).alias("duplicate"))
    rows = rows.join(first, "doc_id", "left")
    return rows.select(
        names.extension(F.col("path")).alias("extension"), names.file_category(F.col("path")).alias("category"), F.coalesce("duplicate", F.lit(True)).alias("duplicate"),
        F.char_length("text").alias("characters"), (F.col("doc_id") % 11 == 0).alias("failed"),
    )


def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.extension_counts(_scanned(spark, sf_dir))


_CATEGORY = """CASE WHEN {e} IN ('txt', 'pdf', 'html') THEN 'ImportCandidate' WHEN {e} = 'zip' THEN 'ArchiveCandidate'
    WHEN {e} = 'png' THEN 'UnsupportedDocumentFormat' WHEN {e} = 'exe' THEN 'OutOfScopeBinaryOrArchive' ELSE 'UnsupportedOther' END"""
_SCANNED = f"""{_FILES}, scanned AS (
    SELECT lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS extension, {_CATEGORY.format(e="lower(regexp_extract(path, '\\.([^.]*)$', 1))")} AS category,
           row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate, length(text) AS characters, doc_id % 11 = 0 AS failed
    FROM files)"""


def archive_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("path", F.sha2("text", 256).alias("content"), (F.col("doc_id") % 2 == 0).alias("is_archive_entry"))
    return incremental.files_before_archives(rows, F.col("content")).select("path", "is_archive_entry")


def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and last day of the lines of each supplier: an order is a document, a line a chunk."""
    return incremental.manifest(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "l_shipdate").select("l_suppkey", "documents", "chunks", F.date_format("last_updated", "yyyyMMdd").alias("last"))


def note_file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one index against another: every ninth is gone, every seventh has another time, every fifth is new."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"))
    old = rows.filter("path % 5 > 0")
    new = rows.filter("path % 9 > 0").withColumn("modified", F.col("modified") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return incremental.file_diff(old, new, "path", "modified").groupBy("change").agg(F.count("*").alias("files"), F.sum("path").alias("checksum"))


def case_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases whose notes are their lines: unchanged if no line is gone, new or changed."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("content"))
    old = rows.filter("l_orderkey % 10 <> 3")
    new = rows.filter("not (l_orderkey % 4 = 0 and l_linenumber = 1)").withColumn("content", F.when(F.col("l_orderkey") % 6 == 1, F.col("content") + 1).otherwise(F.col("content")))
    return incremental.group_diff(old, new, "l_orderkey", "l_linenumber", "content")


def same_url_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's parts are those of its lines on the first ship mode flag alone, as sets."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("a"), F.collect_list(F.when(F.col("l_linenumber") < 3, F.col("l_suppkey"))).alias("b"))
    return rows.select("l_orderkey", incremental.same_set(F.col("a"), F.col("b")).alias("same"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.conflict_pairs(read(spark, sf_dir, "part").select("p_brand", "p_size"), "p_brand", "p_size")


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 under each filter mode: a document's language stands for its product, its source for its version. Statistics
    are those of all chunks."""
    queries = asked(spark, sf_dir)
    form = lambda c: F.trim(fold(F.col(c)))
    docs = documents(spark, sf_dir, "lang", "source").select(F.col("doc_id").alias("document_id"), "text", form("lang").alias("product"), form("source").alias("version"))
    own = ("product", "version")
    index = retrieval.indexed(chunking.fixed_chunks(docs, "document_id", columns=own), columns=own)
    wanted = queries.select("query_id", F.when(F.col("query_id") % 4 > 0, "en").alias("product"), F.when(F.col("query_id") % 3 > 0, F.lit("Web")).alias("version"))
    scores = retrieval.written(scoring.leading(index, queries, {"bm25": TOP}, retrieval.passes(wanted), own), "leading")
    out = None
    for mode in retrieval.FILTER_MODES:
        part = retrieval.ranked(scores.filter(F.col("filter_mode") == mode), TOP).select("filter_mode", "query_id", "document_id", "chunk_index", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manuals: the first line is the title, the language the section, the source the file."""
    rows = documents(spark, sf_dir, "lang", "source")
    rows = rows.select("doc_id", F.element_at(F.split("text", "\n", 2), 1).alias("title"), F.col("lang").alias("section_title"), F.col("source").alias("file_name"), "text")
    found = search.scored(rows, ["doc_id"], search.FIELDS["manuals"], asked(spark, sf_dir), TOP)
    top = retrieval.ranked(found.withColumnRenamed("doc_id", "document_id").withColumn("chunk_index", F.lit(0)), TOP)
    return top.select("query_id", "document_id", "score", "covered", "terms", F.array_join("matched_terms", " ").alias("matched"), "rank")


def manual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manuals in that search's own order: those of a third of the numbers end with a procedure, of a fifth begin with a
    table of contents; a third of the questions asks how to do it."""
    d = F.col("doc_id")
    text = F.concat(F.when(d % 5 == 0, "目次 ").otherwise(""), F.coalesce("text", F.lit("")), F.when(d % 3 == 0, " create > ").otherwise(""))
    rows = documents(spark, sf_dir, "lang", "source").select("doc_id", F.element_at(F.split("text", "\n", 2), 1).alias("title"), F.col("lang").alias("section_title"), F.col("source").alias("file_name"), text.alias("text"))
    n = F.col("query_id")
    queries = asked(spark, sf_dir).select("query_id", F.concat("query", F.when(n % 3 == 0, " how to create it by GUI and CLI").otherwise("")).alias("query"))
    found = search.found(rows, ["doc_id"], "manuals", queries, 5)
    return found.select("query_id", "doc_id", "boost", "score", "rank")


def contents_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a list of contents put before them by their number, and what it costs."""
    entry = F.lit("設定する12 A ")
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("目次 "), "html")).otherwise(F.concat(F.expr("repeat('設定する12 A ', cast(page_id % 9 as int))"), "html"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.coalesce(text, entry).alias("t"))
    penalty = search.contents_penalty(F.col("t"))
    score = (F.col("page_id") % 10) / 10
    return rows.select("page_id", penalty.alias("penalty"), F.round(search.bounded(score, -penalty), 6).alias("lowered"), F.round(search.bounded(score, penalty), 6).alias("raised"))


def normal_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an address, a case number and a greeting put before them."""
    head = F.lit("株式会社テスト 様\nいつもお世話になっております。\nCase ID: AB-12 2024/01/02 10:30 mail a.b@example.com\n")
    rows = read(spark, sf_dir, "conversations").filter("role = 'user' and conv_id is not null")
    normal = pairs.normal_question(F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n-----\nTEL 03")))
    return rows.select("conv_id", "turn", normal.alias("normal"), pairs.question_hash(normal).alias("question_hash"))


def pair_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against their type: the ladder of matches of a stored question."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question_text"), F.col("p_type").alias("query"), (F.col("p_size") / 50).alias("keyword"))
    kind = F.col("p_partkey") % 5
    query = F.when(kind == 0, F.col("question_text")).when(kind == 1, F.concat(F.upper("question_text"), F.lit("!"))).when(kind == 2, F.concat("question_text", F.lit(" xy"))).otherwise(F.col("query"))
    rows = rows.withColumn("query", query)
    rows = rows.withColumns({"normal_query": pairs.normal_question(F.col("query")), "normal_question": pairs.normal_question(F.col("question_text"))})
    rows = rows.withColumns({"query_hash": F.when(kind == 3, F.upper(pairs.question_hash(F.col("normal_question")))).otherwise(pairs.question_hash(F.col("normal_query"))), "question_hash": pairs.question_hash(F.col("normal_question"))})
    return pairs.matched(rows).select("p_partkey", "match_order", "score")


def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.date_format("o_orderdate", "yyyyMM"), 256).alias("question_hash"), F.concat(F.lit(" "), "o_orderpriority").alias("customer_reply_text"))
    return pairs.distinct_pairs(rows, [F.desc("o_orderkey")]).select("o_orderkey")


def set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts beside their types: Jaccard, Ochiai and bigram similarity, and how often a letter occurs."""
    words = lambda c: F.split(F.lower(c), " ")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(jaccard(words("p_name"), F.concat(words("p_type"), F.array(F.element_at(words("p_name"), 1)))), 6).alias("jaccard"),
        F.round(ochiai(words("p_name"), F.concat(words("p_type"), F.array(F.element_at(words("p_name"), 1)))), 6).alias("ochiai"),
        F.round(bigram_dice(F.col("p_name"), F.col("p_type")), 6).alias("dice"),
        occurrences(F.col("p_name"), F.lit("a")).alias("times"),
    )


TYPES = ["OfficialDoc", "Manual", "ExactPastAnswer", "PastAnswer", "PastCaseNote", "Other", "officialdoc"]


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as search results: 50 orders share a query; the discount gives the score, the flags what is chosen."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 50).alias("query_id"),
        kind.alias("source_type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_id"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 10, 2)).alias("score"),
        F.col("l_returnflag").alias("product_name"),
        F.col("l_shipdate").alias("retrieved_at"),
        ((F.floor(F.col("l_orderkey") / 50) % 2) == 0).alias("fresh"),
        (F.col("l_linestatus") == "O").alias("selected"),
        (F.col("l_quantity") > 48).alias("manual"),
        (F.col("l_quantity") < 3).alias("excluded"),
        F.when(F.col("l_quantity") > 25, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>")).alias("matched_terms"),
    )


_RESULTS = """results AS (
    SELECT l_orderkey // 50 AS query_id, ['OfficialDoc', 'Manual', 'ExactPastAnswer', 'PastAnswer', 'PastCaseNote', 'Other', 'officialdoc'][l_linenumber] AS source_type,
           concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_id, CASE WHEN l_tax > 0 THEN round(l_discount * 10, 2) END AS score, coalesce(CASE WHEN l_tax > 0 THEN round(l_discount * 10, 2) END, 0) AS s,
           l_returnflag AS product_name, l_shipdate AS retrieved_at, (l_orderkey // 50) % 2 = 0 AS fresh, l_linestatus = 'O' AS selected, l_quantity > 48 AS manual, l_quantity < 3 AS excluded,
           l_quantity > 25 AS matched, lower(['OfficialDoc', 'Manual', 'ExactPastAnswer', 'PastAnswer', 'PastCaseNote', 'Other', 'officialdoc'][l_linenumber]) AS t
    FROM lineitem)"""


def visible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.with_selection(_results(spark, sf_dir), "Manual", 0.5, 0.2)
    return sources.visible(rows, "manual", 0.1).select("query_id", "source_id", "selected")


def gated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a question lets pass, with their priority and whether they are taken without being chosen."""
    kind = F.col("query_id") % 4
    types = F.when(kind == 0, F.array(F.lit("LatestVersionQuestion"))).when(kind == 1, F.array(F.lit("TroubleshootingQuestion"), F.lit("HowToQuestion"))).when(kind == 2, F.array(F.lit("HowToQuestion"))).otherwise(F.array(F.lit("GeneralSupportQuestion")))
    rows = sources.relevant(_results(spark, sf_dir).withColumn("types", types), F.when(F.col("query_id") % 3 == 0, "a"), F.col("types"))
    return rows.select("query_id", "source_id", sources.source_priority(F.col("types")).alias("priority"), sources.freshness_priority(F.col("fresh")).alias("fresh_priority"), sources.auto_selected(F.col("fresh"), 0.5).alias("taken"))


def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.selection(_results(spark, sf_dir), 5, 0.95).select("query_id", "source_id", "state")


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.selection_summary(sources.selection(_results(spark, sf_dir), 5, 0.95), 0.95, 0.3, "Manual")


def official_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of lines have indexes: A and N of their first lines, R one that failed, X none; a query's number says what it asks for."""
    rows = sources.selection(_results(spark, sf_dir), 5, 0.95).withColumns({"title": F.col("source_id"), "text": F.col("source_id"), "url": F.lit(None).cast("string")})
    n = F.col("query_id")
    asked_for = rows.select("query_id").distinct().select(
        "query_id", F.get(F.array(*map(F.lit, ["A", "N", "R", "X", None])), (n % 5).cast("int")).alias("product"), (n % 7).alias("document_urls"), F.when(n % 2 == 0, F.array(F.lit("TERM"))).alias("target_versions"),
        F.when(n % 3 > 0, F.array(F.concat(F.lit("F"), (n % 4).cast("string")))).alias("features"),
    )
    lines = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    chunked = lines.filter("l_returnflag <> 'R'").select(F.col("l_returnflag").alias("product"), F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("F"), (F.col("l_suppkey") % 3).cast("string")).alias("feature"))
    index = lines.groupBy(F.col("l_returnflag").alias("product")).agg(F.count_if(F.col("l_returnflag") != "R").alias("chunks"), F.count_if(F.col("l_returnflag") == "R").alias("fetch_failures"))
    return sources.official_diagnostics(asked_for, rows, index, chunked)


def _variants(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _results(spark, sf_dir).select("query_id", "source_type", "source_id", "score", "retrieved_at")
    return [rows, rows.filter("query_id % 3 > 0").withColumn("score", F.round(1 - F.coalesce("score", F.lit(0.0)), 2))]


def variant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of two forms of each query: the best of each source."""
    a, b = _variants(spark, sf_dir)
    return sources.best_per_source(a.unionByName(b), ["query_id", "source_type", "source_id"]).select("query_id", "source_type", "source_id", sources.score_of().alias("score"))


def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _variants(spark, sf_dir)
    return sources.first_wins([b, a], ["query_id", "source_id"]).select("query_id", "source_id", sources.score_of().alias("score"))


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir)
    preferred = rows[0].filter(F.col("score") < 0.2)
    return sources.merged(preferred, rows[1], 8).select("query_id", "source_id", "preferred", "rank")


def displayed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.displayed(_results(spark, sf_dir)).select("query_id", "source_id", "place")


def exact_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.exact_answers(_results(spark, sf_dir), 8).select("query_id", "source_id", "rank")


def limited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.limited_per_type(_results(spark, sf_dir), search.type_limit(2), [F.desc(sources.score_of()), "source_id"]).select("query_id", "source_id")


def represented_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.represented(_results(spark, sf_dir), 8).select("query_id", "source_id")


def quality_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select("query_id", "source_type", "source_id")
    return sources.quality_evidence(rows.filter("source_type = 'Manual'"), rows.filter("query_id % 2 = 0"), ["source_id"])


def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).groupBy("query_id").agg(F.collect_list("source_type").alias("types"))
    return rows.select("query_id", sources.source_counts(F.col("types")).alias("c")).select("query_id", "c.*")


def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, documents, answers and questions as common rows."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("source_id"), "role", F.char_length("text").alias("n_chars"))
    parts = {
        "OfficialDoc": read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", F.char_length("html").alias("n_chars")),
        "Manual": read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("file_name"), F.char_length("text").alias("n_chars")),
        "PastAnswer": turns.filter("role = 'assistant'"),
        "PastCaseNote": turns.filter("role = 'user'"),
    }
    return sources.common_rows({k: v.select("source_id", "n_chars", *(c for c in v.columns if c == "url")) for k, v in parts.items()}, ["source_id", "url", "n_chars"])


def keyword_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.filter(cases.matches_keyword(["o_orderpriority", "o_orderstatus", "o_custkey"], "hIGh")).select("o_orderkey", "o_orderpriority")


def drilled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyyMMdd").alias("created"))
    return cases.drill_down(rows, "o_orderstatus", "created", "F", "1996", 3).unionByName(cases.drill_down(rows, "o_orderstatus", "created", "", "1994", 0))


def looked_up_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("number"), "o_orderstatus")
    return cases.lookup(rows.filter("o_orderstatus = 'P'"), rows.filter("o_orderstatus <> 'P'"), "number", " 00-33 ")


def existing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda k: F.concat(F.when(k % 3 == 0, F.lit("/Base/")).otherwise(F.lit("/other/")), k.cast("string")).alias("path")
    index = read(spark, sf_dir, "orders").select("o_orderkey", path(F.col("o_orderkey")))
    folders = read(spark, sf_dir, "lineitem").filter("l_linenumber = 4").select(path(F.col("l_orderkey")))
    return cases.existing(index, folders, "path", "/base")


def products_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("display_name"), F.col("n_regionkey").alias("sort_order"), (F.col("n_nationkey") % 4 > 0).alias("is_enabled"))
    return cases.in_display_order(rows).select("display_name", "place")


def case_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.categories(_files(spark, sf_dir), "path", "/manuals")


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.repeated_names(read(spark, sf_dir, "part"), F.col("p_name"))


def matched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("product_id"), F.col("n_name").alias("display_name"), F.array(F.substring("n_name", 1, 3)).alias("aliases"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey").cast("string")).when(F.col("s_suppkey") % 3 == 1, F.lit(" canada ")).otherwise(F.substring("s_name", 1, 3))
    wanted = F.when(F.col("s_suppkey") % 7 == 0, F.lit("uni")).otherwise(name)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", wanted.alias("wanted"))
    return cases.matched_product(rows, products, "wanted")


def launched_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _folders(spark, sf_dir).select(F.concat(F.lit("/f/"), "name").alias("path"), "name", F.col("o_orderkey").alias("modified"))
    contexts = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    contexts = contexts.filter("o_orderkey % 3 > 0").select(
        F.col("o_orderkey").alias("context_id"), F.col("o_orderkey").cast("string").alias("support_number"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("c_name")).otherwise("nobody").alias("company"), F.lit("open").alias("status"), F.col("o_orderdate").alias("received"),
    )
    return cases.launch_folder(contexts, folders)


def inserted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' orders added to those with odd keys: of each number only the first, if it is not there."""
    table = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("number"))
    new = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), "l_linenumber")
    return cases.insertable(table, new, "number")


def selector_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as production runs."""
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("value") > F.col("user_id") % 3).alias("matched"), (F.col("event_type") == "error").alias("fallback"), ((F.col("user_id") % 5 == 0) & (F.col("value") > 90)).alias("failed"))
    return replies.selector_readiness(rows, ["user_id"], 60, 0.22)


def cut_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", replies.truncated(F.col("text"), 300).alias("prompt"))


def notes_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as notes in their orders' folders or a folder below, by their number."""
    folders = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("/b/"), F.col("o_orderkey").cast("string")).alias("path"))
    note = F.concat(F.lit("/b/"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 1, "/sub/deep/").when(F.col("l_linenumber") % 2 == 0, "/sub/").otherwise("/"), F.col("l_linenumber").cast("string"), F.lit(".txt"))
    return replies.notes_of_cases(folders, read(spark, sf_dir, "lineitem").select(note.alias("note"))).groupBy("path").agg(F.count("*").alias("notes"))


def topic_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).filter("score is not null").withColumns(
        {"asked_features": F.col("query_id") % 3, "matched_features": F.size("matched_terms"), "feature_conflict": F.col("manual"), "excluded_match": F.col("excluded"), "troubleshooting": F.col("query_id") % 2 == 1}
    )
    adjustment = replies.topic_adjustment(rows)
    return rows.select("query_id", "source_id", F.round(search.bounded(F.col("score"), adjustment), 6).alias("score"))


def closed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of orders, the unknown one last."""
    from pyspark.sql import Window

    year = F.when(F.col("o_orderkey") % 9 == 0, "年不明").otherwise(F.date_format("o_orderdate", "yyyy"))
    rows = read(spark, sf_dir, "orders").select(year.alias("year")).distinct()
    return rows.select("year", F.row_number().over(Window.orderBy(*replies.unknown_last(F.col("year"), "年不明"))).alias("place"))


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {body}" if parts else body


_FLAT = r"trim(regexp_replace(lower({}), '[\s\p{{Pc}}\p{{Pd}}\p{{Ps}}\p{{Pe}}\p{{Pi}}\p{{Pf}}\p{{Po}}\p{{Sm}}\p{{Sc}}\p{{Sk}}\p{{So}}]+', ' ', 'g'))"
_NORMAL = r"""trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '\b[\w.!#$%&''*+/=?^`{{|}}~-]+@[\w.-]+\.[a-z]{{2,}}\b', ' ', 'g'),
    '(?:サポート番号|案件番号|case\s*id)\s*[:：#]?\s*[a-z0-9_-]+', ' ', 'g'),
    '\b20\d{{2}}(?:[./-]\d{{1,2}}[./-]\d{{1,2}}|年\d{{1,2}}月\d{{1,2}}日)(?:\s+\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?', ' ', 'g'),
    '[\p{{L}}\p{{N}}・()（）\s]{{0,50}}(?:株式会社|有限会社|合同会社)[\p{{L}}\p{{N}}・()（）\s]{{0,40}}(?:様|御中)', ' ', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, 'お世話になっております|^(?:tel|fax|〒)|^[-_= ]*$')), ' '),
    '[^\p{{L}}\p{{Nd}}\s.:_\-/\\+#&]', ' ', 'g'), '\s+', ' ', 'g'))"""
_DICE = """CASE WHEN {a} = {b} THEN 1.0 ELSE (
    SELECT 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) FROM (SELECT
        list_distinct(list_transform(range(1, greatest(1, length(replace({a}, ' ', '')))), lambda i: substr(replace({a}, ' ', ''), i, 2))) AS x,
        list_distinct(list_transform(range(1, greatest(1, length(replace({b}, ' ', '')))), lambda i: substr(replace({b}, ' ', ''), i, 2))) AS y)) END"""

QUERIES: dict[str, tuple] = {
    "case_folders": (
        case_folders,
        _sql(
            r"""SELECT o_orderkey, name, CASE o_orderkey % 8 WHEN 0 THEN 'Customer#' WHEN 1 THEN 'Old Company' WHEN 2 THEN NULL WHEN 3 THEN 'Plain' ELSE regexp_extract(name, '\(([^)]*)_', 1) END AS company,
                CASE o_orderkey % 8 WHEN 0 THEN regexp_extract(name, '#(\d+)\)', 1) WHEN 1 THEN '777' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE o_orderkey::VARCHAR END AS support_number,
                CASE o_orderkey % 8 WHEN 0 THEN 'done' WHEN 1 THEN 'done' WHEN 2 THEN NULL WHEN 3 THEN 'open' ELSE regexp_extract(name, '\)(.*)_\d{8}$', 1) END AS status,
                CASE o_orderkey % 8 WHEN 0 THEN substr(name, 1, 6) || '01' WHEN 1 THEN substr(name, 1, 4) || '0101' WHEN 2 THEN NULL ELSE substr(name, 1, 8) END AS created_on,
                CASE o_orderkey % 8 WHEN 0 THEN '2024' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '20240102' ELSE right(name, 8) END AS stamp FROM folders""",
            _FOLDERS,
        ),
    ),
    "iso_timestamps": (
        iso_timestamps,
        """SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(moment) % 1000000 = 0 THEN '' ELSE strftime(moment, '.%f') END AS iso
           FROM (SELECT event_id, make_timestamp(epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS moment FROM events)""",
    ),
    "date_texts": (
        date_texts,
        """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE date_trunc('year', o_orderdate)::DATE END AS DATE) AS created FROM orders""",
    ),
    "note_segments": (
        note_segments,
        _sql(
            """SELECT conv_id, index, header, length(body) AS n_chars, epoch(time)::BIGINT AS seconds,
                  row_number() OVER (PARTITION BY conv_id ORDER BY time DESC NULLS LAST, CASE WHEN time IS NULL THEN index ELSE -index END) AS place FROM segments""",
            _NOTES,
        ),
    ),
    "note_latest": (
        note_latest,
        _sql("SELECT conv_id, index, header FROM segments QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY body = '', time DESC NULLS LAST, index DESC) = 1", _NOTES),
    ),
    "note_append": (
        note_append,
        r"""WITH a AS (SELECT conv_id, regexp_replace(coalesce(text, ''), '[\r\n]+$', '') AS old FROM conversations WHERE turn = 0 AND conv_id IS NOT NULL),
            b AS (SELECT conv_id, '*****追記部_2024/05/06 07:08:09(done)******' || chr(10) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') || chr(10) || repeat('-', 50) AS new
                  FROM conversations WHERE turn = 1 AND conv_id IS NOT NULL),
            c AS (SELECT conv_id, concat_ws(chr(10), nullif(old, ''), new) AS text FROM a FULL JOIN b USING (conv_id))
            SELECT conv_id, length(text) AS n_chars, sha256(text) AS content FROM c""",
    ),
    "file_categories": (
        file_categories,
        _sql(
            f"""SELECT doc_id, regexp_extract(path, '[^/]*$') AS file, {_CATEGORY.format(e="lower(regexp_extract(path, '\\.([^.]*)$', 1))")} AS category, doc_id % 5 = 0 AS direct,
                   path LIKE '/manuals/web/%' AS web FROM files""",
            _FILES,
        ),
    ),
    "content_classes": (
        content_classes,
        _sql(
            r"""t AS (SELECT doc_id, doc_id % 4 = 0 AS manual_name, doc_id % 4 = 1 AS log_name,
                    CASE WHEN doc_id % 3 = 0 THEN repeat('2024-01-02 03:04:05 INFO started' || chr(10) || '$ run x' || chr(10), 40) || chr(10) || text ELSE text END AS text FROM files),
            l AS (SELECT *, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM t),
            k AS (SELECT *, list_transform(lines, lambda x: {'log': regexp_matches(x, '(?i)^\s*(?:\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}|\[?(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\]?(?:\s|:)|at\s+[\w.]+\([^)]*\))'),
                    'shell': regexp_matches(x, '(?i)^\s*PS\s+[A-Z]:\\') OR regexp_matches(x, '(?i)^\s*[A-Z]:\\[^>\r\n]*>'),
                    'unix': regexp_matches(x, '(?i)^\s*(?:[\w.-]+@[^\s:]+(?::[^$#]+)?|(?:bash|sh|zsh))?\s*[$#]\s+\S'), 'exe': regexp_matches(x, '(?i)\b[\w.\-]+\.exe\b'),
                    'head': regexp_matches(x, '(?i)^\s*(?:#{1,6}\s+|\d+(?:\.\d+)*[.)]?\s+|(?:概要|目的|手順|設定|インストール|トラブルシューティング|確認方法)\s*[:：]?)'),
                    'told': length(x) >= 12 AND (regexp_matches(x, '[。．.：:]') OR len(list_filter(regexp_split_to_array(x, '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Za-z]{3,}$'))) >= 5)}) AS ks FROM l),
            c AS (SELECT *, len(lines) AS size, len(list_filter(ks, lambda k: k.log)) AS logs, len(list_filter(ks, lambda k: k.head)) AS heads,
                    len(list_filter(ks, lambda k: k.told AND NOT k.log AND NOT k.shell)) AS told,
                    len(list_filter(ks, lambda k: k.shell OR k.unix OR (k.exe AND NOT (k.told AND NOT k.log AND NOT k.shell)))) AS prompts, len(regexp_extract_all(text, '(?i)\b[\w.\-]+\.exe\b')) AS exes FROM k),
            s AS (SELECT *, CASE WHEN manual_name THEN 4 ELSE 0 END + least(3, heads) + least(2, told) AS manual,
                    CASE WHEN log_name THEN 3 ELSE 0 END + least(5, round(logs / greatest(1, size) * 5)::INTEGER) AS log,
                    least(5, prompts + CASE WHEN exes >= 3 THEN 2 WHEN exes > 0 THEN 1 ELSE 0 END) AS command, least(5, round(told / greatest(1, size) * 5)::INTEGER) AS narrative, least(5, heads) AS heading,
                    size > 0 AND logs + prompts >= greatest(2, ceil(size * 0.65)) AND told <= 1 AS pure FROM c)
            SELECT doc_id, manual, log, command, narrative, heading, (pure OR (log >= 5 AND narrative <= 1)) AND log + CASE WHEN pure THEN 2 ELSE 0 END > manual + heading + least(3, told) AS excluded FROM s""",
            _FILES,
        ).replace("FROM documents) t AS", "FROM documents), t AS"),
    ),
    "build_counters": (
        build_counters,
        _sql(
            """SELECT count(*) AS scanned, count(*) FILTER (r) AS supported, count(*) FILTER (NOT r) AS skipped, count(*) FILTER (r AND duplicate) AS duplicates,
                  count(*) FILTER (r AND NOT duplicate AND characters = 0) AS empty, count(*) FILTER (failed) AS failures,
                  count(*) FILTER (r AND NOT duplicate AND characters > 0 AND NOT failed) AS indexed FROM (SELECT *, category = 'ImportCandidate' AS r FROM scanned)""",
            _SCANNED,
        ),
    ),
    "extension_counts": (extension_counts, _sql("SELECT category, extension, count(*) AS files FROM scanned GROUP BY ALL", _SCANNED)),
    "archive_copies": (
        archive_copies,
        _sql("SELECT path, doc_id % 2 = 0 AS is_archive_entry FROM files QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 2 = 0, path) = 1", _FILES),
    ),
    "chunk_manifest": (chunk_manifest, "SELECT l_suppkey, count(DISTINCT l_orderkey) AS documents, count(*) AS chunks, strftime(max(l_shipdate), '%Y%m%d') AS last FROM lineitem GROUP BY l_suppkey"),
    "note_file_diff": (
        note_file_diff,
        """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS files, sum(o_orderkey)::BIGINT AS checksum
           FROM orders WHERE NOT (o_orderkey % 9 = 0 AND o_orderkey % 5 = 0) GROUP BY ALL""",
    ),
    "case_diff": (
        case_diff,
        """WITH o AS (SELECT l_orderkey, list(l_linenumber || '|' || l_quantity ORDER BY l_linenumber, l_quantity) AS m FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY ALL),
            n AS (SELECT l_orderkey, list(l_linenumber || '|' || (l_quantity + CASE WHEN l_orderkey % 6 = 1 THEN 1 ELSE 0 END) ORDER BY l_linenumber, l_quantity) AS m FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber = 1) GROUP BY ALL)
            SELECT l_orderkey, CASE WHEN o.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'deleted' WHEN o.m = n.m THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (l_orderkey)""",
    ),
    "same_url_sets": (
        same_url_sets,
        """SELECT l_orderkey, coalesce(list_sort(list(DISTINCT l_suppkey)), []) = coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber < 3)), []) AS same FROM lineitem GROUP BY l_orderkey""",
    ),
    "conflict_pairs": (
        conflict_pairs,
        "WITH v AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size IS NOT NULL) SELECT a.p_brand, a.p_size, b.p_size AS other FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.p_size < b.p_size",
    ),
    "filtered_topk": (
        filtered_topk,
        f"""WITH {BM25},
            m AS (SELECT unnest(['none', 'product', 'product_and_version']) AS filter_mode),
            f AS (SELECT filter_mode, query_id, document_id, chunk_index, score FROM bm25 JOIN documents d ON d.doc_id = document_id, m
                  WHERE (filter_mode = 'none' OR query_id % 4 = 0 OR d.lang = 'en') AND (filter_mode <> 'product_and_version' OR query_id % 3 = 0 OR d.source = 'web'))
            SELECT *, row_number() OVER (PARTITION BY filter_mode, query_id ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM f QUALIFY rank <= 3""",
    ),
    "weighted_search": (
        weighted_search,
        f"""WITH q AS (SELECT item_id AS query_id, term, max(CASE WHEN length(term) >= 4 THEN 1.0 ELSE 0.75 END) AS w
                FROM (SELECT item_id, unnest(string_split({_FLAT.format("text")}, ' ')) AS term FROM benchmark) WHERE length(term) >= 2 AND term NOT IN ('please', 'thanks', 'thank') GROUP BY ALL),
            b AS (SELECT query_id, count(*) AS terms, greatest(4.0, 4 * sum(w)) AS most FROM q GROUP BY ALL),
            f AS (SELECT doc_id, 3.4 AS fw, 'title' AS kind, {_FLAT.format("coalesce(string_split(text, chr(10))[1], '')")} AS v FROM documents
                  UNION ALL SELECT doc_id, 3.0, 'title', {_FLAT.format("coalesce(lang, '')")} FROM documents
                  UNION ALL SELECT doc_id, 2.0, 'metadata', {_FLAT.format("coalesce(source, '')")} FROM documents
                  UNION ALL SELECT doc_id, 1.0, 'body', {_FLAT.format("coalesce(text, '')")} FROM documents),
            t AS (SELECT DISTINCT term FROM q),
            m AS (SELECT doc_id, term, fw, kind, least(3, (length(v) - length(replace(v, term, ''))) // length(term)) AS n FROM f JOIN t ON contains(v, term)),
            g AS (SELECT query_id, doc_id, term, kind, w * fw * n AS gain FROM m JOIN q USING (term)),
            p AS (SELECT query_id, doc_id, term, max(gain) AS best FROM g GROUP BY ALL),
            s AS (SELECT query_id, doc_id, count(DISTINCT term) AS covered, sum(gain) AS strength, bool_or(kind = 'title') AS title, bool_or(kind = 'metadata') AS meta FROM g GROUP BY ALL),
            c AS (SELECT query_id, doc_id, covered, terms, title OR meta AS more,
                         0.55 * (covered / terms) + 0.25 * least(1.0, strength / most) + CASE WHEN title THEN 0.10 ELSE 0 END + CASE WHEN meta THEN 0.06 ELSE 0 END AS x FROM s JOIN b USING (query_id)),
            r AS (SELECT query_id, doc_id AS document_id, covered::INTEGER AS covered, terms::INTEGER AS terms,
                         round_even(greatest(0, least(1, CASE WHEN more THEN x WHEN covered < 2 THEN least(0.42, x - 0.06) ELSE least(0.70, x - 0.06) END)), 3) AS score FROM c),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INTEGER AS rank FROM r QUALIFY rank <= 3)
            SELECT query_id, document_id, score, covered, terms, rank, (SELECT string_agg(term, ' ' ORDER BY best DESC, term) FROM (
                SELECT term, best FROM p WHERE p.query_id = k.query_id AND p.doc_id = k.document_id ORDER BY best DESC, term LIMIT 12)) AS matched FROM k""",
    ),
    "manual_search": (
        manual_search,
        f"""WITH asked AS (SELECT item_id AS q, text || CASE WHEN item_id % 3 = 0 THEN ' how to create it by GUI and CLI' ELSE '' END AS t FROM benchmark),
            q AS (SELECT q, term, max(CASE WHEN length(term) >= 4 THEN 1.0 ELSE 0.75 END) AS w FROM (SELECT q, unnest(string_split({_FLAT.format("t")}, ' ')) AS term FROM asked)
                  WHERE length(term) >= 2 AND term NOT IN ('please', 'thanks', 'thank') GROUP BY ALL),
            b AS (SELECT q, count(*) AS terms, greatest(4.0, 4 * sum(w)) AS most FROM q GROUP BY ALL),
            m AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(lang, '') AS section, coalesce(source, '') AS file,
                         CASE WHEN doc_id % 5 = 0 THEN '目次 ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' create > ' ELSE '' END AS text FROM documents),
            f AS (SELECT doc_id, 3.4 AS fw, 'title' AS kind, {_FLAT.format("title")} AS v FROM m UNION ALL SELECT doc_id, 3.0, 'title', {_FLAT.format("section")} FROM m
                  UNION ALL SELECT doc_id, 2.0, 'metadata', {_FLAT.format("file")} FROM m UNION ALL SELECT doc_id, 1.0, 'body', {_FLAT.format("text")} FROM m),
            t AS (SELECT DISTINCT term FROM q),
            hits AS (SELECT doc_id, term, fw, kind, least(3, (length(v) - length(replace(v, term, ''))) // length(term)) AS n FROM f JOIN t ON contains(v, term)),
            g AS (SELECT q, doc_id, term, kind, w * fw * n AS gain FROM hits JOIN q USING (term)),
            s AS (SELECT q, doc_id, count(DISTINCT term) AS covered, sum(gain) AS strength, bool_or(kind = 'title') AS title, bool_or(kind = 'metadata') AS meta FROM g GROUP BY ALL),
            c AS (SELECT q, doc_id, covered, title OR meta AS more, 0.55 * (covered / terms) + 0.25 * least(1.0, strength / most) + CASE WHEN title THEN 0.10 ELSE 0 END + CASE WHEN meta THEN 0.06 ELSE 0 END AS x FROM s JOIN b USING (q)),
            r AS (SELECT q, doc_id, round_even(greatest(0, least(1, CASE WHEN more THEN x WHEN covered < 2 THEN least(0.42, x - 0.06) ELSE least(0.70, x - 0.06) END)), 3) AS score FROM c),
            said AS (SELECT doc_id, file, section, text, lower(concat_ws(' ', CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(section) <> '' THEN section END, CASE WHEN trim(text) <> '' THEN text END)) AS all_text FROM m),
            names AS (SELECT DISTINCT q, name FROM (SELECT q, unnest(regexp_extract_all(lower(t), '[a-z][a-z0-9_.-]+')) AS name FROM asked WHERE q % 3 = 0) WHERE length(name) >= 3 AND name <> 'how'),
            told AS (
                SELECT DISTINCT q, doc_id, CASE WHEN contains(all_text, 'qa gui') THEN 1 ELSE 0 END + CASE WHEN contains(all_text, 'qacli') THEN 1 ELSE 0 END AS uses
                FROM said JOIN names ON doc_id % 3 = 0 AND name <> 'create' AND (contains(substr(all_text, greatest(1, length(all_text) - 60)), name) OR (length(all_text) <= 122 AND contains(all_text, name))) OR (doc_id % 3 = 0 AND name = 'create')),
            boosted AS (SELECT r.*, coalesce(round(0.22 + 0.06 * uses, 2), 0)::DOUBLE AS boost FROM r LEFT JOIN told USING (q, doc_id)),
            raised AS (SELECT b.*, file, section, CASE WHEN boost > 0 THEN round_even(score + (1 - score) * boost, 3) ELSE score END AS up, contains(substr(text, 1, 400), '目次') AS listed FROM boosted b JOIN said USING (doc_id)),
            final AS (SELECT q, doc_id, boost, file, section, CASE WHEN listed THEN round_even(greatest(0, up - 0.38), 3) ELSE up END AS score FROM raised)
            SELECT q AS query_id, doc_id, boost, score, row_number() OVER (PARTITION BY q ORDER BY boost DESC, score DESC, lower(file) NULLS FIRST, lower(section) NULLS FIRST, doc_id)::INTEGER AS rank FROM final QUALIFY rank <= 5""",
    ),
    "contents_penalties": (
        contents_penalties,
        """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 9 >= 5 THEN 0.38 ELSE 0 END::DOUBLE AS penalty, page_id % 10 / 10 AS s FROM pages)
            SELECT page_id, penalty, round(CASE WHEN penalty = 0 THEN s ELSE s * (1 - penalty) END, 6) AS lowered, round(s + (1 - s) * penalty, 6) AS raised FROM p""",
    ),
    "normal_questions": (
        normal_questions,
        f"""SELECT conv_id, turn, normal, sha256(normal) AS question_hash FROM (SELECT conv_id, turn, {_NORMAL.format("t")} AS normal FROM (
            SELECT conv_id, turn, '株式会社テスト 様' || chr(10) || 'いつもお世話になっております。' || chr(10) || 'Case ID: AB-12 2024/01/02 10:30 mail a.b@example.com' || chr(10)
                   || coalesce(text, '') || chr(10) || '-----' || chr(10) || 'TEL 03' AS t FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL))""",
    ),
    "pair_matches": (
        pair_matches,
        f"""WITH p AS (SELECT p_partkey, p_name AS a, p_size / 50 AS keyword, p_partkey % 5 AS kind,
                CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN p_name || ' xy' ELSE p_type END AS b FROM part),
            n AS (SELECT *, {_NORMAL.format("a")} AS na, {_NORMAL.format("b")} AS nb FROM p),
            d AS (SELECT *, {_DICE.format(a="na", b="nb")} AS dice FROM n),
            m AS (SELECT *, CASE WHEN trim(a) = trim(b) THEN 1 WHEN na = nb THEN 2 WHEN kind = 3 THEN 3 WHEN dice >= 0.72 THEN 4 WHEN keyword > 0 THEN 5 ELSE 6 END::INTEGER AS match_order FROM d)
            SELECT p_partkey, match_order, round(CASE match_order WHEN 1 THEN 1.0 WHEN 2 THEN 0.99 WHEN 3 THEN 0.985 WHEN 4 THEN least(0.98, 0.70 + 0.28 * dice) WHEN 5 THEN least(0.84, keyword) ELSE 0 END, 6) AS score FROM m""",
    ),
    "pair_dedup": (pair_dedup, "SELECT max(o_orderkey) AS o_orderkey FROM orders GROUP BY strftime(o_orderdate, '%Y%m'), o_orderpriority"),
    "set_similarities": (
        set_similarities,
        f"""WITH w AS (SELECT *, string_split(lower(p_name), ' ') AS a, list_append(string_split(lower(p_type), ' '), string_split(lower(p_name), ' ')[1]) AS b FROM part)
            SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard,
                   round(len(list_intersect(a, b)) / sqrt(len(list_distinct(a)) * len(list_distinct(b))), 6) AS ochiai,
                   round({_DICE.format(a="p_name", b="p_type")}, 6) AS dice, (length(p_name) - length(replace(p_name, 'a', '')))::INTEGER AS times FROM w""",
    ),
    "visible_sources": (
        visible_sources,
        _sql("SELECT query_id, source_id, CASE WHEN s >= 0.2 THEN s >= 0.5 ELSE selected END AS selected FROM results WHERE t = 'manual' AND s >= 0.1", _RESULTS),
    ),
    "gated_sources": (
        gated_sources,
        _sql(
            """SELECT query_id, source_id, coalesce(list_position(CASE query_id % 4 WHEN 1 THEN ['curatedfact', 'exactpastanswer', 'manual', 'officialdoc', 'pastanswer', 'pastcasenote']
                      WHEN 2 THEN ['curatedfact', 'manual', 'officialdoc', 'exactpastanswer', 'pastanswer', 'pastcasenote']
                      ELSE ['curatedfact', 'officialdoc', 'manual', 'exactpastanswer', 'pastanswer', 'pastcasenote'] END, t) - 1, 6)::INTEGER AS priority,
                   coalesce(list_position(CASE WHEN fresh THEN ['officialdoc', 'manual', 'pastcasenote'] ELSE ['manual', 'officialdoc', 'pastcasenote'] END, t) - 1, 3)::INTEGER AS fresh_priority,
                   s >= CASE WHEN t = 'officialdoc' AND fresh THEN 0.25 ELSE 0.5 END AS taken
               FROM results WHERE (query_id % 3 > 0 OR product_name = 'A') AND NOT (query_id % 4 = 0 AND t IN ('exactpastanswer', 'pastanswer', 'pastcasenote'))""",
            _RESULTS,
        ),
    ),
}
_SELECTION = (
    _RESULTS
    + """, a AS (SELECT *, selected AND (manual OR s >= CASE WHEN t = 'officialdoc' AND fresh THEN 0.25 ELSE 0.95 END) AS passed,
            CASE WHEN NOT fresh THEN 0 WHEN t = 'officialdoc' THEN 0 WHEN t = 'manual' THEN 1 WHEN t = 'pastcasenote' THEN 2 ELSE 3 END AS fp FROM results),
        b AS (SELECT *, passed OR (NOT bool_or(passed) OVER (PARTITION BY query_id) AND NOT excluded) AS cand FROM a),
        c AS (SELECT *, cand AND (passed OR row_number() OVER (PARTITION BY query_id, cand ORDER BY fp, s DESC, source_id) <= 5) AS sel FROM b),
        d AS (SELECT *, sel AND (NOT fresh OR bool_or(sel AND t = 'officialdoc') OVER (PARTITION BY query_id)
                OR row_number() OVER (PARTITION BY query_id, sel, t ORDER BY fp, s DESC, source_id) <= CASE t WHEN 'manual' THEN 2 WHEN 'pastcasenote' THEN 1 ELSE 0 END) AS kept FROM c),
        picked AS (SELECT *, CASE WHEN kept AND row_number() OVER (PARTITION BY query_id, kept ORDER BY fp, s DESC, source_id) <= 5 THEN 'sent' WHEN kept THEN 'limit' WHEN sel THEN 'freshness' WHEN selected AND NOT passed THEN 'score' END AS state FROM d)"""
)
_VARIANTS = _RESULTS + ", va AS (SELECT query_id, source_type, source_id, s, 1 AS part FROM results), vb AS (SELECT query_id, source_type, source_id, round(1 - s, 2) AS s, 0 AS part FROM results WHERE query_id % 3 > 0)"
QUERIES |= {
    "selected_sources": (selected_sources, _sql("SELECT query_id, source_id, state FROM picked", _SELECTION)),
    "selection_summary": (
        selection_summary,
        _sql(
            "SELECT query_id, count(*) AS results, count(*) FILTER (selected) AS selected, "
            + ", ".join(f"count(*) FILTER (t = '{n.lower()}' AND selected) AS selected_{n}, count(*) FILTER (t = '{n.lower()}' AND state = 'sent') AS sent_{n}" for n in ("OfficialDoc", "Manual", "PastCaseNote"))
            + ", "
            + ", ".join(f"count(*) FILTER (state = '{n}') AS by_{n}" for n in ("limit", "freshness", "score"))
            + ", count(*) FILTER (t <> 'manual') AS hidden_by_type, count(*) FILTER (t = 'manual' AND s < 0.3) AS hidden_by_score, count(*) FILTER (s < 0.95) AS below_threshold FROM picked GROUP BY query_id",
            _SELECTION,
        ),
    ),
    "official_diagnostics": (
        official_diagnostics,
        _sql(
            """SELECT query_id, CASE WHEN product IN ('A', 'N') THEN chunks ELSE 0 END AS chunks, feature_matches, found, selected, sent, version_matches,
                      CASE WHEN product IS NULL OR query_id % 7 = 0 THEN 'CrawlNotConfigured' WHEN product = 'X' THEN 'IndexMissing' WHEN product = 'R' THEN 'CrawlFailed' WHEN query_id % 3 > 0 AND feature_matches = 0 THEN 'IndexCoverageMissing'
                           WHEN found = 0 THEN 'SearchMismatch' WHEN selected = 0 THEN 'SelectorExcluded' WHEN sent = 0 THEN 'FinalSelectionExcluded' ELSE 'Selected' END AS diagnosis
               FROM (SELECT query_id, ['A', 'N', 'R', 'X', NULL][query_id % 5 + 1] AS product, count(*) FILTER (t = 'officialdoc') AS found, count(*) FILTER (t = 'officialdoc' AND selected) AS selected,
                            count(*) FILTER (t = 'officialdoc' AND state = 'sent') AS sent, count(*) FILTER (t = 'officialdoc' AND query_id % 2 = 0 AND matched) AS version_matches FROM picked GROUP BY query_id)
               LEFT JOIN (SELECT l_returnflag AS product, count(*) AS chunks FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) USING (product),
               LATERAL (SELECT count(DISTINCT l_orderkey) AS feature_matches FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = product AND product <> 'R' AND query_id % 3 > 0 AND l_suppkey % 3 = query_id % 4)""",
            _SELECTION,
        ),
    ),
    "variant_sources": (variant_sources, _sql("SELECT query_id, source_type, source_id, max(s) AS score FROM (SELECT * FROM va UNION ALL SELECT * FROM vb) GROUP BY ALL", _VARIANTS)),
    "first_sources": (first_sources, _sql("SELECT query_id, source_id, s AS score FROM (SELECT * FROM va UNION ALL SELECT * FROM vb) QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY part, s DESC) = 1", _VARIANTS)),
    "merged_sources": (
        merged_sources,
        _sql(
            """SELECT query_id, source_id, preferred, row_number() OVER (PARTITION BY query_id ORDER BY preferred DESC, s DESC, source_type, source_id)::INTEGER AS rank FROM (
                SELECT * FROM (SELECT query_id, source_type, source_id, s, true AS preferred FROM results WHERE score < 0.2 UNION ALL SELECT query_id, source_type, source_id, s, false FROM vb)
                QUALIFY row_number() OVER (PARTITION BY query_id, source_type, source_id ORDER BY preferred DESC, s DESC) = 1) QUALIFY rank <= 8""",
            _VARIANTS,
        ),
    ),
    "displayed_sources": (displayed_sources, _sql("SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_type, source_id)::INTEGER AS place FROM results", _RESULTS)),
    "exact_answers": (
        exact_answers,
        _sql("SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, retrieved_at DESC, source_id)::INTEGER AS rank FROM results WHERE t = 'exactpastanswer' QUALIFY rank <= 8", _RESULTS),
    ),
    "limited_sources": (limited_sources, _sql("SELECT query_id, source_id FROM results QUALIFY row_number() OVER (PARTITION BY query_id, source_type ORDER BY s DESC, source_id) <= 6", _RESULTS)),
    "represented_sources": (
        represented_sources,
        _sql(
            """SELECT query_id, source_id FROM (
                SELECT *, able AND row_number() OVER (PARTITION BY query_id, f, able ORDER BY s DESC, source_id) = 1 AS lead FROM (
                    SELECT *, f IN ('officialdoc', 'manual', 'past') AND s >= 0.45 AND matched AS able FROM (
                        SELECT *, CASE WHEN t IN ('exactpastanswer', 'pastanswer', 'pastcasenote') THEN 'past' ELSE t END AS f FROM results)))
               QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, s DESC, source_id) <= 8""",
            _RESULTS,
        ),
    ),
    "quality_evidence": (
        quality_evidence,
        _sql("SELECT query_id, source_type, source_id FROM results WHERE source_type = 'Manual' OR query_id % 2 = 0", _RESULTS),
    ),
    "source_families": (
        source_families,
        _sql(
            """SELECT query_id, count(*)::INTEGER AS used, count(*) FILTER (t = 'officialdoc')::INTEGER AS official, count(*) FILTER (t = 'manual')::INTEGER AS manual,
                  count(*) FILTER (t IN ('exactpastanswer', 'pastanswer', 'pastcasenote'))::INTEGER AS past, count(*) FILTER (t = 'other')::INTEGER AS other FROM results GROUP BY query_id""",
            _RESULTS,
        ),
    ),
    "united_sources": (
        united_sources,
        """SELECT 0 AS ordinal, 'OfficialDoc' AS source_type, page_id::VARCHAR AS source_id, url, length(html)::INTEGER AS n_chars FROM pages
           UNION ALL SELECT 1, 'Manual', doc_id::VARCHAR, NULL, length(text) FROM documents
           UNION ALL SELECT CASE role WHEN 'assistant' THEN 2 ELSE 3 END, CASE role WHEN 'assistant' THEN 'PastAnswer' ELSE 'PastCaseNote' END, concat_ws('-', conv_id, turn), NULL, length(text)
                     FROM conversations WHERE role IN ('assistant', 'user')""",
    ),
    "keyword_cases": (keyword_cases, "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high')"),
    "drilled_cases": (
        drilled_cases,
        """SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m%d') AS created FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1996 AND month(o_orderdate) = 3
           UNION ALL SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m%d') FROM orders WHERE year(o_orderdate) = 1994""",
    ),
    "looked_up_case": (looked_up_case, "SELECT o_orderkey::VARCHAR AS number, o_orderstatus FROM orders WHERE o_orderkey = 33"),
    "existing_cases": (
        existing_cases,
        "SELECT o_orderkey, '/Base/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)",
    ),
    "products_in_order": (
        products_in_order,
        "SELECT n_name AS display_name, row_number() OVER (ORDER BY n_regionkey, lower(n_name), n_name)::INTEGER AS place FROM nation WHERE n_nationkey % 4 > 0",
    ),
    "case_categories": (case_categories, _sql("SELECT DISTINCT string_split(path, '/')[3] AS category FROM files", _FILES)),
    "repeated_names": (repeated_names, "SELECT upper(trim(p_name)) AS name, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY ALL HAVING n > 1"),
    "matched_products": (
        matched_products,
        """WITH k AS (SELECT n_nationkey::VARCHAR AS product_id, 0 AS p, n_nationkey::VARCHAR AS n FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 1, lower(n_name) FROM nation
                UNION ALL SELECT n_nationkey::VARCHAR, 2, lower(substr(n_name, 1, 3)) FROM nation),
            f AS (SELECT n, product_id FROM k QUALIFY row_number() OVER (PARTITION BY n ORDER BY p, product_id) = 1),
            w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'uni' WHEN s_suppkey % 3 = 0 THEN s_nationkey::VARCHAR WHEN s_suppkey % 3 = 1 THEN ' canada ' ELSE substr(s_name, 1, 3) END AS wanted FROM supplier)
            SELECT s_suppkey, wanted, product_id FROM w LEFT JOIN f ON lower(trim(wanted)) = n""",
    ),
    "launched_folders": (
        launched_folders,
        _sql(
            """SELECT o.o_orderkey AS context_id, CASE WHEN p.path IS NOT NULL THEN p.path END AS path, p.score FROM orders o LEFT JOIN (
                SELECT context_id, arg_max(path, (score, o_orderkey, path)) AS path, max(score)::INTEGER AS score FROM (
                    SELECT o.o_orderkey AS context_id, '/f/' || f.name AS path, f.o_orderkey, 100 + CASE WHEN contains(f.name, strftime(o.o_orderdate, '%Y%m%d')) THEN 40 ELSE 0 END
                           + CASE WHEN contains(lower(f.name), lower(CASE WHEN o.o_orderkey % 5 > 0 THEN c_name ELSE 'nobody' END)) THEN 30 ELSE 0 END + CASE WHEN contains(f.name, 'open') THEN 10 ELSE 0 END AS score
                    FROM (SELECT o_orderkey, name, unnest(list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'))) AS run FROM folders) f JOIN orders o ON f.run = o.o_orderkey::VARCHAR JOIN customer ON o.o_custkey = c_custkey)
                GROUP BY context_id) p ON p.context_id = o.o_orderkey WHERE o.o_orderkey % 3 > 0""",
            _FOLDERS,
        ),
    ),
    "inserted_cases": (
        inserted_cases,
        "SELECT l_orderkey AS number, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL",
    ),
    "selector_readiness": (
        selector_readiness,
        """SELECT user_id, count(*) AS runs, CASE WHEN count(*) < 60 THEN 'NotEnoughData' WHEN bool_or(user_id % 5 = 0 AND value > 90) THEN 'Blocked'
               WHEN NOT bool_and(value > user_id % 3) OR count(*) FILTER (event_type = 'error') / count(*) > 0.22 THEN 'NeedsInvestigation' ELSE 'Ready' END AS readiness FROM events GROUP BY user_id""",
    ),
    "cut_prompts": (
        cut_prompts,
        "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300 - length(e)) || e END AS prompt FROM documents, (SELECT chr(10) || '...[MaxPromptCharsにより省略]' AS e)",
    ),
    "notes_of_cases": (notes_of_cases, "SELECT '/b/' || l_orderkey AS path, count(*) AS notes FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AND l_linenumber > 1 GROUP BY ALL"),
    "topic_adjustments": (
        topic_adjustments,
        _sql(
            """SELECT query_id, source_id, round(CASE WHEN a >= 0 THEN s + (1 - s) * least(0.95, a) ELSE s * (1 + greatest(-1, a)) END, 6) AS score FROM (
                SELECT *, CASE WHEN query_id % 3 = 0 THEN 0 WHEN matched THEN 0.28 WHEN manual THEN -0.55 ELSE -0.24 END::DOUBLE + CASE WHEN excluded THEN -0.55 ELSE 0 END::DOUBLE
                       + CASE WHEN NOT fresh THEN 0 WHEN t = 'officialdoc' THEN 0.12 WHEN t = 'manual' THEN 0.03 WHEN t IN ('pastcasenote', 'pastanswer', 'exactpastanswer') THEN -0.08 ELSE 0 END::DOUBLE
                       + CASE WHEN query_id % 2 = 1 AND t = 'exactpastanswer' THEN 0.12 ELSE 0 END::DOUBLE AS a FROM results WHERE score IS NOT NULL)""",
            _RESULTS,
        ),
    ),
    "closed_years": (
        closed_years,
        "SELECT year, row_number() OVER (ORDER BY year = '年不明', year)::INTEGER AS place FROM (SELECT DISTINCT CASE WHEN o_orderkey % 9 = 0 THEN '年不明' ELSE strftime(o_orderdate, '%Y') END AS year FROM orders)",
    ),
}
