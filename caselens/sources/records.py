"""JSON documents, evaluation cases and case indexes, with their faults as a table; reports as sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.scratch import written

# The metadata of a document and the columns of a summary.
METADATA = (
    "product_id product_name support_id information_type document_name source_path target_version os error_code command "
    "created_or_updated_at source_type question cause resolution manufacturer_reply customer_final_reply"
).split()
DOCUMENT = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in METADATA] + [T.StructField("confidence", T.DoubleType())]))]
)
SUMMARY = (
    "chunk_strategy search_method reranker filter_mode top_k document_count chunk_count query_count mean_precision_at_k mean_recall_at_k mrr mean_ndcg_at_k "
    "mean_required_term_coverage_at_k excluded_term_hit_count product_confusion_count version_mismatch_count mean_search_time_ms quality_gate_passed violations"
).split()
_LIST = T.ArrayType(T.StringType())
EVALUATION_CASE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query_id", "product", "query", "target_version")]
    + [T.StructField(n, _LIST) for n in ("expected_document_ids", "expected_support_ids", "required_terms", "excluded_terms")]
    + [T.StructField("notes", T.StringType())]
)
CASE = T.StructType([T.StructField(n, T.StringType()) for n in "company support_number status created_on folder_name folder_path last_updated category".split()])


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _both(schema: T.StructType) -> T.StructType:
    """The schema with each field in snake and camel case."""
    out = []
    for f in schema.fields:
        kind = _both(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType
        out += [T.StructField(n, kind) for n in dict.fromkeys((f.name, camel(f.name)))]
    return T.StructType(out)


def _pick(prefix: str, schema: T.StructType) -> list:
    """The snake-case columns of a schema read by ``_both``, either spelling."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out.append(F.struct(*_pick(f"{name}.", f.dataType)).alias(f.name))
        else:
            out.append(F.coalesce(*[F.col(f"{prefix}{n}") for n in dict.fromkeys((f.name, camel(f.name)))]).alias(f.name))
    return out


PIECE = "file string, place int, line int, column int, record string, error string"


def _place(text: str, at: int) -> tuple[int, int]:
    """The line and column, from 1, of a place in a text."""
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def _after_bad(text: str, at: int) -> int:
    """Where the element of an array that begins at ``at`` and cannot be read ends: at the next comma or closing bracket that is in no
    string and no bracket of its own, or at the end of the line on which a string does not end."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == '"':
            end = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(text, at)
            if not end:
                return text.find("\n", at) if "\n" in text[at:] else len(text)
            at = end.end() - 1
        elif c in "[{":
            depth += 1
        elif c in "]}":
            if depth == 0 and c == "]":
                return at
            depth = max(0, depth - 1)
        elif c == "," and depth == 0:
            return at
        at += 1
    return len(text)


def pieces(text: str, root: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(place in the text, record, fault) for each record of a text: the elements of an array, which is the whole or lies under
    ``root``, else the one object that the text is. A fault in an element costs that element alone."""
    decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    at = blank.match(text).end()
    if text[at : at + 1] == "{":
        head = re.compile(rf'\{{\s*"{re.escape(root)}"\s*:\s*(?=\[)').match(text, at)
        if not head:
            try:
                value, end = decoder.raw_decode(text, at)
                if blank.match(text, end).end() != len(text):
                    raise json.JSONDecodeError("Extra data", text, end)
            except json.JSONDecodeError as e:
                yield e.pos, None, e.msg
                return
            found = value.get(root)
            for record in found if isinstance(found, list) else [value]:
                yield at, json.dumps(record), None
            return
        at = head.end()
    if text[at : at + 1] != "[":
        yield at, None, "Expecting an array or an object"
        return
    at = blank.match(text, at + 1).end()
    while text[at : at + 1] != "]":
        if at >= len(text):
            yield len(text), None, "Unterminated array"
            return
        try:
            _, end = decoder.raw_decode(text, at)
            after = blank.match(text, end).end()
            if text[after : after + 1] not in (",", "]", ""):
                raise json.JSONDecodeError("Expecting ',' delimiter", text, after)
            yield at, text[at:end], None
        except json.JSONDecodeError as e:
            yield e.pos, None, e.msg
            after = _after_bad(text, at)
        at = blank.match(text, after + 1 if text[after : after + 1] == "," else after).end()


def file_pieces(name: str, data: bytes, root: str) -> Iterator[tuple]:
    """The rows of ``PIECE`` of one file."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        before = data[: e.start].decode("utf-8")
        yield name, 0, *_place(before, len(before)), None, "not UTF-8"
        return
    for n, (at, record, fault) in enumerate(pieces(text, root)):
        yield name, n, *_place(text, at), record, fault


def scan_records(spark: SparkSession, path: str, root: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): the records of JSON files whose root is an array of records, one record, or an object that holds the array
    under ``root``, in the columns of ``schema``, with file, place, line and column; and (file, place, line, column, error) of what cannot be
    read: bytes that are not UTF-8, faults of syntax, records that are no objects or of which a value is of another kind or
    the first column is missing. A bad record spares the rest of its file. A file is read in one task, as its brackets
    tell where records end."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = list(file_pieces(name, bytes(data), root))
                yield pd.DataFrame(rows, columns=names)

    row = _both(schema)
    kept = T.StructType([*row.fields, T.StructField("_corrupt", T.StringType())])
    found = written(files.mapInPandas(cut, PIECE), "records")
    found = found.withColumn("r", F.from_json("record", kept, {"columnNameOfCorruptRecord": "_corrupt"}))
    first = F.coalesce(*[F.col(f"r.{n}") for n in dict.fromkeys((schema.fields[0].name, camel(schema.fields[0].name)))])
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.startswith(F.trim("record"), F.lit("{")), "Expecting an object")
        .when(F.col("r._corrupt").isNotNull(), "A value is of another kind")
        .when(first.isNull(), f"Missing {schema.fields[0].name}")
    )
    found = found.withColumn("error", fault)
    where = ["file", "place", "line", "column"]
    return found.filter("error IS NULL").select(*where, *_pick("r.", schema)), found.filter("error IS NOT NULL").select(*where, "error")


def read_records(spark: SparkSession, path: str, root: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """The rows of ``scan_records``. Strict readers fail on a fault and say where it is, others pass over it."""
    rows, faults = scan_records(spark, path, root, schema)
    rows = rows.drop("file", "place", "line", "column")
    if strict and (bad := faults.orderBy("file", "place").first()):
        raise ValueError(f"{bad['file']}, line {bad['line']}, column {bad['column']}: {bad['error']}")
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    rows = read_records(spark, path, "documents", DOCUMENT)
    fine = F.col("metadata.confidence").isNull() | F.col("metadata.confidence").between(0, 1)
    return rows.filter(F.assert_true(fine, F.lit("confidence must be between 0 and 1")).isNull())


def read_evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "evaluation_cases", EVALUATION_CASE)


def read_case_index(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "cases", CASE, strict=False)


#: The items of a payload of evidence in a file.
PAYLOAD = T.StructType(
    [T.StructField("query", T.StringType())]
    + [T.StructField("selectedEvidence", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in "documentId text product version sourceType selectionReason".split()] + [T.StructField(n, T.BooleanType()) for n in ("productMatch", "versionMatch")] + [T.StructField("warnings", _LIST)])))]
)


def read_payloads(spark: SparkSession, path: str, most: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """(items, faults) of JSON files that hold a payload of evidence each: items (file, query, place, document_id, text, product, version,
    source_type, product_match, version_match, warnings), and (file, error) of files that are larger than ``most`` bytes (their contents
    are not read), no JSON, or without items. Empty files are not listed."""
    files = spark.read.format("binaryFile").load(path)
    gate = F.when(F.col("length") > most, "too large")
    sized = files.select("path", gate.alias("gate"))
    text = files.filter(F.col("length") <= most).select("path", F.col("content").cast("string").alias("text"))
    parsed = written(text.select("path", F.from_json("text", T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")), "payloads")
    bad = F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "no JSON").when(F.coalesce(F.size("p.selectedEvidence"), F.lit(0)) <= 0, "no items")
    faults = sized.filter("gate IS NOT NULL").select(F.col("path").alias("file"), F.col("gate").alias("error")).unionByName(parsed.select(F.col("path").alias("file"), bad.alias("error")).filter("error IS NOT NULL"))
    each = parsed.filter(bad.isNull()).select(F.col("path").alias("file"), F.col("p.query").alias("query"), F.posexplode("p.selectedEvidence").alias("place", "i"))
    names = {"documentId": "document_id", "text": "text", "product": "product", "version": "version", "sourceType": "source_type", "productMatch": "product_match", "versionMatch": "version_match", "warnings": "warnings"}
    return each.select("file", "query", "place", *(F.col(f"i.{n}").alias(c) for n, c in names.items())), faults


def write_report(summary: DataFrame, path: str) -> None:
    """A summary as JSON, CSV and a Markdown table (one line per row, numbers to six places). Of its columns those of
    ``SUMMARY`` are written, in that order; missing ones are empty."""
    have = set(summary.columns)
    summary = summary.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in SUMMARY))
    flat = summary.select(*[F.to_json(c).alias(c) if "<" in kind else F.col(c) for c, kind in summary.dtypes])
    flat.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    flat.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    shown = [F.format_string("%.6f", c) if kind in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, kind in flat.dtypes]
    lines = flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("value"))
    spark = summary.sparkSession
    head = spark.createDataFrame([("| " + " | ".join(flat.columns) + " |",), ("|" + "---|" * len(flat.columns),)], "value string")
    head.coalesce(1).unionAll(lines).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
