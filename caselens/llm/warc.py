"""Dictionary-compressed WARC archives (``.warc.zst``).

Each archive starts with a skippable Zstandard frame that holds a dictionary built from its own records; every record is
then a frame of its own, so that it can be read alone. Records of equal payload are stored once: the one of the smallest
page_id is a ``response``, the others ``revisit`` it.

Defined cases: a null html is an empty payload, a null url gives no WARC-Target-URI, control characters and spaces in
one are percent-encoded; payloads under ``LEAST`` bytes are always stored; of rows that repeat the smallest page_id of
a group each is a response; records too few or too small to train on give a dictionary of raw content; very long payloads make
an archive of their own; an empty table gives no archive; further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the magic number of the dictionary's skippable frame, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Payloads of fewer bytes are never deduplicated; tasks that one digest's payloads are dealt over.
LEAST, SALTS = 100, 16
#: Bytes of records, before compression, at which an archive ends: what one task holds.
ARCHIVE_BYTES = 8 << 20
#: The dictionary's size, and the bytes of records that it is built from (evenly spaced over the archive).
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 512 << 10
#: Records whole as samples, if so many make up the sample's bytes; else so many slices of records.
WHOLE, SLICES = 16, 128
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"
RECORD = "archive string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: store the payload) of each page. The digests of repeated
    payloads are counted on the map side; each is dealt over ``SALTS`` tasks, so a frequent page's payloads do not meet
    in one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = pages.filter(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["digest", "_salt"], "left")
    revisit = (F.length("payload") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    urn = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%25", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    body = payload if refers_to is None else b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head)]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of one record. The payload of a
    response is measured and hashed anew; a revisit states those of the payload it refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda v: None if v is None or v == "<urn:page:null>" else int(v[len("<urn:page:") : -1])
    body = rest[: int(fields["Content-Length"])]
    url = fields.get("WARC-Target-URI")
    url = None if url is None else unquote(url, errors="strict")
    if fields["WARC-Type"] == "response":
        return number(fields["WARC-Record-ID"]), url, "response", body, len(body), hashlib.sha256(body).hexdigest(), None
    return number(fields["WARC-Record-ID"]), url, "revisit", None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), number(fields["WARC-Refers-To"])


def slices(records: list[bytes]) -> list[bytes]:
    """At least ``SLICES`` parts, evenly spaced within and over the records, of at most ``SAMPLE_BYTES`` in all."""
    picked = records[:: max(1, len(records) // SLICES)]
    each = -(-SLICES // len(picked))
    size = min(SAMPLE_BYTES // (len(picked) * each), max(64, sum(map(len, picked)) // SLICES))
    out = []
    for r in picked:
        steps = min(each, -(-len(r) // size))
        out += [r[(len(r) - size) * i // (steps - 1) :][:size] if steps > 1 else r[:size] for i in range(steps)]
    return out


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of evenly spaced records of about ``SAMPLE_BYTES`` in all, or of slices of records where these are
    fewer than ``WHOLE`` or too long. What is too little or too varied to be trained on is itself the dictionary, as raw
    content, so every archive has one."""
    if not records:
        return b""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    if len(samples) < WHOLE:
        samples = slices(records)
    size = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive(records: list[bytes], level: int = 3) -> tuple[bytes, int]:
    """The bytes of an archive of these records, and the size of its dictionary."""
    raw = dictionary(records)
    out = [struct.pack("<II", SKIPPABLE, len(raw)), raw] if raw else []
    known = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    one = zstandard.ZstdCompressor(level=level, write_checksum=True, **known)
    return b"".join([*out, *(one.compress(r) for r in records)]), len(raw)


def unarchive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, known = 0, {}
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic == SKIPPABLE:
        known, at = {"dict_data": zstandard.ZstdCompressionDict(data[8 : 8 + size])}, 8 + size
    view = memoryview(data)
    one = zstandard.ZstdDecompressor(**known)
    while at < len(data):
        frame = one.decompressobj()
        out = io.BytesIO()
        while not frame.eof:
            out.write(frame.decompress(view[at : at + (64 << 10)]))
            at += min(64 << 10, len(data) - at)
        at -= len(frame.unused_data)
        yield out.getvalue()


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) under ``path``, a URI that all executors share, and returns
    their manifest (archive, records, bytes, dictionary_bytes), which is written beside them and read back. Each archive
    comes by a rename and bears the number of the attempt that wrote it; the manifest lists those of the attempts that
    ended well, so what a lost executor leaves is never read."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        task, held, size, n = f"{context.partitionId():06d}-{context.taskAttemptId():08d}", [], 0, 0

        def flush() -> pd.DataFrame:
            data, words = archive(held, level)
            name = f"part-{task}-{n:06d}.warc.zst"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(data)
            store.move(temporary, f"{base}/{name}")
            return pd.DataFrame({"archive": [name], "records": [len(held)], "bytes": [len(data)], "dictionary_bytes": [words]})

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch[c] for c in batch.columns), strict=True):
                held.append(record(page and int(page), url, payload, digest, refers and int(refers), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  whole numbers with nulls would become floats
    rows = resolve(pages).select(text("page_id"), "url", "payload", "digest", text("refers_to"))
    manifest = f"{path}/manifest"
    rows.mapInPandas(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives that the manifest under ``path`` lists."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch["archive"]:
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for r in map(parse, unarchive(data)):
                    rows.append((name, *r))
                    size += len(r[3] or b"")
                    if size > 4 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    tasks = min(max(1, manifest.count()), 20 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("archive").repartition(tasks).mapInPandas(read, RECORD)
