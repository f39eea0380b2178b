import hashlib
import random
import struct

from caselens.llm import warc


def test_record_round_trip():
    for url in (None, "http://a/b?c=d%20e&f", "http://x/\r\nWARC-Type: fake\r\n é"):
        payload = b"\r\n\r\nWARC/1.1 \xff" * 20
        digest = hashlib.sha256(payload).hexdigest()
        raw = warc.record(0, url, payload, digest, None, "1970-01-01T00:00:00Z")
        assert warc.parse(raw) == (0, url, "response", payload, len(payload), digest, None)
        raw = warc.record(9, url, payload, digest, 0, "1970-01-01T00:00:00Z")
        assert payload not in raw and warc.parse(raw) == (9, url, "revisit", None, len(payload), digest, 0)


def test_archive_has_a_dictionary_that_pays():
    records = [b"<html><body class='page'><p>some words about page %d and its neighbours</p></body></html>" % i * 4 for i in range(400)]
    data, size = warc.archive(records)
    assert struct.unpack_from("<II", data) == (warc.SKIPPABLE, size) and size
    assert list(warc.unarchive(data)) == records
    for n in (1, 3, 5, 15):
        few, words = warc.archive(records[:n])
        assert words and struct.unpack_from("<II", few) == (warc.SKIPPABLE, words) and list(warc.unarchive(few)) == records[:n]
    five, words = warc.archive(records[:5])
    assert len(five) - words < sum(map(len, records[:5])) / 3
    assert list(warc.unarchive(warc.archive([])[0])) == []
    long = [bytes(range(256)) * 4000, b""]
    assert list(warc.unarchive(warc.archive(long)[0])) == long


def test_archives_of_long_records_have_a_dictionary():
    rng = random.Random(4)
    shared = rng.randbytes(2000)
    for n, size in ((205, 40 << 10), (80, 100 << 10), (40, 200 << 10), (8, 1 << 20), (2, 4 << 20)):
        records = [shared + rng.randbytes(size - 4000) + shared[::-1] for _ in range(n)]
        data, words = warc.archive(records)
        assert words > 0 and list(warc.unarchive(data)) == records
        assert sum(map(len, warc.slices(records))) <= warc.SAMPLE_BYTES and len(warc.slices(records)) >= 100
        if n >= 40:
            assert len(data) < sum(map(len, records)) - (n - 30) * 2000
    one = [rng.randbytes(9 << 20)]
    assert warc.archive(one)[1] > 0 and list(warc.unarchive(warc.archive(one)[0])) == one


def test_archives(spark, tmp_path):
    same, other = "S" * 120, "é" * 300
    rows = [(3, "u", same), (1, None, same), (2, "u", other), (7, "u", same), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (8, "", ""), (1, None, same), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, path, archive_bytes=300)
    found = warc.read_archives(spark, path)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) == found.count()
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found.collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {(i, "response", None, len((t or "").encode()), sha(t)) for i, _, t in rows if i in (1, 2, 4, 5, 6, 8)}
    assert got == want | {(i, "revisit", 1, 120, sha(same)) for i in (3, 7, None)}


def test_left_over_archives_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    archive = warc.archive([warc.record(99, "u", b"x", hashlib.sha256(b"x").hexdigest(), None, "1970-01-01T00:00:00Z")])[0]
    (tmp_path / "w" / "part-000000-00000099-000000.warc.zst").write_bytes(archive)
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).collect()) == list(range(20))


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(pages, path).count() == 0
    assert warc.read_archives(spark, path).count() == 0
