import random
import zlib

from caselens.llm import sharding

SCHEMA = "doc_id long, text string, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)


def check(rows, got, shards):
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    assert len(got) == len(rows)
    sums = [0] * shards
    for r in got:
        sums[r["shard"]] += r["size"]
    largest = max(len((t or "").encode()) + 8 for _, t in rows)
    assert all(abs(s - total / shards) <= 2 * largest for s in sums)
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_shards_are_even_even_with_a_hot_text(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(200)) for i in range(600)] + [(i, "hot text é") for i in range(600, 1000)] + [(1000, None), (1001, "")]
    docs = table(spark, rows).repartition(4)
    got = sharding.report(docs, 6).collect()
    check(rows, got, 6)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert (r["text_crc32"], r["size"]) == (zlib.crc32(text.encode()), len(text.encode()) + 8)


def test_splitters_match_a_sort(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1 << 60), rng.randrange(1, 50)) for _ in range(500)]
    rows += [(rows[0][0], 7)] * 40
    keyed = spark.createDataFrame(rows, "key long, size long")
    total = sum(s for _, s in rows)
    want, below = [], 0
    for k in range(1, 8):
        target = -(-k * total // 8)
        below = 0
        for key in sorted({k for k, _ in rows}):
            below += sum(s for x, s in rows if x == key)
            if below >= target:
                want.append(key + 1)
                break
    assert sharding.splitters(keyed, 8) == want
    coarse = sharding.splitters(keyed, 8, tolerance=0.5)
    assert coarse == sorted(coarse) and len(coarse) == 7


def test_cells_do_not_change_the_order(spark):
    rows = [(i, f"t{i % 7}") for i in range(300)]
    docs = table(spark, rows)
    whole = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.histogram_shard(docs, 4).collect()}
    cut = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.histogram_shard(docs, 4, cell_rows=5).collect()}
    assert whole == cut


def test_extra_columns_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "k"), (1, "a", "k"), (None, None, None)], "doc_id long, text string, key2 string")
    out = sharding.histogram_shard(docs, 2)
    assert out.columns == ["doc_id", "text", "key2", "size", "shard", "slot"] and out.count() == 3
    assert sharding.report(docs.limit(0), 3).count() == 0
