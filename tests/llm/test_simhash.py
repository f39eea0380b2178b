import random

from caselens.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(prints: dict[int, int]) -> dict[int, int]:
    """The smallest doc_id of each document's component, by comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def plain(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "one TWO three", "É é ÉÉ a", *(" ".join(rng.choices(["ab", "C", "dé", "x"], k=n)) for n in (4, 5, 40, 400))]:
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)


def test_spark_hashes_the_same(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1) == plain("a b c d")


def test_components_of_fingerprints_match_all_pairs(spark):
    rng = random.Random(5)
    prints, at = {}, 0
    for _ in range(60):  # chains and clouds of near fingerprints, and lone ones
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8])):
            prints[at] = fp
            at += 1
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 4, 4, 5])):
                fp ^= 1 << b
    signed = {i: f - 2**64 if f >> 63 else f for i, f in prints.items()}
    want = brute(prints)
    rows = spark.createDataFrame([(i, f) for i, f in signed.items()], "doc_id long, fp long")
    groups = rows.groupBy("fp").agg({"doc_id": "min", "*": "count"}).toDF("fp", "least", "n")
    roots = {r["fp"]: r["root"] for r in simhash.clusters(groups.select("fp", "n")).collect()}
    got: dict = {}
    for i in sorted(signed):
        got.setdefault(roots[signed[i]], i)
    assert {i: got[roots[f]] for i, f in signed.items()} == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base + " more"), (9, base.upper()), (2, None), (4, ""), (7, " \n"), (8, "alone in here"), (8, "alone in here"), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumnRenamed("n_chars", "component_id")
    out = {(r["doc_id"]): r["component_id"] for r in simhash.report(docs).collect()}
    assert out == {5: 3, 3: 3, 9: 3, 2: 2, 4: 2, 7: 2, 8: 8, None: 3}
    kept = simhash.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 8] and kept.columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.report(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_every_linked_pair_shares_a_key(spark):
    """All ways to lay up to four differing bits over the segments, with bits at their edges and in them."""
    rng = random.Random(11)
    rows = []
    for n in range(6000):
        flips = rng.sample(range(64), rng.randint(1, 4))
        if n % 2:  # one bit in each segment
            flips = [rng.randrange(low, low + bits) for low, bits in [simhash.SHORT, *simhash.LONG]]
        a = rng.getrandbits(64)
        rows.append((a, a ^ sum(1 << b for b in flips)))
    sign = lambda x: x - 2**64 if x >> 63 else x
    pairs = spark.createDataFrame([(n, sign(f)) for n, two in enumerate(rows) for f in two], "n long, fp long")
    keys = simhash.keyed(pairs, simhash.long_keys() + simhash.short_keys())
    met = keys.groupBy("n", "key").count().filter("count > 1").select("n").distinct().count()
    assert met == len(rows)
