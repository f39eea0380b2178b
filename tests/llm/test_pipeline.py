import math
import random

from tokenizers import Tokenizer

import corpus_pipeline
from caselens.llm import mixing, packing, simhash
from caselens.llm.common import written


def by_hand(rows):
    """(doc_id, start, length, window, sequence_id, offset) of each piece of (doc_id, text, source), none of which goes."""
    plain = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    queues = {}
    for i, t, s in sorted(rows):
        queues.setdefault("" if s is None else f"={s}", []).append((i, len(t.encode())))
    size = {q: sum(n for _, n in docs) for q, docs in queues.items()}
    weights = {q: float(n) ** 0.5 for q, n in size.items()}
    slots = []
    for queue, _, first, last, count, frame, base, offsets in mixing.phases({q: (n - 1) // mixing.BLOCK_BYTES + 1 for q, n in size.items()}, weights):
        at = 0
        for i, n in queues[queue]:
            if first <= at // mixing.BLOCK_BYTES < last:
                lap, k = divmod(at // mixing.BLOCK_BYTES - first, count)
                slots.append((base + lap * frame + offsets[k], at, i, queue))
            at += n
    sent, packets = dict.fromkeys(queues, 0), []
    for position, (_, _, i, queue) in enumerate(sorted(slots)):
        quantum = weights[queue] / sum(weights.values()) * packing.WINDOW * packing.SEQUENCE
        for start in range(0, tokens[i], packing.SEQUENCE):
            n = min(packing.SEQUENCE, tokens[i] - start)
            sent[queue] += n
            packets.append((math.ceil(sent[queue] / quantum), position, start, n, i))
    total = sum(tokens.values())
    ends = list(range(packing.SEQUENCE, total + 1, packing.SEQUENCE))
    rest = total % packing.SEQUENCE
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    out, at, sequence = set(), 0, 0
    for window, _, start, n, i in sorted(packets):
        while n:
            begun = ends[sequence - 1] if sequence else 0
            part = min(n, ends[sequence] - at)
            out.add((i, start, part, window, sequence, at - begun))
            at, start, n = at + part, start + part, n - part
            sequence += at == ends[sequence]
    return out


def test_run_follows_the_mixing_plan(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([20, 90, 200]))), rng.choice(["a"] * 9 + ["b"] * 2 + [None])) for i in range(900)]
    rows.append((900, " ".join(rng.choices(words, k=9000)), "b"))
    table = spark.createDataFrame([(*r, "en") for r in rows] + [(901, "12 34", "a", "en")], "doc_id long, text string, source string, lang string")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "start", "length", "window", "sequence_id", "offset"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {tuple(p[c] for c in names) for p in pieces}
    assert got == by_hand(rows) and len(got) == len(pieces)
    assert all(p["lang_pred"] == "en" and 0 < p["score"] <= 1 for p in pieces)
    unmixed = {tuple(p[c] for c in names) for p in packing.pack(table.filter("doc_id < 901")).collect()}
    assert got != unmixed


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def kept_by_hand(rows):
    """The (doc_id, text, source) that the first three stages keep."""
    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    best = {}
    for r in rows:
        if lowered(r[1]) not in best or r[0] > best[lowered(r[1])][0]:
            best[lowered(r[1])] = r
    rows = list(best.values())
    prints = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if ((prints[i] ^ prints[k]) & (2**64 - 1)).bit_count() <= simhash.DISTANCE:
                a, b = group[i], group[k]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r), r)
    return sorted(least.values())


def cases():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.choice([1, 30, 300])), rng.choice(["a", "a", "b", None])) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "b"), (202, " \n ", None), (203, "12 + 34", "a")]
    rows += [(300 + i, rows[i][1].upper(), "b") for i in range(10)] + [rows[20], rows[20]]  # exact copies, repeated rows
    for i in range(8):  # near copies: one word in 300 differs
        near = text(300).split(" ")
        rows += [(400 + 3 * i + k, " ".join([*near[: 50 * k], f"new{k}", *near[50 * k + 1 :]]), "a") for k in range(3)]
    return rows + [(500, text(30_000), "b"), (501, "é" * 5000, "a")]


def test_nulls_copies_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    rows = cases()
    kept = kept_by_hand(rows)
    assert len(kept) <= len({r[0] for r in rows}) - 20
    schema = "doc_id long, text string, source string, lang string, score string, mix_position string, digest int, row int, fp int, kept int"
    table = spark.createDataFrame([(*r, "en" if r[0] % 7 else None, "x", "y", 1, 2, 3, 4) for r in rows], schema)
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert {c for c, _ in schema_of(table)} <= set(docs.columns) and len(set(docs.columns)) == len(docs.columns)
        if name in ("exact_dedup", "simhash_dedup"):
            assert docs.columns == columns
        columns = docs.columns
        if name == "simhash_dedup":
            assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == kept
            assert {(r.digest, r.row, r.fp, r.kept) for r in docs.collect()} == {(1, 2, 3, 4)}
    names = ["doc_id", "start", "length", "window", "sequence_id", "offset"]
    pieces = [tuple(p[c] for c in names) for p in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()]
    assert len(set(pieces)) == len(pieces) and set(pieces) == by_hand(kept)


def schema_of(table):
    return table.dtypes


def test_empty_table_and_rows_without_doc_id(spark, tmp_path):
    rows_set = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows_set, "77")
    before = {k: spark.conf.get(k) for k in (rows_set, "spark.sql.shuffle.partitions")}
    schema = "doc_id long, text string, source string, lang string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rows = [(None, "the same words", "a", "en"), (None, "the same words", "a", "en"), (None, "other things said here", None, None), (1, "The Same Words", "a", "en")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == [("1", "The Same Words"), ("None", "other things said here")]
    assert before == {k: spark.conf.get(k) for k in before}, "what the caller sets is left"
    spark.conf.unset(rows_set)
