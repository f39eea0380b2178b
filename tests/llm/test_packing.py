import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caselens.llm import packing

SCHEMA = "doc_id long, text string, source string, ids string"


def test_encoder_matches_the_tokenizer():
    path = packing.default_tokenizer()
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path)
    plain.encode_special_tokens = True
    rng = random.Random(6)
    alphabet = ["word", "Wörd", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "-", "。", "漢字", "\x1c", " ", " ", "\u0085", "<|endoftext|>", "😀", "​"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(2000)]
    got = fast.encode(pa.array([*texts, None])).to_pylist()
    for text, ids in zip([*texts, ""], got, strict=True):
        assert np.frombuffer(ids, fast.kind).tolist() == plain.encode(text, add_special_tokens=False).ids + [1], repr(text)
    assert fast.encode(pa.array([], pa.string())).to_pylist() == []


def test_encoder_forgets_and_slices(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    monkeypatch.setattr(packing, "SLICE", 4000)
    path = packing.default_tokenizer()
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdé,", k=rng.randrange(1, 60))) for _ in range(rng.randrange(400))) for _ in range(60)]
    for text, ids in zip(texts, fast.encode(pa.array(texts)).to_pylist(), strict=True):
        assert np.frombuffer(ids, fast.kind).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def docs(spark, n=120):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "béta", "gamma,", "\n"], k=rng.choice([0, 3, 40, 300, 3000]))), rng.choice(["a", "a", "b", None]), "clash") for i in range(n)]
    rows += [(n, None, "c", ""), (n + 1, "", "c", ""), (5, "again", "b", ""), (None, "no id", "b", "")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pieces(spark):
    rows, table = docs(spark)
    pieces = packing.pack(table, window=2).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((r[0] if r[0] is not None else -1, tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    total = sum(len(ids) for _, ids in want)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        by_doc.setdefault((p["doc_id"] if p["doc_id"] is not None else -1, p["doc_tokens"]), []).append((p["start"], ids))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    got = []
    for (doc, _), parts in by_doc.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + len(x) == b for (a, x), (b, _) in zip(parts, parts[1:]))
        got.append((doc, tuple(i for _, x in parts for i in x)))
    assert sorted(got) == want
    sizes = []
    for k in range(len(by_sequence)):
        at = 0
        for offset, length in sorted(by_sequence[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sum(sizes) == total and all(s == 2048 for s in sizes[: total // 2048])
    assert all(s & (s - 1) == 0 for s in sizes[total // 2048 :])


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * 50, "a" if i % 4 else "b", "") for i in range(2000)]
    table = spark.createDataFrame(rows, SCHEMA)
    counts: dict = {}
    for p in packing.pack(table, window=4).collect():
        counts.setdefault(p["window"], {}).setdefault(p["queue"], []).append(p["length"])
    for w in sorted(counts)[:-1]:
        assert abs(sum(counts[w]["=b"]) - 0.25 * 4 * 2048) <= 110  # within two documents
    even = {}
    for p in packing.pack(table, window=4, weights={"a": 0.5, "b": 0.5}).collect():
        even.setdefault(p["window"], {}).setdefault(p["queue"], []).append(p["length"])
    assert all(abs(sum(even[w]["=b"]) - 4096) <= 110 for w in sorted(even)[:3])


def test_weights_are_scaled_and_must_be_positive(spark):
    table = spark.createDataFrame([(i, "word " * 50, "a" if i % 4 else "b", "") for i in range(400)], SCHEMA)
    names = ["doc_id", "start", "window", "sequence_id", "offset"]
    runs = [sorted(map(tuple, packing.pack(table, window=4, weights=w).select(*names).collect())) for w in ({"a": 1, "b": 3}, {"a": 0.25, "b": 0.75})]
    assert runs[0] == runs[1]
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.pack(table, weights={"a": bad})


def test_empty(spark):
    assert packing.report(spark.createDataFrame([], SCHEMA)).count() == 0
