"""Mixture-controlled packing of token sequences.

Each source is a queue of its documents. Deficit round-robin deals windows: in every window a source may send as many
tokens as its quantum, its share of the window, and what it could not send stays as its deficit for the next window. A
packet (a piece of at most one sequence) so leaves in the first window r for which r quanta reach the end of the packet
in its queue, which a running total gives for all packets at once, across windows and partitions. The windows, one after
another, are then cut into sequences, and the rest of the last one into sequences of a power of two: nothing is padded.

Defined cases: a null text is empty (its only id is the end id); a null source is a queue of its own; rows that repeat a
doc_id, null ones too, are packed one by one; a very long text becomes many packets; an empty table gives no piece;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, running_total, written

#: Tokens of a sequence; sequences of a window; the id after each document.
SEQUENCE, WINDOW, END_ID = 2048, 32, 1
#: Words whose ids a worker remembers (twice as many at most), the longest of them, bytes of text encoded at a time.
CACHE, CACHE_CHARS, SLICE = 300_000, 48, 8 << 20
# The characters that Python or the tokenizer takes for white space.
SPACES = "\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Token ids of whole texts. Byte-level BPE never joins what white space parts (but for one space before a word), so
    a text is cut there and the ids of frequent words are remembered; the tokenizer makes all of them. Cutting, looking
    for equal words and putting ids together are Arrow's work, so Python sees each distinct word of a slice once."""

    #: Words with the space before them, where white space stands in runs that the tokenizer cuts elsewhere.
    words = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    runs = f"[{SPACES}] (?:[{SPACES}]|\\z)"
    #: White space for Python but not for the tokenizer's own pattern: texts of such runs are encoded in one piece.
    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = self.kind.type(end_id).tobytes()
        self.sizes = self._token_bytes()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _token_bytes(self) -> np.ndarray:
        """The bytes of text that each id stands for: in a byte-level vocabulary a character of a token is a byte."""
        sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            sizes[i] = len(token)
        return sizes

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words met since the last ``CACHE`` new ones are remembered."""
        out = list(map(self.recent.get, words))
        for at in range(0, len(words), 20_000):
            missing = [i for i in range(at, min(at + 20_000, len(words))) if out[i] is None]
            asked = [words[i] for i in missing]
            known = list(map(self.older.get, asked))
            new = [w for w, x in zip(asked, known, strict=True) if x is None]
            made = dict(zip(new, self._new(new), strict=True))
            for i, w, x in zip(missing, asked, known, strict=True):
                x = out[i] = made[w] if x is None else x
                if len(w) <= CACHE_CHARS:
                    self.recent[w] = x
            if len(self.recent) > CACHE:
                self.older, self.recent = self.recent, {}
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of words by the tokenizer. Those that begin with one space and go on without any are encoded in one
        text, whose tokens are dealt to the words by their bytes."""
        out: dict[int, bytes] = {}
        plain = [i for i, w in enumerate(words) if w[:1] == " " and w[1:2] and not w[1].isspace()]
        if plain:
            text = "".join([words[i] for i in plain])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([len(words[i].encode()) for i in plain])
            stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")
            raw, width, begin = ids.tobytes(), self.kind.itemsize, 0
            for i, stop in zip(plain, (stops * width).tolist(), strict=True):
                out[i] = raw[begin:stop]
                begin = stop
        others = [i for i in range(len(words)) if i not in out]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return [out[i] for i in range(len(words))]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id, little-endian, in 2 or 4 bytes each."""
        texts = pc.fill_null(texts, "")
        parts, begin, ends = [], 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            parts.append(self._encode(texts.slice(begin, stop - begin)))
            begin = stop
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _encode(self, texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        firsts = offsets[:-1]
        found = flat.dictionary_encode()
        at = found.indices.to_numpy().copy()
        at[firsts] = len(found.dictionary) + np.arange(len(firsts), dtype=at.dtype)  # no space before these
        ids = pa.array(self.ids([f" {w}" for w in strings(found.dictionary)] + strings(flat.take(pa.array(firsts)))), pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, ids.take(pa.array(at))), b"")
        uneven = pc.match_substring_regex(texts, self.runs)
        if pc.any(uneven).as_py():
            joined = pc.replace_with_mask(joined, uneven, pa.array([self._uneven(t) for t in texts.filter(uneven).to_pylist()], pa.binary()))
        return pc.binary_join_element_wise(joined, pa.scalar(self.end), pa.scalar(b""))

    def _uneven(self, text: str) -> bytes:
        return b"".join(self.ids([text] if self.odd.search(text) else self.words.findall(text)))


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


_encoders: dict[tuple[str, int], Encoder] = {}
_kinds: dict[tuple[str, int], np.dtype] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder for each file and worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def id_kind(spark: SparkSession, path: str, end_id: int = END_ID) -> np.dtype:
    """The type of the ids of a tokenizer, which a task looks up: the driver has no use for the tokenizer itself."""
    known = (path, end_id)
    if known not in _kinds:

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"width": pa.array([encoder(path, end_id).kind.itemsize] * len(batch), pa.int32())})

        _kinds[known] = np.dtype(f"<u{spark.range(1).mapInArrow(look, 'width int').first()[0]}")
    return _kinds[known]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """rid (a number of the row), doc_id, queue, n (its tokens) and ids of every row, and its columns ``keep``, written
    once."""

    @F.arrow_udf(T.BinaryType())
    def ids(text: pa.Array) -> pa.Array:
        return encoder(path, end_id).encode(text)

    width = id_kind(docs.sparkSession, path, end_id).itemsize
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", queue.alias("queue"), ids("text").alias("ids"), *keep)
    return written(rows.withColumn("n", (F.octet_length("ids") / width).cast("long")), "tokens")


def quanta(tokens: DataFrame, window_tokens: int, weights: dict[str | None, float] | None, planned: bool = False) -> DataFrame:
    """(queue, quantum) of each source: its weight, or else its share of all tokens, of a window; the weights of the
    sources at hand are scaled to one window in all. ``planned``: its mix_share."""
    if planned:
        return tokens.groupBy("queue").agg((F.max("mix_share") * window_tokens).alias("quantum"))
    if any(not (0 < w < float("inf")) for w in (weights or {}).values()):
        raise ValueError("weights must be positive and finite: a source of weight zero would never leave its queue")
    sums = tokens.groupBy("queue").agg(F.sum("n").alias("total"))
    everything = tokens.agg(F.sum("n")).first()[0] or 1
    weight = F.col("total") / F.lit(float(everything))
    if weights:
        given = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("" if s is None else f"={s}", float(w))])
        weight = F.coalesce(given[F.col("queue")], weight)
    sums = sums.select("queue", weight.alias("weight"))
    whole = sums.agg(F.sum("weight").alias("whole"))  # one row
    return sums.join(F.broadcast(whole)).select("queue", (F.col("weight") / F.col("whole") * window_tokens).alias("quantum"))


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    weights: dict[str | None, float] | None = None,
    end_id: int = END_ID,
    planned: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per piece: doc_id, source's queue, start, length, doc_tokens, window, sequence_id, offset and ids (the
    piece's ids, little-endian unsigned 32-bit). ``weights``: the target proportion of each source (those without one,
    and by default all, keep their share of the tokens, which holds in every window up to the last); they must be positive
    and need not add up to one. ``planned``: the
    plan of ``mixing.planned`` holds instead: queues and windows are in the order of mix_position, and mix_share is the
    target proportion. ``keep``: columns of ``docs`` that each of its pieces has too."""
    path = tokenizer or default_tokenizer()
    place = ["mix_position"] if planned else []
    tokens = tokenised(docs, path, end_id, (*keep, *place, *(["mix_share"] if planned else [])))
    count, total, last = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max(place[0]) if planned else F.lit(None)).first()
    buckets = F.lit(bucket_count(count))
    bucket = F.floor(F.col(place[0]) * buckets / F.lit((last or 0) + 1)) if planned else F.pmod(F.xxhash64("doc_id", "rid"), buckets)
    narrow = tokens.select("rid", "doc_id", "queue", "n", *place, bucket.alias("b"))
    queued = running_total(narrow, ["queue"], "b", [*place, "doc_id", "rid"], "n", "at").join(quanta(tokens, window * sequence, weights, planned), "queue")
    packets = queued.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(sequence).cast("long"))))
    packets = packets.withColumn("len", F.least(F.lit(sequence).cast("long"), F.col("n") - F.col("start"))).withColumn("at", F.col("at") + F.col("start"))
    packets = packets.withColumn("window", F.ceil((F.col("at") + F.col("len")) / F.col("quantum")).cast("long")).select("rid", "queue", *place, "at", "start", "len", "window")
    dealt = running_total(packets, [], "window", [*place, "queue", "at"], "len", "g")

    full = total // sequence * sequence
    ends, at = [], full
    for bit in reversed(range((total - full).bit_length())):
        if (total - full) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    tail = F.array(*[F.lit(x).cast("long") for x in ends]) if ends else F.array().cast("array<long>")
    stop = F.col("g") + F.col("len")
    edge = (F.floor(F.col("g") / sequence) + 1) * sequence
    inside = F.filter(F.concat(F.array(F.least(edge, F.lit(full))), tail), lambda x: (x > F.col("g")) & (x < stop))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("g"), stop), inside)))
    dealt = dealt.withColumn("cuts", cuts)
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("p"), F.get("cuts", i + 1).alias("q")))
    pieces = dealt.withColumn("s", F.explode(spans)).withColumn("p", F.col("s.p"))
    passed = F.size(F.filter(tail, lambda x: x <= F.col("p")))
    begun = F.when(F.col("p") < full, F.floor(F.col("p") / sequence) * sequence).otherwise(F.array_max(F.concat(F.array(F.lit(full).cast("long")), F.filter(tail, lambda x: x <= F.col("p")))))
    pieces = pieces.select(
        "rid",
        "window",
        (F.col("start") + F.col("p") - F.col("g")).alias("start"),
        (F.col("s.q") - F.col("p")).alias("length"),
        F.when(F.col("p") < full, F.floor(F.col("p") / sequence)).otherwise(F.lit(full // sequence) + passed).cast("long").alias("sequence_id"),
        (F.col("p") - begun).alias("offset"),
    )
    kind = id_kind(docs.sparkSession, path, end_id)

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut(ids: pa.Array, lengths: pa.Array) -> pa.Array:
        """The ids of each row in 4 bytes, cut into its pieces, which follow one another."""
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        wide = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).astype("<u4")
        stops = np.concatenate(([0], np.cumsum(lengths.flatten().to_numpy()))) * 4
        assert stops[-1] == wide.nbytes < 1 << 31
        parts = pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(wide)])
        counts = np.concatenate(([0], np.cumsum(pc.list_value_length(lengths).to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), parts)

    grouped = pieces.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "window", "sequence_id", "offset"))).alias("pieces"))
    joined = tokens.join(grouped, "rid").withColumn("cut", cut("ids", F.col("pieces.length")))
    each = joined.select("doc_id", "queue", F.col("n").alias("doc_tokens"), *keep, F.explode(F.arrays_zip("pieces", "cut")).alias("x"))
    return each.select("doc_id", "queue", "doc_tokens", "x.pieces.*", F.col("x.cut").alias("ids"), *keep)


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
