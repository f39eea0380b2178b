"""Audio features of media columns.

A payload is stored as the 8-bit samples of a WAV file. Reading it back gives samples that are resampled by a polyphase
filter, cut into overlapping frames, turned into log-mel energies, and segmented by energy with hysteresis (a segment
begins above the upper threshold and ends below the lower one; both lie below the payload's own level, so that speech
and text of any level are kept and pauses go). The padding counts as silence. Each segment becomes patches of a fixed shape (frames,
bands), an Arrow tensor column beside their time spans, kept as an Arrow IPC stream.

Defined cases: a null text is an empty payload, which padding makes one unit long; a payload of silence has no segment
and an empty tensor column; the last patch of a segment is padded with zeros and says how many frames it has; long
payloads are read in blocks of frames, so memory is bounded by the payload and one block; equal payloads give equal
bytes; an empty table gives an empty result; further columns are kept by ``stored`` and ``with_features``,
which replace those of the names they add.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads are padded with 255 to a positive multiple of this many bytes.
UNIT = 576
#: Rate of the stored samples; the resampler's steps up and down, and its taps a phase.
RATE, UP, DOWN, TAPS = 12_000, 2, 3, 12
#: Samples of a frame and from one to the next, mel bands, frames of a patch, frames read at a time.
FRAME, HOP, BANDS, PATCH, BLOCK = 256, 128, 32, 32, 2048
#: Thresholds of the segments, in dB of a frame's mean square against the payload's own level, and the level against full
#: scale under which a frame is silence (a frame with one sample off by one step is at -66 dB).
UPPER, LOWER, SILENCE = -6.0, -12.0, -70.0
OUT_RATE = RATE * UP // DOWN


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + b"\xff" * (max(1, -(-len(payload) // unit)) * unit - len(payload))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; its data are the payload's bytes."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit samples")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc filter of ``taps`` * ``up`` coefficients; row r is phase r, reversed for a sliding product."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(taps * up)
    h *= up / h.sum()
    return np.stack([h[r::up][::-1] for r in range(up)]).astype(np.float32)


def resampled(samples: np.ndarray, begin: int, end: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs ``begin`` to ``end`` - 1 of the whole signal's resampling; ``begin`` is a multiple of ``up``. Samples are
    bytes, silence (128) lies around them."""
    phases = low_pass(up, down)
    taps = phases.shape[1]
    rounds = -(-(end - begin) // up)
    first = begin // up * down
    low, high = first - taps + 1, first + rounds * down
    part = samples[max(0, low) : max(0, min(len(samples), high))].astype(np.float32)
    x = np.zeros(high - low, np.float32)
    x[max(0, -low) : max(0, -low) + len(part)] = (part - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, taps)
    out = np.empty((rounds, up), np.float32)
    for p in range(up):
        out[:, p] = windows[p * down // up :: down][:rounds] @ phases[p * down % up]
    return out.reshape(-1)[: end - begin]


@lru_cache
def mel_filters(bands: int = BANDS, frame: int = FRAME, rate: int = OUT_RATE) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def frame_count(samples: int) -> int:
    """Frames that cover the resampled signal; the last ones reach into silence."""
    return max(1, -(-(samples * UP // DOWN) // HOP))


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies [frames, bands] in float16, energy of each frame in dB)."""
    samples = np.frombuffer(payload, np.uint8)
    window = np.hanning(FRAME).astype(np.float32)
    total, bands, levels = frame_count(len(samples)), [], []
    for first in range(0, total, BLOCK):
        n = min(BLOCK, total - first)
        y = resampled(samples, first * HOP, (first + n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        levels.append(10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + 1e-10))
        spectrum = np.fft.rfft(frames * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        bands.append(np.log(power @ mel_filters() + 1e-6).astype(np.float16))
    return np.concatenate(bands), np.concatenate(levels)


def own_level(levels: np.ndarray) -> float:
    """The mean level of the frames that are not silence, in dB; that of full scale if all are."""
    sound = levels[levels >= SILENCE]
    return float(10 * np.log10(np.mean(10 ** (sound.astype(np.float64) / 10)))) if len(sound) else 0.0


def segments(levels: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> np.ndarray:
    """[begin, end) frames of each segment: on from a level of ``upper`` or more, off from one under ``lower``."""
    decided = np.where(levels >= upper, 1, np.where(levels < lower, 0, -1))
    last = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(levels)), -1))
    on = np.where(last >= 0, decided[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return edges.reshape(-1, 2)


def patches(bands: np.ndarray, spans: np.ndarray, patch: int = PATCH) -> tuple[np.ndarray, np.ndarray]:
    """(tensors [patches, patch, bands], [begin, end) frames of each): the segments cut into a fixed shape."""
    count = -(-(spans[:, 1] - spans[:, 0]) // patch)
    owner = np.repeat(np.arange(len(spans)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = spans[owner, 0] + nth * patch
    end = np.minimum(begin + patch, spans[owner, 1])
    at = begin[:, None] + np.arange(patch)
    tensors = np.where((at < end[:, None])[..., None], bands[np.minimum(at, len(bands) - 1)], np.float16(0))
    return tensors, np.stack([begin, end], 1)


def arrow_stream(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow IPC stream of (start_s, end_s, frames, log_mel), the last a fixed-shape tensor column."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float16(), tensors.shape[1:])
    flat = pa.array(np.ascontiguousarray(tensors).reshape(-1), pa.float16())
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, int(np.prod(tensors.shape[1:]))))
    seconds = spans * HOP / OUT_RATE
    batch = pa.record_batch([pa.array(seconds[:, 0]), pa.array(seconds[:, 1]), pa.array((spans[:, 1] - spans[:, 0]).astype(np.int32)), column], names=["start_s", "end_s", "frames", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(payload: bytes, size: int | None = None) -> tuple[int, int, bytes]:
    """(frames, segments, Arrow IPC stream of the segments' tensors) of a payload, whose bytes from ``size`` on are
    padding."""
    size = len(payload) if size is None else size
    bands, levels = log_mel(payload[:size] + b"\x80" * (len(payload) - size))
    spans = segments(levels - own_level(levels))
    return len(bands), len(spans), arrow_stream(*patches(bands, spans))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes and media: the text's UTF-8 bytes, padded, as a WAV file."""

    @F.pandas_udf(T.BinaryType())
    def media(text: pd.Series) -> pd.Series:
        return text.map(lambda t: to_wav(padded((t or "").encode("utf-8", "surrogatepass"))))

    return docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("media", media("text"))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, segments long, tensors binary"


def with_features(media: DataFrame) -> DataFrame:
    """``media`` (with n_bytes, the bytes before the padding) with what its media column holds, read back, and the
    features computed from that."""

    @F.pandas_udf(FEATURES)
    def read(column: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for m, size in zip(column, sizes, strict=True):
            payload = from_wav(m)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *features(payload, int(size))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    own = [c for c in media.columns if c not in {n.split()[0] for n in FEATURES.split(", ")}]
    return media.select(*own, read("media", "n_bytes").alias("_f")).select(*own, "_f.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (frames, segments
    and the SHA-256 of the tensor stream), frames, segments for every row of ``docs``."""
    found = with_features(stored(docs.select("doc_id", "text")))
    feature = F.concat_ws(":", F.col("frames").cast("string"), F.col("segments").cast("string"), F.sha2("tensors", 256))
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "frames",
        "segments",
    )
