import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pyarrow as pa

from caselens.llm import audio


def test_wav_is_standard_and_lossless():
    payload = audio.padded("é text".encode())
    assert len(payload) == 576 and payload.endswith(b"\xff") and len(audio.padded(b"")) == 576 and len(audio.padded(b"x" * 577)) == 1152
    with wave.open(io.BytesIO(audio.to_wav(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(10**6)) == (1, 1, audio.RATE, payload)
    assert audio.from_wav(audio.to_wav(payload)) == payload and audio.from_wav(audio.to_wav(b"odd")) == b"odd"


def test_resampling_matches_the_plain_filter():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 600, dtype=np.uint8)
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    phases = audio.low_pass()
    h = np.zeros(up * taps)
    for r in range(up):
        h[r::up] = phases[r][::-1]
    x = np.zeros(len(samples) * up)
    x[::up] = (samples.astype(float) - 128) / 128
    want = np.convolve(x, h)[::down][:400]
    assert np.allclose(audio.resampled(samples, 0, 400), want, atol=1e-5)
    assert np.allclose(audio.resampled(samples, 100, 260), want[100:260], atol=1e-5)


def test_resampling_keeps_a_tone():
    n = np.arange(6000)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 500 * n / audio.RATE)).astype(np.uint8)
    y = audio.resampled(tone, 0, 4000)[200:-200]
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(np.argmax(spectrum) * audio.OUT_RATE / len(y) - 500) < 5
    assert abs(np.abs(y).max() - 100 / 128) < 0.05


def test_blocks_do_not_change_the_features(monkeypatch):
    payload = audio.padded(bytes(random.Random(3).randrange(256) for _ in range(9000)))
    whole = audio.log_mel(payload)
    monkeypatch.setattr(audio, "BLOCK", 7)
    parts = audio.log_mel(payload)
    assert np.allclose(whole[0].astype(float), parts[0].astype(float), atol=1e-2) and np.allclose(whole[1], parts[1], atol=1e-4)


def test_hysteresis():
    levels = np.array([-20, -9, -9.7, -9.7, -20, -9.7, -9.4, -9.79, -9.9, -9])
    assert audio.segments(levels, -9.5, -9.8).tolist() == [[1, 4], [6, 8], [9, 10]]
    assert audio.segments(np.full(5, -50.0)).tolist() == []


def test_tensors():
    bands = np.arange(100 * 4, dtype=np.float16).reshape(100, 4)
    tensors, spans = audio.patches(bands, np.array([[2, 10], [20, 61]]), patch=16)
    assert spans.tolist() == [[2, 10], [20, 36], [36, 52], [52, 61]] and tensors.shape == (4, 16, 4)
    assert (tensors[0, :8] == bands[2:10]).all() and not tensors[0, 8:].any()
    table = pa.ipc.open_stream(audio.arrow_stream(tensors, spans)).read_all()
    assert table.schema.field("log_mel").type.shape == [16, 4]
    assert (table["log_mel"].combine_chunks().to_numpy_ndarray() == tensors).all()
    assert table["start_s"].to_pylist() == [s * audio.HOP / audio.OUT_RATE for s, _ in spans.tolist()]


def test_report(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (4, "Hello"), (5, "é" * 5000), (None, "x" * 576)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in audio.report(docs).collect()}
    for i, t in rows:
        payload = audio.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(audio.to_wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
    assert got[1]["feature"] == got[4]["feature"] != got[5]["feature"] and got[2]["feature"] == got[3]["feature"]
    assert audio.report(docs.limit(0)).count() == 0


def test_every_part_of_a_text_counts():
    rng = random.Random(5)
    for letters in ("etaoin shrdlu", "ETAOIN SHRDLU", "0123456789", "éàüñ ", "漢字仮名", "слово "):
        text = "".join(rng.choices(letters, k=3000)).encode()
        payload = audio.padded(text)
        frames, found, stream = audio.features(payload, len(text))
        middle = len(text) // 2
        other = text[:middle] + bytes(rng.sample(text[middle : middle + 300], 300)) + text[middle + 300 :]
        assert audio.features(audio.padded(other), len(text))[2] != stream
        kept = sum(pa.ipc.open_stream(stream).read_all()["frames"].to_pylist())
        assert found and kept >= audio.frame_count(len(text)) - 1, letters
    assert audio.features(audio.padded(b""), 0)[1] == audio.features(audio.padded(b"\x80" * 576), 576)[1] == 0


def test_pauses_part_segments_and_padding_is_silent():
    rng = random.Random(6)
    sound = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    text = sound(6000) + b"\x80" * 3000 + sound(6000)
    payload = audio.padded(text + sound(1))
    assert audio.features(payload, len(text) + 1)[1] == 2
    changed = payload[: len(text) + 1] + b"\x01" * (len(payload) - len(text) - 1)
    assert audio.features(changed, len(text) + 1) == audio.features(payload, len(text) + 1)


def test_hysteresis_follows_the_level():
    levels = np.array([-60.0, -20, -20, -31, -31, -40, -31, -20, -50])
    for shift in (0, 15, -15):
        assert audio.segments(levels + shift - audio.own_level(levels + shift)).tolist() == [[1, 5], [7, 8]]
    assert len({audio.features(audio.padded(t), len(t)) for t in (b"z", b"y", b"a", b"zz", b"")}) == 5
