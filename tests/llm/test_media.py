import hashlib
import io
import wave
import zlib

import numpy as np
from odd_texts import ODD

from fidelis.llm import media


def test_payloads_are_stored_without_loss(docs_of):
    rows = {r.doc_id: r for r in media.media_columns(docs_of(ODD), with_media=True).collect()}
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getsampwidth(), w.readframes(w.getnframes())) == (1, payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and len(r.times) == len(r.codes)
    assert rows[6].feature == rows[7].feature
    assert len({rows[i].feature for i in (0, 5, 6, 8)}) == 4


def test_none(docs_of):
    assert media.media_columns(docs_of(["a"]).where("false")).count() == 0


def test_a_tone_is_one_peak_per_frame():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    assert set(media.peaks(tone)[:-1, 0].tolist()) == {20}
    n, times, codes = media.fingerprint(tone)
    assert n == 31 and times[:6].tolist() == [0] * 6 and codes[3] == 20 << 16 | 20 << 8 | 1


def test_blocks_do_not_show(monkeypatch):
    sound = np.random.Generator(np.random.PCG64(1)).integers(0, 256, 40000).astype(np.uint8)
    whole = media.peaks(sound)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.peaks(sound) == whole).all()


def plain_fingerprint(payload):
    """Peaks and pairs frame by frame: the powers of each frame's peaks, and the pairs' times and codes given the peaks."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    d = np.concatenate(([np.float32(0)], x[1:] - x[:-1]))
    starts = [0]
    while starts[-1] + media.FRAME < len(x):
        starts.append(starts[-1] + media.HOP)
    powers = []
    for a in starts:
        frame = np.zeros(media.FRAME, np.float32)
        part = d[a : a + media.FRAME]
        frame[: len(part)] = part
        powers.append(np.abs(np.fft.rfft(frame * media._HANN))[1:])
    return powers


def plain_pairs(peaks):
    times, codes = [], []
    for t, own in enumerate(peaks):
        others = [(p, 0) for p in own[1:]] + [(peaks[t + g][0], g) for g in range(1, media.FAN + 1) if t + g < len(peaks)]
        for p, gap in others:
            if own[0] and p:
                times.append(t)
                codes.append(own[0] * 65536 + p * 256 + gap)
    return times, codes


def test_the_query_s_arrays_match_a_plain_version(docs_of):
    rng = np.random.Generator(np.random.PCG64(5))
    texts = [*ODD[:-1], "word " * 300, "x" * 1000, "".join(map(chr, rng.integers(32, 127, 5000))), "aé" * 64, "y" * 64, "z" * 65, "q w" * 85 + "!"]
    for r in media.media_columns(docs_of(texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        powers, bins = plain_fingerprint(payload), media.peaks(np.frombuffer(payload, np.uint8))
        assert len(powers) == len(bins) == r.n_frames
        for power, own in zip(powers, bins, strict=True):
            want = np.sort(power)[::-1][: media.PEAKS]
            assert np.allclose([power[b - 1] if b else 0.0 for b in own], np.where(want > 1e-3, want, 0.0), rtol=1e-3, atol=2e-3)
        times, codes = plain_pairs(bins.tolist())
        assert (r.times, r.codes) == (times, codes)
        digest = hashlib.sha256(np.array(list(zip(times, codes, strict=True)), "<i4").reshape(-1, 2).tobytes()).hexdigest()
        assert r.feature == f"{len(bins)}:{len(times)}:{digest}"
