"""Media columns: texts as 8-bit sound, read back by the wave module, with spectral-peak pair fingerprints.

A payload is a text's UTF-8, zero-padded to a positive multiple of UNIT bytes. It is stored without loss as
unsigned 8-bit samples of a mono WAV; what is returned is computed from the samples that the wave module reads
back from the stored bytes. First differences of the samples (0 for the first one), which lift the high bins of text
against its low ones, are cut into frames of FRAME, half overlapping, that go through a Hann-windowed Fourier
transform. A frame's peaks are its PEAKS strongest bins above the constant part; the strongest is paired with the
others and with the strongest of the next FAN frames. A pair's code holds both bins and the distance, and its
time is the first frame.

Frames are taken in blocks, so memory does not grow with the length of a text. Equal texts give equal values,
for each is transformed by itself. Defined results: a null text is the empty one, which is UNIT zero bytes;
repeated rows come back once for each row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fidelis.llm.common import slices

UNIT, RATE, FRAME, HOP, PEAKS, FAN, BLOCK = 64, 8000, 256, 128, 4, 3, 2048
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, times array<int>, codes array<int>, media binary"
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit sound is asked for")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest bins, strongest first and from 1 on, of each frame; 0 where a frame is silent. The last frame is filled with the last sample."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    out = np.zeros((n, PEAKS), np.int32)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        part = samples[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32)
        part = np.pad(part, (0, (b - 1 - a) * HOP + FRAME - len(part)), mode="edge")
        part = np.diff(part, prepend=part[:1] if a == 0 else np.float32(samples[a * HOP - 1]))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _HANN
        power = np.abs(np.fft.rfft(frames, axis=1))[:, 1:]
        top = np.argpartition(power, -PEAKS, axis=1)[:, -PEAKS:]
        high = np.take_along_axis(power, top, axis=1)
        order = np.argsort(-high, axis=1, kind="stable")
        loud = np.take_along_axis(high, order, axis=1) > 1e-3
        out[a:b] = np.where(loud, np.take_along_axis(top, order, axis=1) + 1, 0)
    return out


def fingerprint(samples: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames, and the times and codes of all peak pairs, by time; within a frame, then by distance."""
    bins = peaks(samples)
    n = len(bins)
    steps = PEAKS - 1 + FAN
    time, step = np.repeat(np.arange(n, dtype=np.int32), steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), n)
    gap = np.maximum(0, step - PEAKS + 1)
    ok = time + gap < n
    time, step, gap = time[ok], step[ok], gap[ok]
    first, second = bins[time, 0], np.where(gap == 0, bins[time, np.minimum(step, PEAKS - 1)], bins[time + gap, 0])
    ok = (first > 0) & (second > 0)
    return n, time[ok], ((first << 16) | (second << 8) | gap)[ok].astype(np.int32)


def _media(batches: Iterator[pa.RecordBatch], with_media: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows, times, codes = [], [], []
        for text in part.column(1).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = to_wav(raw + bytes(-len(raw) % UNIT if raw else UNIT))
            back = from_wav(media)
            n, time, code = fingerprint(np.frombuffer(back, np.uint8))
            digest = hashlib.sha256(np.column_stack((time, code)).astype("<i4").tobytes()).hexdigest()
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{n}:{len(time)}:{digest}", n, media if with_media else None))
            times.append(time)
            codes.append(code)
        edges = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in times]))), pa.int32())
        listed = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x), pa.int32())) for x in (times, codes)]
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), *listed, pa.array(cols[-1], pa.binary())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "times", "codes", "media"],
        )


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """A row of MEDIA for each row of docs (doc_id, text, ...); times and codes are parallel arrays."""
    base = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return base.mapInArrow(lambda it: _media(it, with_media), MEDIA)
