"""Vectorised word and shingle hashing over raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the rolling word hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _power(n: int, which: str) -> np.ndarray:
    held = _powers.get(which)
    if held is None or len(held) < n:
        base = np.full(max(n, 1 << 16), U(_P if which == "up" else _P_INV), dtype=np.uint64)
        base[0] = U(1)
        held = np.cumprod(base, dtype=np.uint64)
        if len(held) <= 1 << 22:
            _powers[which] = held
    return held[:n]


#: Bytes that are hashed at once; a window ends before a blank, so only a longer word makes it longer.
WINDOW = 1 << 18


def _windows(space: np.ndarray) -> list[int]:
    """Edges of the windows: 0, the length, and blanks in between."""
    edges, n = [0], len(space)
    while n - edges[-1] > WINDOW:
        at = edges[-1] + WINDOW
        back = np.flatnonzero(space[edges[-1] + 1 : at])
        if len(back):
            at = edges[-1] + 1 + int(back[-1])
        else:
            # A word of more than a window: on to its end, a window at a time.
            while at < n and not (ahead := np.flatnonzero(space[at : at + WINDOW])).size:
                at += WINDOW
            at = n if at >= n else at + int(ahead[0])
        edges.append(at)
    return [*edges, n] if edges[-1] < n else edges


def _words_of(buf: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _power(len(buf), "up"), dtype=np.uint64, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _power(len(buf), "down")[starts], 1) ^ mix((ends - starts).astype(np.uint64), 2)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words of each text.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a null text has none. What is held for each byte is held for a
    window of them only.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[buf]
    edges = _windows(space)
    found = [(a, *_words_of(buf[a:b], space[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    starts, words = np.concatenate([a + s for a, s, _ in found]), np.concatenate([w for _, _, w in found])
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return words, np.diff(np.searchsorted(starts, at))


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text, one after another, and each text's number of them.

    A text of fewer than k words has one shingle, its whole word sequence; a text without words has none.
    """
    words, n_words = word_hashes(texts)
    first = np.cumsum(n_words) - n_words
    n_sh = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.cumsum(n_sh) - n_sh
    out = np.empty(int(n_sh.sum()), np.uint64)
    long = np.flatnonzero(n_words >= k)
    if len(long):
        span = n_sh[long]
        offset = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        at = np.repeat(first[long], span) + offset
        h = words[at] * _STEP[0]
        for j in range(1, k):
            h += words[at + j] * _STEP[j]
        out[np.repeat(out_first[long], span) + offset] = mix(h, 3)
    for n in range(1, k):
        if len(short := np.flatnonzero(n_words == n)):
            h = np.full(len(short), U(n))
            for j in range(n):
                h = h + words[first[short] + j] * _STEP[j]
            out[out_first[short]] = mix(h, 4 + n)
    for a, n in zip(out_first.tolist(), n_sh.tolist(), strict=True):
        if n > 1:
            out[a : a + n].sort()
    if not len(out):
        return out, n_sh
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    keep[out_first[n_sh > 0]] = True
    seen = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], seen[out_first + n_sh] - seen[out_first]
