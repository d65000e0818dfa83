"""64-bit hashes of the words of many texts at once, straight from Arrow's buffers.

A word's hash is the polynomial of its bytes, taken from running sums over the whole
slice, and then mixed. It depends on the word alone, so it is the same in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Powers kept per worker; longer slices compute the rest for themselves.
KEPT_POWERS = 2 << 20

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits (uint64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, KEPT_POWERS), np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _powers[name] = have[:KEPT_POWERS].copy()
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and where each text starts and ends in them."""
    raw = texts.buffers()
    ends = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if raw[2] is None or ends[-1] == ends[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(raw[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~separators[data]
    # A text's first byte starts a word even where the text before ends in one.
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    opens[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mixed 64-bit hash of each byte span."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, len(data))[starts])


def word_hashes(texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER_ASCII[data]
    starts, ends, counts = word_spans(data, offsets, separators)
    return span_hashes(data, starts, ends), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (positions near the end wrap into the next text)."""
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    weight = 0x8CB92BA72F3D8DD7
    for i in range(k):
        factor = np.uint64(weight)
        if i < n:
            out[: n - i] += words[i:] * factor
        weight = (weight * _BASE + 2) & ((1 << 64) - 1) | 1
    return mix(out)
