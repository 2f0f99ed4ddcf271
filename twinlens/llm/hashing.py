"""Vectorised 64-bit hashing of words and word shingles over UTF-8 buffers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(kind)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_of_chunk(raw: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _power_table("up", _P, n), out=total[1:])
    inverse = _power_table("down", _P_INV, n)
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased, in order.

    A text of any length is worked through in chunks cut at white space.
    """
    if len(raw) <= _CHUNK:
        return _words_of_chunk(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):
            back = np.flatnonzero(_SPACE[raw[at:end]])
            while not len(back) and end < len(raw):
                end = min(len(raw), end + _CHUNK)
                back = np.flatnonzero(_SPACE[raw[at:end]])
            if len(back) and end < len(raw):
                end = at + int(back[-1]) + 1
        parts.append(_words_of_chunk(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    w = min(width, len(words))
    total = np.zeros(len(words) - w + 1, dtype=np.uint64)
    for k in range(w):
        total = mix(total + words[k : len(words) - w + 1 + k] + np.uint64(k + 1))
    return np.unique(total)


def texts_utf8(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each string of an Arrow array, without copies."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = np.asarray(column.is_valid())
    for k in range(len(column)):
        yield values[offsets[k] : offsets[k + 1]] if valid[k] else None


def similarity_sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017).

    In round i < bins every item is thrown into a random bin with the value
    (i, random); a bin keeps its least value, so a later round only matters to
    bins that are still empty. Rounds bins .. 2*bins-1 send all items to bin
    i - bins, which fills whatever is left. Costs about items + bins * ln(bins)
    hashes. Two sets agree in a coordinate with probability equal to their
    Jaccard similarity, with concentration as for independent samples.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(bins, empty, dtype=np.uint64)
    n, at = len(items), 0
    if not n:
        return sketch
    step = max(1, math.ceil(bins * (math.log(bins) + 4) / n))
    low = np.uint64((1 << 52) - 1)
    while at < bins:
        rounds = np.arange(at, min(bins, at + step), dtype=np.uint64)[:, None]
        drawn = mix(items[None, :] + (rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        where = ((drawn >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(sketch, where.ravel(), ((rounds << np.uint64(52)) | (drawn & low)).ravel())
        at += len(rounds)
        if (sketch != empty).all():
            return sketch
    with np.errstate(over="ignore"):
        _fill_bins(sketch, items, bins, low, empty)
    return sketch


def _fill_bins(sketch: np.ndarray, items: np.ndarray, bins: int, low: np.uint64, empty: np.uint64) -> None:
    for k in np.flatnonzero(sketch == empty):
        i = np.uint64(bins + int(k))
        sketch[k] = (i << np.uint64(52)) | (mix(items + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & low).min()
