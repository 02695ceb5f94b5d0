"""Words of many texts at once as 64-bit numbers: numpy on the UTF-8 bytes, no string per word."""

from __future__ import annotations

import numpy as np

#: White space is \x20 and \x09 to \x0D.
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> list[np.ndarray]:
    """The powers of the base and of its inverse up to the size of a block."""
    if not _powers:
        for base in (_BASE, _INVERSE):
            table = np.full(_BLOCK + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def _long_span(data: np.ndarray, table: np.ndarray) -> np.uint64:
    """The sum over a span longer than a block, block by block."""
    power, total, at = _power_tables()[0], np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for low in range(0, len(data), _BLOCK):
        block = table[data[low: low + _BLOCK]]
        total += np.sum(block * power[: len(block)], dtype=np.uint64) * at
        at *= power[_BLOCK]
    return total[0]


def find_words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more entry at the end).

    A word is a maximal run of bytes that are not in ``separator``; it never crosses the end of a text.
    """
    inside = ~separator[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        last = bounds[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit number of each span ``data[start:end]`` (ascending, disjoint); A-Z count as a-z if ``lower``."""
    out = np.empty(len(starts), np.uint64)
    table = _VALUES[_LOWER] if lower else _VALUES
    power, inverse = _power_tables()
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        a, b = starts[i:j] - low, ends[i:j] - low
        if high - low > _BLOCK:
            part = np.array([_long_span(data[low:high], table)])
        else:
            values = table[data[low:high]]
            values *= power[: high - low]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            part = (sums[b] - sums[a]) * inverse[a]
        out[i:j] = mix(part ^ ((b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        i = j
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One number for every ``width`` consecutive entries."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k: k + n] + np.uint64(k + 1))
    return out
