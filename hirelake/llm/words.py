"""Words of whole texts as numpy arrays, inside tasks."""

from __future__ import annotations

import numpy as np

# Bytes hashed at a time; bounds the temporary arrays.
SEGMENT_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GENERATOR = np.random.Generator(np.random.PCG64(20))
BYTE_VALUES = _GENERATOR.integers(0, 1 << 64, 256, dtype=np.uint64)

# Letters A-Z in lower case; what is neither a digit, a letter nor beyond ASCII separates words.
LETTER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def letter_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(LETTER_WORDS).split()


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Spread 64-bit values over all bits; a bijection for each seed."""
    x = values + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" in _POWERS and len(_POWERS["up"]) >= count:
        return _POWERS["up"], _POWERS["down"]
    up, down = _powers(MULTIPLIER, count), _powers(INVERSE, count)
    if count <= SEGMENT_BYTES + 1:
        _POWERS.update(up=up, down=down)
    return up, down


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: polynomial in random byte values, then mixed with the length."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashes = np.empty(len(words), dtype=np.uint64)
    first = 0
    while first < len(words):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + SEGMENT_BYTES, side="right")))
        size = int(ends[last - 1] - origin)
        up, down = _power_tables(size + 1 if size > SEGMENT_BYTES else SEGMENT_BYTES + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[origin:origin + size]] * up[:size], out=sums[1:])
        at, to = starts[first:last] - origin, ends[first:last] - origin
        hashes[first:last] = (sums[to] - sums[at]) * down[at]
        first = last
    return mix(hashes ^ lengths.astype(np.uint64), 1)


def window_hashes(words: np.ndarray, width: int, seed: int, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``width`` word hashes from each of ``starts`` on."""
    total = np.full(len(starts), seed, dtype=np.uint64)
    for k in range(width):
        total ^= words[starts + k]
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(29)
    return mix(total, seed)
