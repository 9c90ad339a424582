"""Byte-level BPE ids of whole texts, fast enough for a corpus.

A text is cut into pieces by the vocabulary's published pattern ('s|'t|'re|'ve|'m|'ll|'d, an optional blank before letters,
numbers or other signs, white space), here with array operations over a block of texts. Ids of a piece depend on nothing
else, so each worker keeps those of the pieces it has met, found by a 64-bit hash; only new pieces are encoded. Pieces are not
compared beyond their hash. The vocabulary's added tokens are cut out of a text first, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken

from hirelake.llm.words import INVERSE, MULTIPLIER, mix

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)
BLOCK = 1 << 19
# Pieces kept per worker; then it starts anew.
KEPT = 1 << 20

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(found, every):
                table[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of several non-empty texts laid end to end."""
    size = len(points)
    kind = _classes()[points]
    first = np.zeros(size, dtype=bool)
    first[text_starts] = True
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(starts)
    ends = np.append(runs[1:], size)
    # White space before something else in the same text gives its last sign away: a blank joins what follows.
    inner = (kind[runs] == SPACE) & (ends < size)
    inner[inner] = ~first[ends[inner]]
    last = ends[inner] - 1
    starts[last] = True
    blank = points[last] == 32
    starts[last[blank] + 1] = False
    # A lone apostrophe that begins a piece takes s, t, m, d, re, ve or ll from the letters behind it.
    quote = runs[(kind[runs] == OTHER) & (ends - runs == 1) & (points[runs] == 39) & starts[runs] & (ends < size)]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    one, two = points[quote + 1], points[np.minimum(quote + 2, size - 1)]
    joined = (quote + 2 < size) & ~first[np.minimum(quote + 2, size - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    pair = joined & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                     | ((one == ord("l")) & (two == ord("l"))))
    for found, length in ((quote[short], 2), (quote[pair], 3)):
        starts[found + 1] = False
        rest = found + length
        rest = rest[rest < size]
        starts[rest[(kind[rest] == LETTER)]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids by a vocabulary file of the ``tokenizers`` library (byte-level BPE, no normaliser, no prefix blank)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, added = content["model"]["vocab"], content.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        # The file writes each byte as a printable sign: those that are printable in Latin-1 as themselves, the others
        # by the signs from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain}
        signs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if all(c in signs for c in token)
                 and token not in self.added}
        self.size = max([*vocabulary.values(), *self.added.values()]) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slots = np.zeros(1 << self.bits, dtype=np.int64)
        self.count, self.filled = 0, 0
        self.offsets, self.lengths = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=self.kind)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it is new. Open addressing with linear probing."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self.keys[at[left]]
            hit = keys == hashes[left]
            found[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (keys != 0)]
            at[left] = (at[left] + 1) & mask
        return found

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        for key, at, number in zip(hashes.tolist(), (hashes >> np.uint64(64 - self.bits)).tolist(), numbers.tolist(),
                                   strict=True):
            while self.keys[at]:
                at = (at + 1) & mask
            self.keys[at], self.slots[at] = key, number

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if 2 * (self.count + len(pieces)) > 1 << self.bits:
            while 2 * (self.count + len(pieces)) > 1 << self.bits:
                self.bits += 2
            used = self.keys != 0
            keys, slots = self.keys[used], self.slots[used]
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.slots = np.zeros(1 << self.bits, dtype=np.int64)
            self._place(keys, slots)
        ids = [self.coder.encode_ordinary(p) for p in pieces]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total = int(lengths.sum())
        while self.count + len(ids) > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        own = slice(self.count, self.count + len(ids))
        self.lengths[own] = lengths
        self.offsets[own] = self.filled + np.cumsum(lengths) - lengths
        self.pool[self.filled:self.filled + total] = np.fromiter((i for own in ids for i in own), self.kind, total)
        self._place(hashes, np.arange(self.count, self.count + len(ids)))
        self.count, self.filled = self.count + len(ids), self.filled + total

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        filled = [t for t in texts if t]
        if not filled:
            return [np.zeros(0, dtype=self.kind) for _ in texts]
        line = "".join(filled)
        points = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, filled), dtype=np.int64, count=len(filled))
        begins = np.cumsum(sizes) - sizes
        starts = piece_starts(points, begins)
        ends = np.append(starts[1:], len(points))
        up, down = _powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mix(points.astype(np.uint64), 3) * up[:-1], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64), 4)
        hashes[hashes == 0] = 1  # 0 marks an empty slot
        if self.count > KEPT:
            self._clear()
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._add(keys, [line[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[new] = self._find(hashes[new])
        lengths = self.lengths[found]
        upto = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.offsets[found] - (upto - lengths), lengths) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, begins[1:]) - 1]
        parts = iter(np.split(ids, cuts))
        return [next(parts) if t else np.zeros(0, dtype=self.kind) for t in texts]

    def _segments(self, text: str) -> list[str | int]:
        """The parts of a text, and the ids of added tokens between them."""
        if not any(t in text for t in self.added):
            return list(_parts(text))
        found = self.cuts.split(text)
        return [x for k, own in enumerate(found) for x in ([self.added[own]] if k % 2 else _parts(own))]

    def encode(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn; null like empty."""
        block, size = [], 0
        for text in texts:
            parts = self._segments(text or "")
            if len(parts) > 1:
                if block:
                    yield from self._block(block)
                    block, size = [], 0
                yield np.concatenate([np.array([p], dtype=self.kind) if isinstance(p, int) else self._block([p])[0] for p in parts])
                continue
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts: a piece always begins at a blank between two signs that are not white space."""
    at = 0
    while len(text) - at > 4 * BLOCK:
        cut = text.find(" ", at + BLOCK)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0][0]) < count:
        steps = np.ones((2, max(count, 2 * BLOCK)), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = MULTIPLIER, INVERSE
        up, down = np.multiply.accumulate(steps, axis=1)
        if count > 2 * BLOCK:
            return up[:count], down[:count]
        _TABLES[:] = [(up, down)]
    return _TABLES[0][0][:count], _TABLES[0][1][:count]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
