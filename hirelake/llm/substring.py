"""Removal of passages that repeat an earlier document, word by word.

A window is ``width`` consecutive words of one document. Each word covered by a window whose word sequence also starts in
a document with a smaller id is removed. Three passes over a table of text chunks:

1. Every chunk sketches its windows: for each of ``DEPTH`` hash rows the sorted cells it touches. The sketches of all
   chunks are merged cell range by cell range, so no task and no broadcast holds a whole row, and each chunk gets back one
   bit per cell it touched: does the merged count reach two? The estimate of a window is the least of its rows, which is
   never below the true count (count-min), so no repeated window is lost.
2. Only windows estimated repeated are grouped exactly: each chunk sends one entry per distinct window with the smallest
   document id it has for it (so that a passage in a third of all documents is one entry per chunk) and gets back one bit
   per entry: does another chunk have a smaller id?
3. Words are removed.

Chunks are written once, in buckets, so that the texts are not shuffled: only sketches, entries and bits are. The sketch
grows with the number of windows (``CELLS_PER_WINDOW``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hirelake.llm.columns import free
from hirelake.llm.words import mix, window_hashes, word_hashes
from hirelake.session import Scratch

WIDTH = 13
DEPTH = 2
CELLS_PER_WINDOW = 8
CHUNK_BYTES = 6 << 20
# Windows whose sketch cells, or entries, meet in one task.
RANGE_WINDOWS = 2_000_000
# Stands for a null id: such a document comes after all others.
NO_ID = np.iinfo(np.int64).max

CHUNK_SCHEMA = "chunk long, docs int, windows long, ids binary, sizes binary, body binary, rest binary"


def _packed(values: np.ndarray) -> bytes:
    """Bytes of the same rank side by side, compressed: small differences cost about their own size."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def _deltas(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=values.dtype.type(0)))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _to_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunk_row(number: int, ids: list, texts: list[bytes], rest: list[pa.RecordBatch], width: int) -> dict:
    lengths = [len(t.split()) for t in texts]
    return {
        "chunk": number, "docs": len(ids), "windows": sum(max(0, n - width + 1) for n in lengths),
        "ids": np.array([NO_ID if i is None else i for i in ids], dtype=np.int64).tobytes(),
        "sizes": np.array([len(t) for t in texts], dtype=np.int64).tobytes(),
        "body": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
        "rest": _to_bytes(rest),
    }


def _make_chunks(width: int, chunk_bytes: int):
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.int32()), ("windows", pa.int64()), ("ids", pa.binary()),
                        ("sizes", pa.binary()), ("body", pa.binary()), ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, texts, rest = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            others = batch.select(range(2, batch.num_columns))
            cut = 0
            for at, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                text = text.as_py() or b""
                ids.append(i)
                texts.append(text)
                size += len(text) + 16
                if size >= chunk_bytes:
                    rest.append(others.slice(cut, at - cut))
                    yield pa.RecordBatch.from_pylist([_chunk_row(number, ids, texts, rest, width)], schema)
                    number, size, ids, texts, rest, cut = number + 1, 0, [], [], [], at
            if cut < batch.num_rows:
                rest.append(others.slice(cut))
        if ids:
            yield pa.RecordBatch.from_pylist([_chunk_row(number, ids, texts, rest, width)], schema)

    return run


class _Windows:
    """The words and windows of one chunk."""

    def __init__(self, row, width: int):
        body = zstandard.ZstdDecompressor().decompress(row.body)
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        ends = np.cumsum(np.frombuffer(row.sizes, dtype=np.int64)).tolist()
        self.texts = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.words = [t.split() for t in self.texts]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.width = width
        hashes = word_hashes(list(itertools.chain.from_iterable(self.words)))
        # A window is inside one document if it starts at least ``width`` words before the document's end.
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(hashes))
        self.starts = np.flatnonzero(left >= width)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)[self.starts]
        self.hashes = hashes

    def keys(self, seed: int, chosen: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all windows, or of the chosen ones."""
        return window_hashes(self.hashes, self.width, seed, self.starts if chosen is None else self.starts[chosen])


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys, 7 + row) >> np.uint64(64 - bits)


def _split(values: np.ndarray, range_bits: int, bits: int) -> list[tuple[int, int, int]]:
    """``(range, from, to)`` of sorted values of ``bits`` bits, by their top ``range_bits`` bits; none is empty."""
    if not len(values):
        return []
    tops = (values >> np.uint64(bits - range_bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(tops)) + 1).tolist(), len(values)]
    return [(int(tops[a]), a, b) for a, b in itertools.pairwise(cuts)]


def _sketch(width: int, bits: int, range_bits: int):
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                keys = _Windows(row, width).keys(1)
                out = []
                for depth in range(DEPTH):
                    cells = np.sort(_cells(keys, depth, bits))
                    first = _first_of_runs(cells)
                    twice = np.diff(first, append=len(cells)) > 1
                    distinct = cells[first]
                    for top, a, b in _split(distinct, range_bits, bits):
                        out.append({"part": depth << 40 | top, "chunk": row.chunk, "cells": _deltas(distinct[a:b]),
                                    "twice": np.packbits(twice[a:b]).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _merge_sketches(bits: int, range_bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = 1 << (bits - range_bits)
        base = np.uint64((int(group["part"].iloc[0]) & ((1 << 40) - 1)) * size)
        once, twice = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for cells, flags in zip(group["cells"], group["twice"], strict=True):
            at = (_sums(cells) - base).astype(np.int64)
            twice[at] |= once[at] | np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=len(at)).astype(bool)
            once[at] = True
        answers = [np.packbits(twice[(_sums(c) - base).astype(np.int64)]).tobytes() for c in group["cells"]]
        return pd.DataFrame({"kind": 0, "part": group["part"], "chunk": group["chunk"], "answer": answers})

    return run


def _first_of_runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones. Looked up in order, which spares the caches."""
    order = np.argsort(values)
    at = np.searchsorted(ordered, values[order])
    found = np.empty(len(values), dtype=bool)
    found[order] = (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values[order]) if len(ordered) else False
    return found


class _Candidates:
    """Windows of one chunk that the merged sketch estimates as repeated, by exact key."""

    def __init__(self, windows: _Windows, answers: pd.DataFrame, bits: int, range_bits: int):
        keys = windows.keys(1)
        by_part = dict(zip(answers["part"], answers["answer"], strict=True))
        self.at = np.arange(len(keys))
        for depth in range(DEPTH):  # only windows that are left are looked up in the next row
            cells = _cells(keys, depth, bits)
            distinct = np.sort(cells)
            distinct = distinct[_first_of_runs(distinct)]
            repeated = np.concatenate([np.zeros(0, dtype=bool)] + [
                np.unpackbits(np.frombuffer(by_part[depth << 40 | top], dtype=np.uint8), count=b - a).astype(bool)
                for top, a, b in _split(distinct, range_bits, bits)
            ])
            self.at = self.at[_among(cells[self.at], distinct[repeated])]
        first, second = keys[self.at], windows.keys(2, self.at)
        ids = windows.ids[windows.doc[self.at]]
        order = np.lexsort((ids, second, first))
        first, second, ids = first[order], second[order], ids[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.order, self.ids = order, ids
        self.entry = np.cumsum(new) - 1
        self.first, self.second, self.least = first[new], second[new], ids[new]


def _answers_of(right: pd.DataFrame, kind: int) -> pd.DataFrame:
    return right[right["kind"] == kind]


def _entries(width: int, bits: int, range_bits: int, entry_bits: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            found = _Candidates(_Windows(row, width), _answers_of(right, 0), bits, range_bits)
            for top, a, b in _split(found.first, entry_bits, 64):
                out.append((top, row.chunk, _deltas(found.first[a:b]), _packed(found.second[a:b]),
                            _packed(found.least[a:b])))
        return pd.DataFrame(out, columns=["part", "chunk", "firsts", "seconds", "least"])

    return run


def _merge_entries(group: pd.DataFrame) -> pd.DataFrame:
    firsts = [_sums(x) for x in group["firsts"]]
    cuts = np.cumsum([len(x) for x in firsts])[:-1]
    first = np.concatenate(firsts)
    second = np.concatenate([_unpacked(x, np.uint64) for x in group["seconds"]])
    least = np.concatenate([_unpacked(x, np.int64) for x in group["least"]])
    order = np.lexsort((least, second, first))
    first, second = first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    smallest = least[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(order), dtype=bool)
    smaller[order] = least[order] > smallest
    answers = [np.packbits(x).tobytes() for x in np.split(smaller, cuts)]
    return pd.DataFrame({"kind": 1, "part": group["part"], "chunk": group["chunk"], "answer": answers})


def _removed(windows: _Windows, answers: pd.DataFrame, bits: int, range_bits: int, entry_bits: int) -> np.ndarray:
    """Which words of the chunk go."""
    found = _Candidates(windows, _answers_of(answers, 0), bits, range_bits)
    own = _answers_of(answers, 1)
    by_part = dict(zip(own["part"], own["answer"], strict=True))
    elsewhere = np.concatenate([np.zeros(0, dtype=bool)] + [
        np.unpackbits(np.frombuffer(by_part[top], dtype=np.uint8), count=b - a).astype(bool)
        for top, a, b in _split(found.first, entry_bits, 64)
    ])
    repeated = elsewhere[found.entry] | (found.ids > found.least[found.entry])
    starts = windows.starts[found.at[found.order[repeated]]]
    change = np.zeros(len(windows.hashes) + 1, dtype=np.int64)
    change[starts] += 1  # each start occurs once
    np.subtract.at(change, starts + windows.width, 1)
    return np.cumsum(change[:-1]) > 0


def _keep(width: int, bits: int, range_bits: int, entry_bits: int, names: tuple[str, str, str], as_is: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, made = right.to_pandas(), []
        for row in left.to_pandas().itertuples():
            windows = _Windows(row, width)
            gone = _removed(windows, answers, bits, range_bits, entry_bits)
            at, counts, texts = 0, [], []
            for text, words in zip(windows.texts, windows.words, strict=True):
                own = gone[at:at + len(words)]
                at += len(words)
                counts.append(int(own.sum()))
                if as_is and not counts[-1]:
                    texts.append(text)
                else:
                    texts.append(b" ".join(itertools.compress(words, (~own).tolist())))
            with pa.ipc.open_stream(row.rest) as reader:
                rest = reader.read_all()
            for name, column in zip(names, (pa.array(windows.counts), pa.array(counts, pa.int64()),
                                            pa.array(texts, pa.binary()).cast(pa.string())), strict=True):
                rest = rest.append_column(name, column)
            made.append(rest)
        return pa.concat_tables(made) if made else None

    return run


def _bits_for(count: int) -> int:
    return max(0, int(count - 1).bit_length())


def keep_first_passages(docs: DataFrame, scratch: Scratch, keep: list[str], id_col: str = "doc_id",
                        text_col: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES,
                        range_windows: int = RANGE_WINDOWS, names: tuple[str, str, str] = ("n_words", "n_removed", "kept"),
                        as_is: bool = False) -> DataFrame:
    """The columns ``keep``, then ``n_words, n_removed, kept`` (or other ``names``): one row per input row, read lazily from
    ``scratch``.

    ``kept`` holds the kept words joined by one space; with ``as_is``, texts that lose nothing stay as they are. Words are
    runs of bytes other than space and ``\\t\\n\\v\\f\\r``. A null text has no words; a text of fewer than ``width`` words
    has no window and stays. Rows with equal ids do not remove words from each other. A null id counts as larger than all
    others. An empty table gives no rows; other columns are not read. Windows are compared by two 64-bit hashes.
    """
    own_id, own_text = free(docs.columns, "id", "text")
    rows = docs.select(F.col(id_col).cast("long").alias(own_id), F.col(text_col).cast("binary").alias(own_text), *keep)
    chunks = rows.mapInArrow(_make_chunks(width, chunk_bytes), CHUNK_SCHEMA)
    size = docs.agg(F.sum(F.octet_length(text_col) + 16).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // chunk_bytes))
    stored = scratch.bucketed(chunks, "chunks", buckets, "chunk")
    windows = stored.agg(F.sum("windows").alias("n")).first()["n"] or 0
    bits = max(16, _bits_for(windows * CELLS_PER_WINDOW))
    range_bits = min(bits - 10, _bits_for(-(-windows // range_windows)))
    entry_bits = range_bits
    texts = stored.drop("rest")
    sketches = texts.mapInArrow(_sketch(width, bits, range_bits), "part long, chunk long, cells binary, twice binary")
    answer = "kind int, part long, chunk long, answer binary"
    repeated = scratch.table(
        sketches.groupBy("part").applyInPandas(_merge_sketches(bits, range_bits), answer), "repeated")
    entries = (
        texts.groupBy("chunk").cogroup(repeated.groupBy("chunk"))
        .applyInPandas(_entries(width, bits, range_bits, entry_bits),
                       "part long, chunk long, firsts binary, seconds binary, least binary")
    )
    smaller = scratch.table(entries.groupBy("part").applyInPandas(_merge_entries, answer), "smaller")
    answers = repeated.unionByName(smaller)
    kinds = zip(names, (LongType(), LongType(), StringType()), strict=True)
    result = StructType([docs.schema[c] for c in keep] + [StructField(n, k) for n, k in kinds])
    return (
        stored.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInArrow(_keep(width, bits, range_bits, entry_bits, names, as_is), result)
    )
