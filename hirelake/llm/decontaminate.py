"""Benchmark passages in documents, found with a generalised suffix automaton of the benchmark's words.

The automaton of all items tells, word by word, the longest passage that ends here and stands in some item. A passage of at
least ``WIDTH`` words holds a window of that many words; items of fewer words are windows as a whole.

The benchmark is cut into shards of at most ``SHARD_WORDS`` words, so an automaton has a bounded size and only a shard's
words are broadcast. With one shard, documents are read once and not shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.columns import free
from hirelake.llm.words import LETTER_WORDS, letter_words
from hirelake.session import Scratch

WIDTH = 13
SHARD_WORDS = 200_000
COVERAGE = 0.05

SPAN = "struct<start:long,end:long>"
SCHEMA = f"row long, n_words long, spans array<{SPAN}>, items array<string>"

_BUILT: dict[str, Automaton] = {}


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty passage."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[str]] = [set()]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                while len(owners) < len(self.next):
                    owners.append(set())
                owners[state].add(name)
        for name, words in items:
            if 0 < len(words) < width:
                state = 0
                for word in words:
                    state = self.next[state][self.vocabulary[word]]
                self.short.setdefault(state, []).append((len(words), name))
        self.least = min([width, *(n for own in self.short.values() for n, _ in own)])
        # From long to short: items of a passage are also items of its endings, as far as those are windows.
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.length[self.link[state]] >= width:
                owners[self.link[state]] |= owners[state]
        self.anchor, self.has_short = [0] * len(self.next), [False] * len(self.next)
        for state in order:
            above = self.link[state]
            self.anchor[state] = self.anchor[above] if self.length[above] >= width else state
            self.has_short[state] = state in self.short or self.has_short[above]
        self.owners = {a: owners[a] for a in set(self.anchor) if self.length[a] >= width}

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state of ``state``'s passage plus ``symbol``, which must be known; split off if it is too long."""
        target = self.next[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, symbol)
        return state

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered spans (merged, end not included) and the items with a window in ``words``."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        unknown = np.concatenate([[-1], np.flatnonzero(ids < 0), [len(ids)]])
        for gap in np.flatnonzero(np.diff(unknown) - 1 >= self.least):
            start, end = int(unknown[gap]) + 1, int(unknown[gap + 1])
            self._run(ids[start:end].tolist(), start, spans, items)
        return merged(spans), items

    def _run(self, ids: list[int], base: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        following, link, length, width = self.next, self.link, self.length, self.width
        state = matched = 0
        for at, symbol in enumerate(ids, base + 1):
            target = following[state].get(symbol)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(symbol)
            if target is None:
                matched = 0
                continue
            state, matched = target, matched + 1
            if matched >= width:
                spans.append((at - matched, at))
                items |= self.owners[self.anchor[state]]
            if self.has_short[state]:
                above, limit = state, matched
                while above > 0:
                    for size, name in self.short.get(above, ()):
                        if size <= limit:
                            spans.append((at - size, at))
                            items.add(name)
                    above = link[above]
                    limit = length[above]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as spans that do not touch."""
    union: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if union and start <= union[-1][1]:
            union[-1] = (union[-1][0], max(end, union[-1][1]))
        else:
            union.append((start, end))
    return union


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words; what stands between the words of a span goes with it."""
    data = text.encode()
    table = np.frombuffer(LETTER_WORDS, dtype=np.uint8)[np.frombuffer(data, dtype=np.uint8)] != 32
    edge = np.diff(table.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at:starts[first]])
        at = int(ends[last - 1])
    return b"".join([*kept, data[at:]]).decode()


def _scan(shared, number: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:
            _BUILT.clear()  # one automaton in memory at a time
            _BUILT[number] = Automaton(shared.value, width)
        automaton = _BUILT[number]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)),
                            ("items", pa.list_(pa.string()))])
        for batch in batches:
            told = []
            for row, text in zip(*batch.columns, strict=True):
                words = letter_words(text.as_py() or b"")
                spans, items = automaton.matches(words) if words else ([], set())
                told.append({"row": row.as_py(), "n_words": len(words),
                             "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(told, schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["spans"] = [{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row["spans"]])]
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _shard_rows(width: int, shard_words: int):
    """Items as pieces of bounded length: a longer item is cut, with ``width - 1`` words told twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for name, text in zip(*batch.columns, strict=True):
                words = letter_words(text.as_py() or b"")
                step = max(1, shard_words // 2)
                for at in range(0, max(1, len(words) - width + 1) if words else 0, step):
                    piece = words[at:at + step + width - 1]
                    told.append({"name": name.as_py(), "n": len(piece), "words": b" ".join(piece)})
            yield pa.RecordBatch.from_pylist(told, pa.schema([("name", pa.string()), ("n", pa.int64()),
                                                              ("words", pa.binary())]))

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """``id, n_words, spans, items``: one row per input row.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. ``spans`` are the covered stretches
    of words, ``items`` the ids (as text, sorted; a null id is ``null``) of the items with a window in the text. Null or
    empty texts have no words; items without words match nothing; without documents there are no rows. Other columns are
    not read.
    """
    named = F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name")
    pieces = scratch.table(benchmark.select(named, F.col(item_text_col).cast("binary").alias("text")).mapInArrow(
        _shard_rows(width, shard_words), "name string, n long, words binary").distinct(), "items")
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-2 * total // shard_words))
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("binary").alias("text"))
    if shards > 1:
        # Spans of several shards are put together by row, so rows get a number of their own.
        rows = scratch.table(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
    found = []
    for k in range(shards):
        own = pieces.filter(F.pmod(F.xxhash64("name", "words"), F.lit(shards)) == k) if shards > 1 else pieces
        items = [(r["name"], bytes(r["words"]).split()) for r in own.collect()]  # a bounded shard
        shared = docs.sparkSession.sparkContext.broadcast(items)
        key = "number" if shards > 1 else "row"
        scanned = rows.select(key, "text").mapInArrow(_scan(shared, uuid.uuid4().hex, width), SCHEMA)
        found.append(scratch.table(scanned, f"spans-{k}") if shards > 1 else scanned)
    if shards == 1:
        return found[0].withColumnRenamed("row", "id")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    joined = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = joined.mapInArrow(_merge, SCHEMA).withColumnRenamed("row", "number")
    return joined.join(rows.select("number", F.col("row").alias("id")), "number").select("id", "n_words", "spans", "items")


def covered(spans: str = "spans"):
    """Number of words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(coverage: float = COVERAGE):
    """Whether at least the given share of the words is covered."""
    parts = F.lit(round(1 / coverage)).cast("long")
    return (covered() > 0) & (parts * covered() >= F.col("n_words"))


def cut(automaton: Automaton, text: str, spans: list[tuple[int, int]], longest: int) -> str:
    """The text without spans of more than ``longest`` words; again while the words that now stand together make new ones."""
    while long := [(a, b) for a, b in spans if b - a > longest]:
        text = without(text, long)
        words = letter_words(text.encode())
        spans = automaton.matches(words)[0] if words else []
    return text


def _clean(shared, number: str, width: int, parts: int, longest: int | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = Automaton(shared.value, width)
        automaton = _BUILT[number]
        for batch in batches:
            kept, texts = [], []
            for text in batch.column(at).to_pylist():
                words = letter_words((text or "").encode())
                spans = automaton.matches(words)[0] if words else []
                count = sum(b - a for a, b in spans)
                kept.append(not count or parts * count < len(words))
                texts.append(cut(automaton, text, spans, longest) if spans and longest is not None else text)
            whole = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            yield whole.filter(pa.array(kept, pa.bool_()))

    return run


def _cut_rows(at: int, longest: int):
    """Cuts the spans in the last column out of the texts in column ``at``; drops that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, [(s["start"], s["end"]) for s in found if s["end"] - s["start"] > longest])
                     for t, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            whole = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            yield whole.select(range(batch.num_columns - 1))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", width: int = WIDTH, coverage: float = COVERAGE, longest: int | None = None,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without rows of which at least the share ``coverage`` of the words is covered, all columns kept.

    From the other rows, spans of more than ``longest`` words are cut out, until none is left; None leaves their texts as they
    are. Rows are judged by their texts as given, each by itself, so repeated rows are treated alike. Null and empty texts stay.
    Repeated items count once; without items or items with words all rows stay; an empty table stays empty. Other columns may
    have any names.
    """
    named = F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name")
    pieces = scratch.table(benchmark.select(named, F.col(item_text_col).cast("binary").alias("text")).mapInArrow(
        _shard_rows(width, shard_words), "name string, n long, words binary").distinct(), "items")
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = round(1 / coverage)
    if 2 * total <= shard_words:
        items = [(r["name"], bytes(r["words"]).split()) for r in pieces.collect()]  # a bounded shard
        shared = docs.sparkSession.sparkContext.broadcast(items)
        return docs.mapInArrow(_clean(shared, uuid.uuid4().hex, width, parts, longest, docs.columns.index(text_col)), docs.schema)
    number, spans = free(docs.columns, "number", "spans")
    numbered = scratch.table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    scanned, kept, made = numbered, ~contaminated(coverage), []
    while True:
        found = find_passages(scanned, benchmark, scratch, number, text_col, item_col, item_text_col, width, shard_words)
        rows = scratch.table(scanned.join(found.filter(kept).select(
            F.col("id").alias(number), F.col("spans").alias(spans)).hint("merge"), number).select(*scanned.columns, spans), "kept")
        over = F.exists(spans, lambda s: s["end"] - s["start"] > (longest if longest is not None else 1 << 62))
        made.append(rows.filter(~over).select(*docs.columns))
        left = rows.filter(over)
        if left.isEmpty():
            break
        # Only texts that were cut are searched again, for passages that came together.
        at = scanned.columns.index(text_col)
        scanned, kept = scratch.table(left.mapInArrow(_cut_rows(at, longest), scanned.schema), "cut"), F.lit(True)
    every = made[0]
    for other in made[1:]:
        every = every.unionByName(other)
    return every
