"""Near-duplicate documents by the Jaccard similarity of their word shingles: exact, without a limit on distance.

A document is its set of distinct shingles; equal sets are one node. Candidates come from two filters, and every candidate is
compared by its whole sets:

1. SimHash fingerprints of the shingles that the pigeonring filter links (``neardup.linked``) find nearly equal documents at once.
   No radius finds all pairs that are similar enough, so the rest comes from an exact filter:
2. All shingles stand in one order, common ones last. Two sets of similarity ``s`` or more share a shingle among the first
   ``n - ceil(s n) + 1`` of each (prefix filtering: Chaudhuri, Ganti and Kaushik, ICDE 2006), and the first one they share leaves
   enough shingles after it in both (position filtering: Xiao et al., WWW 2008). Prefix shingles are counted in merged count-min
   sketches first, as windows are in ``substring``; only those estimated in two sets are grouped. A sample finds the common
   shingles; it decides about speed only. Pairs that length, position or parity bits rule out are not compared.

Only links between different components are wanted, so after the first filter a group is compared with one member of another
component, and only members that are still in different components are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hirelake.llm import neardup
from hirelake.llm.substring import (
    CELLS_PER_WINDOW,
    DEPTH,
    RANGE_WINDOWS,
    _among,
    _bits_for,
    _cells,
    _deltas,
    _first_of_runs,
    _merge_sketches,
    _split,
)
from hirelake.llm.words import window_hashes, word_hashes
from hirelake.operators.components import components
from hirelake.session import Scratch, shuffles_removed

SHINGLE = 5
# Similarity as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
SEED = 42
# Documents sampled for common shingles (one in ``RARELY`` at least), rows of the sample that make a shingle common, and how
# many are told to the tasks.
SAMPLE, RARELY, COMMON, LISTED = 1 << 13, 50, 4, 1 << 17
BITS = 512
# Prefix shingles in one stored row, and members of a group that are compared with each other in one place.
CHUNK_GRAMS, GRID = 1 << 18, 512


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles, rising; a text shorter than ``shingle`` words is one shingle."""
    words = (text or b"").lower().split()
    width = min(shingle, len(words))
    starts = np.arange(len(words) - width + 1 if words else 0)
    return np.unique(window_hashes(word_hashes(words), width, SEED, starts))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.uint64) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sets(shingle: int):
    schema = pa.schema([("key", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _lists([shingles(t.as_py(), shingle) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), made.cast(schema.field(1).type)], schema=schema)

    return run


def _parities(grams: np.ndarray, bits: int = BITS) -> np.ndarray:
    """So many bits: is the number of shingles that fall on each odd? Two sets differ in no fewer shingles than bits."""
    odd = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _wide(grams: np.ndarray) -> np.ndarray:
    """As many parities as shingles, or up to twice as many: a few say little about long texts."""
    return _parities(grams, max(BITS, 1 << max(0, len(grams) - 1).bit_length()))


def _marks(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()),
                        ("bits", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            sets = [shingles(t, shingle) for t in texts]
            marks = [[xxh64_intdigest(s.tobytes(), SEED) for s in sets], [neardup.fingerprint(t, shingle) for t in texts]]
            nodes, fps = (pa.array(np.array(m, dtype=np.uint64).view(np.int64)) for m in marks)
            bits = [_lists([f(s) for s in sets]).cast(schema.field("bits").type) for f in (_parities, _wide)]
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array([len(s) for s in sets], pa.int64()), fps, *bits],
                                             schema=schema)

    return run


def _prefixes(shingle: int, similarity: tuple[int, int], common: np.ndarray, counts: np.ndarray):
    """Rows of about ``CHUNK_GRAMS`` prefix shingles. ``common`` rises; ``counts`` are the places of its shingles in the sample."""
    schema = pa.schema([("chunk", pa.int64()), ("entries", pa.int64()), ("nodes", pa.binary()), ("lengths", pa.binary()),
                        ("sizes", pa.binary()), ("grams", pa.binary())])
    part, whole = similarity

    def first(grams: np.ndarray) -> np.ndarray:
        keep = len(grams) - -(-part * len(grams) // whole) + 1 if len(grams) else 0
        if len(common):
            at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
            grams = grams[np.lexsort((grams, np.where(common[at] == grams, counts[at], 0)))]
        return grams[:keep]

    def row(number: int, nodes: list[int], lengths: list[int], kept: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(k) for k in kept], dtype=np.int64)
        return pa.RecordBatch.from_pylist([{
            "chunk": number, "entries": int(sizes.sum()), "nodes": np.array(nodes, dtype=np.int64).tobytes(),
            "lengths": np.array(lengths, dtype=np.int64).tobytes(), "sizes": sizes.tobytes(),
            "grams": np.concatenate(kept).tobytes()}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nodes, lengths, kept, total = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = shingles(text.as_py(), shingle)
                nodes.append(node)
                lengths.append(len(grams))
                kept.append(first(grams))
                total += len(kept[-1])
                if total >= CHUNK_GRAMS:
                    yield row(number, nodes, lengths, kept)
                    number, nodes, lengths, kept, total = number + 1, [], [], [], 0
        if nodes:
            yield row(number, nodes, lengths, kept)

    return run


def _sketch(bits: int, range_bits: int):
    """For each hash row the sorted cells that a chunk's shingles touch, and which of them twice."""
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, out = np.frombuffer(row["grams"], dtype=np.uint64), []
                for depth in range(DEPTH):
                    cells = np.sort(_cells(grams, depth, bits))
                    first = _first_of_runs(cells)
                    twice, distinct = np.diff(first, append=len(cells)) > 1, cells[first]
                    for top, a, b in _split(distinct, range_bits, bits):
                        out.append({"part": depth << 40 | top, "chunk": row["chunk"], "cells": _deltas(distinct[a:b]),
                                    "twice": np.packbits(twice[a:b]).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _repeated(bits: int, range_bits: int):
    """The entries of a chunk whose shingles the merged sketches estimate in two sets."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made, by_part = [], dict(zip(right["part"], right["answer"], strict=True))
        for row in left.itertuples():
            grams = np.frombuffer(row.grams, dtype=np.uint64)
            at = np.arange(len(grams))
            for depth in range(DEPTH):
                cells = _cells(grams, depth, bits)
                distinct = np.sort(cells)
                distinct = distinct[_first_of_runs(distinct)]
                twice = np.concatenate([np.zeros(0, dtype=bool)] + [
                    np.unpackbits(np.frombuffer(by_part[depth << 40 | top], dtype=np.uint8), count=b - a).astype(bool)
                    for top, a, b in _split(distinct, range_bits, bits)])
                at = at[_among(cells[at], distinct[twice])]
            sizes = np.frombuffer(row.sizes, dtype=np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)[at]
            place = at - (np.cumsum(sizes) - sizes)[owner]
            made.append(pd.DataFrame({
                "gram": grams[at].view(np.int64), "node": np.frombuffer(row.nodes, dtype=np.int64)[owner],
                "n": np.frombuffer(row.lengths, dtype=np.int64)[owner], "place": place}))
        return pd.concat(made) if made else pd.DataFrame({"gram": [], "node": [], "n": [], "place": []}, dtype=np.int64)

    return run


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, rising, and their counts."""
    every = max(1, min(rows.count() // SAMPLE, RARELY))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(_sets(shingle), "key long, grams array<long>")
    counted = sample.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = counted.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(LISTED).collect()
    grams = np.array([r["gram"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r["n"] for r in found], dtype=np.int64)[order]


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, grid: int = GRID) -> DataFrame:
    """``id, component``: one row per input row, read lazily from ``scratch``; ``component`` is the smallest id that links of
    ``similarity`` or more can reach.

    Ids are distinct whole numbers, not null: number rows whose own ids repeat or are missing. Texts are lower-cased (A-Z) and
    split at blanks; a text shorter than ``shingle`` words is one shingle; texts without a word, null ones among them, are alike.
    Repeated texts are one node, however many there are. A text of any length is one row. An empty table gives no rows; other
    columns are not read and may have any names. Keep ``docs`` in buckets of the id, so that the texts that are compared need not
    be moved. Shingles are compared as 64-bit hashes.
    """
    with shuffles_removed(docs.sparkSession):
        return _near_duplicates(docs, scratch, id_col, text_col, shingle, similarity, grid)


def _members(texts: DataFrame, nodes: DataFrame, scratch: Scratch, shingle: int, similarity: tuple[int, int],
             common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``gram, node, n, place``: all places of prefix shingles that two nodes have. What it needs on the way is removed."""
    own = Scratch(texts.sparkSession, "prefixes")
    first = texts.join(nodes.select("id", "node").hint("merge"), "id").select("node", "text")
    total = nodes.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (8 * CHUNK_GRAMS)))
    chunks = own.bucketed(first.mapInArrow(_prefixes(shingle, similarity, *common), (
        "chunk long, entries long, nodes binary, lengths binary, sizes binary, grams binary")), "prefixes", buckets, "chunk")
    entries = chunks.agg(F.sum("entries").alias("n")).first()["n"] or 0
    bits = max(16, _bits_for(entries * CELLS_PER_WINDOW))
    range_bits = min(bits - 10, _bits_for(-(-entries // RANGE_WINDOWS)))
    sketches = chunks.select("chunk", "grams").mapInArrow(
        _sketch(bits, range_bits), "part long, chunk long, cells binary, twice binary")
    repeated = own.table(sketches.groupBy("part").applyInPandas(
        _merge_sketches(bits, range_bits), "kind int, part long, chunk long, answer binary"), "repeated")
    found = own.table(chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(
        _repeated(bits, range_bits), "gram long, node long, n long, place long"), "entries")
    shared = found.groupBy("gram").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    made = scratch.table(found.join(shared.select("gram").hint("merge"), "gram"), "members")
    own.drop()
    return made


def _near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int,
                     similarity: tuple[int, int], grid: int) -> DataFrame:
    part, whole = similarity
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    marks = scratch.table(texts.mapInArrow(_marks(shingle), (
        "id long, node long, n long, fp long, bits array<long>, wide array<long>")), "marks")
    others = [F.any_value(c).alias(c) for c in ("n", "fp", "bits", "wide")]
    nodes = scratch.table(marks.groupBy("node").agg(F.min("id").alias("id"), *others), "nodes")

    def able(a: str, b: str) -> Column:
        """Whether lengths and parities let two sets be similar."""
        n = [F.col(f"n{a}"), F.col(f"n{b}")]
        apart = sum((F.bit_count(F.get(f"bits{a}", F.lit(k)).bitwiseXOR(F.get(f"bits{b}", F.lit(k)))) for k in range(BITS // 64)),
                    F.lit(0))
        return (F.least(*n) * whole >= F.greatest(*n) * part) & (apart * (part + whole) <= (n[0] + n[1]) * (whole - part))

    def able_by_all() -> Column:
        """The same by the wide parities. Of two numbers of bits, powers of two, the larger is folded to the smaller."""
        least = F.least(F.size("wide_a"), F.size("wide_b"))

        def folded(c: str) -> Column:
            halves = F.zip_with(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least), lambda x, y: x.bitwiseXOR(y))
            return F.when(F.size(c) == least, F.col(c)).otherwise(halves)

        apart = F.aggregate(F.zip_with(folded("wide_a"), folded("wide_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                            lambda total, x: total + x)
        return able("_a", "_b") & (apart * (part + whole) <= (F.col("n_a") + F.col("n_b")) * (whole - part))

    def reach(n: str, place: str) -> Column:
        """The largest other set with which a set can have enough in common from this place on."""
        return (F.col(n) - F.col(place)) * (part + whole) - F.col(n) * part

    def meets(a: str, b: str) -> Column:
        return (F.col(f"n{b}") * part <= reach(f"n{a}", f"place{a}")) & (F.col(f"n{a}") * part <= reach(f"n{b}", f"place{b}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are similar. Only those that can be, by length and parities, are compared."""
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}")
                                                                        for c in ("id", "n", "bits", "wide")]).hint("merge"), side)
        total = F.col("n_a") + F.col("n_b")
        own = Scratch(docs.sparkSession, "compared")
        pairs = own.table(pairs.filter(able_by_all()).drop("bits_a", "bits_b", "wide_a", "wide_b"), "pairs")
        ends = own.table(pairs.select(F.inline(F.array(*[F.struct(F.col(f"id_{s}").alias("id"), F.col(s).alias("node"))
                                                         for s in "ab"]))).distinct(), "ends")
        sets = own.table(texts.join(ends.hint("merge"), "id").select("node", "text").mapInArrow(
            _sets(shingle), "key long, grams array<long>"), "sets")
        for side in ("b", "a"):
            pairs = pairs.join(sets.withColumnsRenamed({"key": side, "grams": f"grams_{side}"}).hint("merge"), side)
        same = F.size(F.array_intersect("grams_a", "grams_b"))
        made = scratch.table(pairs.filter(same * (part + whole) >= total * part).select("a", "b"), "links")
        own.drop()
        return made

    def by_fingerprint() -> DataFrame:
        own = Scratch(docs.sparkSession, "fingerprints")
        first = own.table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
        equal = nodes.join(first.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).filter("a <> b")
        edges = neardup.linked(first.select("fp"), own)
        for side in ("a", "b"):
            named = first.select(F.col("fp").alias(side), F.col("first").alias(f"node_{side}")).hint("merge")
            edges = edges.join(named, side)
        near = edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        made = verified(equal.unionByName(near).distinct())
        own.drop()
        return made

    links = by_fingerprint()
    members = _members(texts, nodes, scratch, shingle, similarity, _common(texts, shingle))
    for last in (False, True):
        own = Scratch(docs.sparkSession, "round")
        roots = own.table(components(links, own), "roots")
        told = own.table(members.join(roots.hint("merge"), members["node"] == roots["node"], "left").select(
            "gram", members["node"], "n", "place", F.coalesce("root", members["node"]).alias("root")), "told")
        mixed = told.groupBy("gram").agg(F.min("root").alias("low"), F.count(F.lit(1)).alias("size"),
                                         F.max(F.struct("root", "node", "n", "place")).alias("high"))
        mixed = own.table(mixed.filter("low < high.root").select(
            "gram", F.ceil(F.col("size") / grid).alias("blocks"), F.col("high.root").alias("root_b"),
            F.col("high.node").alias("node_b"), F.col("high.n").alias("n_b"), F.col("high.place").alias("place_b")), "mixed")
        if not last:
            pairs = told.join(mixed.hint("merge"), "gram").filter((F.col("root") != F.col("root_b")) & meets("", "_b"))
        else:
            # One set of a pair has its place in the first ninth (for similarity 0.8): where neither has, both would have to be
            # smaller than the other. Groups are dealt over a square of blocks.
            left = told.join(mixed.select("gram", "blocks").hint("merge"), "gram").join(
                nodes.select("node", "bits").hint("merge"), "node")
            block, blocks = F.pmod(F.xxhash64("node"), F.col("blocks")), F.sequence(F.lit(0), F.col("blocks") - 1)
            early = reach("n", "place") >= F.col("n") * part
            one = left.withColumn("early", early)
            other = one.select("gram", block.alias("column"), F.explode(blocks).alias("row"),
                               *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "root", "early", "bits")])
            one = one.filter("early").select("gram", block.alias("row"), F.explode(blocks).alias("column"), "node", "n", "place",
                                             "root", "bits")
            once = ~F.col("early_b") | (F.col("node") < F.col("node_b"))
            # Few pairs pass all filters, and only those are moved.
            pairs = one.join(other, ["gram", "row", "column"]).filter(
                once & (F.col("root") != F.col("root_b")) & meets("", "_b") & able("", "_b"))
        links = scratch.table(links.unionByName(verified(pairs.select(
            F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())), "links")
        own.drop()
    roots = scratch.table(components(links, scratch), "roots")
    rooted = scratch.table(nodes.select("node", "id").join(roots.hint("merge"), "node", "left").select(
        "node", "id", F.coalesce("root", "node").alias("root")), "rooted")
    smallest = scratch.table(rooted.groupBy("root").agg(F.min("id").alias("component")), "smallest")
    named = scratch.table(rooted.join(smallest.hint("merge"), "root").select("node", "component"), "named")
    return marks.select("id", "node").join(named.hint("merge"), "node").select("id", "component")
