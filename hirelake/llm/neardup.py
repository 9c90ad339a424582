"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

Two 64-bit fingerprints at distance at most ``radius`` are split into a ring of ``segments`` equal parts. By the
pigeonring principle (Qin and Xiao, VLDB 2018) some start exists from which every chain of ``l`` consecutive segments has
at most ``l * radius / segments`` differing bits. With 8 segments and radius 2 the first three segments are equal (the
join key, 24 bits), the next ones may differ in one bit in all, and only pairs that pass every chain are compared in full.

Equal fingerprints are one node, so copies cost nothing. A bucket of the join key with more than ``BUCKET`` different
fingerprints is not compared pair by pair: its members are listed under all fingerprints at distance one. Two fingerprints
within distance 2 share such a neighbour, and all members listed under one neighbour (65 at most) are within distance 2 of
each other. That way is as exact, and linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hirelake.operators.components import components
from hirelake.session import Scratch

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
SEGMENTS = 8
BUCKET = 64
# Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the hashes of all shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1:]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], schema=schema)

    return run


def _chains(difference: np.ndarray, start: np.ndarray, segments: int, radius: int) -> np.ndarray:
    """Whether every chain from ``start`` stays within its budget; the last chain is the whole fingerprint."""
    width = np.uint64(BITS // segments)
    mask = np.uint64((1 << int(width)) - 1)
    total = np.zeros(len(difference), dtype=np.int64)
    good = np.ones(len(difference), dtype=bool)
    for length in range(1, segments + 1):
        at = (start + length - 1) % segments
        total += np.bitwise_count(difference >> (at.astype(np.uint64) * width) & mask)
        good &= total * segments <= length * radius
    return good


def _first_start(difference: np.ndarray, segments: int, radius: int, exact: int) -> np.ndarray:
    """The first start whose ``exact`` segments are equal, so that each pair is told once."""
    first = np.full(len(difference), segments, dtype=np.int64)
    for start in reversed(range(segments)):
        equal = np.ones(len(difference), dtype=bool)
        for k in range(exact):
            shift = np.uint64((start + k) % segments * (BITS // segments))
            equal &= (difference >> shift & np.uint64((1 << BITS // segments) - 1)) == 0
        first[equal & _chains(difference, np.full(len(difference), start), segments, radius)] = start
    return first


def _pairs(segments: int, radius: int, exact: int):
    """Linked pairs inside small buckets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(0).to_numpy()
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            marks = lists.values.to_numpy().view(np.uint64)
            sizes = np.diff(offsets)
            for size in np.unique(sizes):
                left, right = np.triu_indices(size, 1)
                own = np.flatnonzero(sizes == size)
                step = max(1, (1 << 20) // max(1, len(left)))
                for at in range(0, len(own), step):
                    base = offsets[:-1][own[at:at + step]][:, None]
                    a, b = marks[(base + left).ravel()], marks[(base + right).ravel()]
                    start = np.repeat(starts[own[at:at + step]], len(left)).astype(np.int64)
                    near = np.flatnonzero(_chains(a ^ b, start, segments, radius))
                    near = near[_first_start(a[near] ^ b[near], segments, radius, exact) == start[near]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[near].view(np.int64)), pa.array(b[near].view(np.int64))], schema=schema)

    return run


def linked(marks: DataFrame, scratch: Scratch, radius: int = RADIUS, segments: int = SEGMENTS,
           bucket: int = BUCKET) -> DataFrame:
    """``a, b``: edges between different fingerprints (column ``fp``, distinct) that connect the same fingerprints as
    all pairs within ``radius`` do. ``radius`` is at most 2 (a neighbour at distance one must lie between)."""
    if radius > 2:
        raise ValueError("radius above 2")
    width = BITS // segments
    exact = max(1, (segments - 1) // radius if radius else segments - 1)  # segments with a budget below one bit
    fp = F.col("fp")
    ring = [F.shiftleft(fp, BITS - width * s).bitwiseOR(F.shiftrightunsigned(fp, width * s)) if s else fp
            for s in range(segments)]
    mask = (1 << width * exact) - 1 if width * exact < BITS else -1
    keys = marks.select("fp", F.posexplode(F.array(*[r.bitwiseAND(F.lit(mask)) for r in ring])).alias("start", "key"))
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.table(keys.join(scratch.table(sizes, "sizes"), ["start", "key"]), "members")
    small = members.filter(F.col("size") <= bucket).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select(F.col("start").cast("long"), "fps").mapInArrow(_pairs(segments, radius, exact),
                                                                      "a long, b long")
    large = members.filter(F.col("size") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
                                             for i in range(BITS)])
    if radius == 2:
        around = large.select("fp", F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("at"))
        groups = around.groupBy("at").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:  # within distance one: a fingerprint and its flips that exist
        around = large.select("fp", F.explode(flips).alias("flip")).select(
            fp.alias("a"), fp.bitwiseXOR(F.col("flip")).alias("fp"))
        stars = around.join(large, "fp").select("a", F.col("fp").alias("b")).filter(
            F.lit(radius > 0) | (F.col("a") == F.col("b")))
    return pairs.unionByName(stars.filter("a <> b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS,
                    bucket: int = BUCKET) -> DataFrame:
    """``id, fp, component``: one row per input row, read lazily from ``scratch``; ``fp`` is a signed 64-bit number,
    ``component`` the smallest id that links within ``radius`` can reach.

    Texts are lower-cased (A-Z) and split at blanks; shorter texts than ``shingle`` words are one shingle. Texts that are
    null or have no word have fingerprint zero and link like any other. Rows with equal ids are told apart only by
    their texts. A null id is never a component's id unless no other is there (then null). An empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    marks = scratch.table(rows.mapInArrow(_fingerprints(shingle), "id long, fp long"), "marks")
    nodes = scratch.table(marks.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    edges = linked(nodes.select("fp"), scratch, radius, segments, bucket)
    roots = components(edges, scratch).withColumnsRenamed({"node": "fp"})
    # Components by root: a root itself is not listed as a node.
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    smallest = scratch.table(rooted.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = scratch.table(rooted.join(smallest, "root").select("fp", "component"), "named")
    return marks.join(named, "fp").select("id", "fp", "component")
