"""SimHash fingerprints of documents, and search within a Hamming radius by permuted block tables.

Only DataFrame functions. The terms of a text are its pairs of neighbouring words and its last word; a term votes on each
of 64 signed bits with its weight times the number of its places. Votes of two bits share one number (``h >> j`` masked to
bit 0 and bit 32), so a text needs 32 sums, which Spark adds up map-side: one row per text leaves a task.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.ranking import number_rows
from hirelake.session import Scratch

BITS = 64
BLANKS = " \t\n\x0b\x0c\r"
# Term weights by length in bytes: longer terms say more. The largest, times the terms of a text, must fit 32 bits.
WEIGHT_STEPS = (8, 12, 16)
RADIUS = 3
BLOCKS = 6


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(BLANKS)), "[ \\t-\\r]+")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fp`` (signed 64-bit number), one row per distinct ``keys``; a text without a term has 0.

    Rows with equal ``keys`` must have equal texts.
    """
    words = texts.select(*keys, _words(F.col(text_col)).alias("__w"))
    pairs = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.greatest(F.size("__w"), F.lit(1))).alias("b"))
    terms = words.select(*keys, F.explode_outer(pairs).alias("__t"))
    length = F.octet_length("__t.a") + F.coalesce(F.octet_length("__t.b"), F.lit(0))
    weight = sum((F.when(length >= s, 1).otherwise(0) for s in WEIGHT_STEPS), F.lit(1)).cast("long")
    empty = F.coalesce(length, F.lit(0)) == 0
    hashed = terms.select(*keys, F.xxhash64("__t.a", "__t.b").alias("__h"), F.when(empty, 0).otherwise(weight).alias("__x"))
    mask = F.lit((1 << 32) + 1).cast("long")
    votes = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(mask) * F.col("__x")).alias(f"__v{j}") for j in range(32)]
    sums = hashed.groupBy(*keys).agg(F.sum("__x").alias("__n"), *votes)
    low = F.lit((1 << 32) - 1).cast("long")
    bits = []
    for j in range(32):
        both = F.col(f"__v{j}")
        for bit, count in ((j, both.bitwiseAND(low)), (j + 32, F.shiftrightunsigned(both, 32))):
            bits.append(F.when(count * 2 > F.col("__n"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long"))
                        .otherwise(F.lit(0).cast("long")))
    # A sum of different powers of two has no carries; folded as a tree to keep the expression shallow.
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return sums.select(*keys, bits[0].alias("fp"))


def likeness(a: str, b: str) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def edited(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, id, copies, n_chars, text, edited, next_key``: each text, and the text with its last third replaced.

    The last ``floor(n_chars / 3)`` code points give way to the first as many (or all) of the next document in order of
    descending ids; after the last comes the first. A null text is empty. Null ids come last; equal ids stand in order
    of a hash of their texts. Rows with equal ids and texts are one document, told once with their number in ``copies``.
    An empty table gives no rows; other columns are not read. The texts are shuffled once, and the replacing thirds once.
    """
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.col("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.unhex(F.md5(named)).alias("key"), "id", "text")
    marks = rows.groupBy("key").agg(F.min("id").alias("id"), F.max(F.length("text")).cast("long").alias("n_chars"),
                                    F.count(F.lit(1)).alias("copies"))
    # Ascending numbers, so the next document has the next smaller one.
    placed = scratch.table(number_rows(marks, ["id", "key"], "place", scratch), "placed")
    found = placed.agg(F.max("place").alias("n"), F.max("copies").alias("copies")).first()
    last = F.lit(found["n"] or 0)
    before = placed.select(F.when(F.col("place") == 1, last).otherwise(F.col("place") - 1).alias("place"),
                           F.col("key").alias("before_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    # Of each document: what the document before it wants of its text.
    links = scratch.table(placed.join(before, "place").drop("place"), "links")
    if (found["copies"] or 0) > 1:
        rows = rows.dropDuplicates(["key"])
    joined = rows.select("key", "text").join(links, "key")
    wanted = joined.select(F.col("before_key").alias("key"), F.col("key").alias("next_key"),
                           F.substring("text", F.lit(1), F.col("take")).alias("lead"))
    cut = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    return joined.select("key", "id", "copies", "n_chars", "text").join(wanted, "key").select(
        "key", "id", "copies", "n_chars", "text", F.concat(F.substring("text", F.lit(1), cut), "lead").alias("edited"),
        "next_key")


def _tables(radius: int, blocks: int) -> list[int]:
    """Bit masks of the tables: every choice of ``blocks - radius`` of the blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def within_radius(queries: DataFrame, marks: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query, fp`` for all pairs of a fingerprint of ``queries`` (column ``fp``) and one of ``marks`` (column ``fp``, other
    columns are kept) that differ in at most ``radius`` bits.

    Fingerprints are cut into ``blocks`` blocks. Pairs within the radius agree in at least ``blocks - radius`` of them, so
    there is a table for each choice of that many blocks, keyed by their bits; the same pair is told by the first table
    in which it meets. Pass distinct fingerprints: both sides are exploded by the number of tables.
    """
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in _tables(radius, blocks)]
    if len(masks) != comb(blocks, radius):
        raise ValueError("radius must be below blocks")
    listed = F.array(*[F.lit(m).cast("long") for m in masks])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tables = F.posexplode(F.transform(listed, lambda m: F.col(name).bitwiseAND(m))).alias("__table", "__key")
        return df.select("*", tables)

    left = keyed(queries.select(F.col("fp").alias("query")).distinct(), "query")
    right = keyed(marks, "fp").withColumnsRenamed({"__table": "__t", "__key": "__k"})
    difference = F.col("query").bitwiseXOR(F.col("fp"))
    earlier = F.exists(F.slice(listed, F.lit(1), F.col("__t")), lambda m: difference.bitwiseAND(m) == 0)
    near = (F.bit_count(difference) <= radius) & ~earlier
    same = (F.col("__table") == F.col("__t")) & (F.col("__key") == F.col("__k"))
    return left.join(right, same & near).drop("__table", "__key", "__t", "__k")
