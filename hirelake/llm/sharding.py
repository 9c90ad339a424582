"""Documents in shards of equal row counts, linked documents together as far as they fit: balanced label propagation.

Documents are linked when their keys are equal (by default: equal texts). Every document begins in a shard by the hash of its
id. In each round, documents move to the shard that holds most of their neighbours (Ugander and Backstrom, WSDM 2013): the
moves wanted from shard a to shard b are granted as far as the same number moves back, and beyond that as far as b has room.
Documents without links have no wish; they fill what is left, so every shard ends with its exact number of rows.

Linked documents of one key are alike, so the state is a table of cells ``key, shard, n``, at most one per shard and key,
however many copies a text has. Only at the end are single documents dealt to cells, by ranks that are counted in buckets of
about ``TASK_ROWS`` rows, so no shard and no key is ranked in one task. What reaches the driver is a matrix of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.session import Scratch

SHARDS = 16
TASK_ROWS = 100_000
ROUNDS = 12
# The shard of documents that found no room yet.
NOWHERE = -1


def ranked(df: DataFrame, groups: list[str], spread: Column, buckets: Column, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``groups``. Rows are dealt over ``buckets`` by the hash ``spread`` and numbered there;
    each bucket's numbers start behind those of the buckets before it."""
    dealt = df.withColumn("__bucket", F.pmod(spread, buckets))
    within = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order)) - 1)
    counts = dealt.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return within.join(starts, [*groups, "__bucket"]).withColumn(name, F.col("__start") + F.col("__rank")).drop(
        "__bucket", "__rank", "__start")


def _pick(values: list[int], index: Column) -> Column:
    """An entry of a short list of numbers, by an index from 0."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = dict(map(tuple, cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()))
    return [found.get(s, 0) for s in range(shards)]


def _granted(moves: DataFrame, quota: dict[tuple[int, int], int], shards: int, buckets: int) -> DataFrame:
    """``moves`` with ``n`` cut to what fits the quota of each pair of shards, in order of bucket and hash."""
    pair = F.col("from_shard") * shards + F.col("to_shard") + shards  # from -1 on
    limits = [quota.get((a, b), 0) for a in range(NOWHERE, shards) for b in range(shards)]
    dealt = moves.withColumn("__bucket", F.pmod(F.xxhash64("key", "from_shard"), F.lit(buckets)))
    inside = Window.partitionBy("from_shard", "to_shard", "__bucket").orderBy("key").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = dealt.groupBy("from_shard", "to_shard", "__bucket").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy("from_shard", "to_shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        starts, ["from_shard", "to_shard", "__bucket"])
    left = _pick(limits, pair) - F.col("__start") - F.col("__inside")
    return placed.withColumn("n", F.least("n", left)).filter("n > 0").select("key", "from_shard", "to_shard", "n")


def _wishes(cells: DataFrame, free: list[int]) -> DataFrame:
    """``key, from_shard, to_shard, n``: moves towards the shard with most documents of the key (ties by hash)."""
    weight = F.struct(F.col("n"), F.xxhash64("key", "shard").alias("h"), F.col("shard"))
    lists = cells.groupBy("key").agg(
        F.max(F.when(F.col("shard") != NOWHERE, weight)).alias("best"), F.collect_list(F.struct("shard", "n")).alias("own"))
    emptiest = max(range(len(free)), key=lambda s: (free[s], -s))
    target = F.coalesce(F.col("best.shard"), F.lit(emptiest))
    moves = lists.select("key", target.alias("to_shard"), F.explode("own").alias("cell"))
    return moves.select("key", F.col("cell.shard").alias("from_shard"), "to_shard", F.col("cell.n").alias("n")).filter(
        "from_shard <> to_shard")


def _moved(cells: DataFrame, granted: DataFrame) -> DataFrame:
    changes = granted.select("key", F.col("from_shard").alias("shard"), (-F.col("n")).alias("n")).unionByName(
        granted.select("key", F.col("to_shard").alias("shard"), "n"))
    return cells.unionByName(changes).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def _quota(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Swaps first, then room; rows that are nowhere yet take room before those that have a place."""
    room = [max(0, f) for f in free]
    quota = {}
    for (a, b), n in sorted(wanted.items()):
        swapped = min(n, wanted.get((b, a), 0))
        extra = min(n - swapped, room[b])
        room[b] -= extra
        quota[a, b] = swapped + extra
    return quota


def propagate(cells: DataFrame, capacity: list[int], scratch: Scratch, rounds: int = ROUNDS,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Cells after label propagation; no shard holds more than its capacity, the rest is ``NOWHERE``."""
    shards = len(capacity)
    cells = scratch.table(cells, "cells")
    buckets = max(1, -(-cells.count() // task_rows))
    # Where the hash put more linked documents than a shard may hold, the surplus has no place yet.
    over = {(s, 0): load - capacity[s] for s, load in enumerate(_loads(cells, shards)) if load > capacity[s]}
    if over:
        out = _granted(cells.select("key", F.col("shard").alias("from_shard"), F.lit(0).alias("to_shard"), "n"), over,
                       shards, buckets).withColumn("to_shard", F.lit(NOWHERE))
        cells = scratch.table(_moved(cells, out), "cells")
    for _ in range(rounds):
        free = [c - load for c, load in zip(capacity, _loads(cells, shards), strict=True)]
        wishes = scratch.table(_wishes(cells, free), "wishes")
        sums = wishes.groupBy("from_shard", "to_shard").agg(F.sum("n").alias("n")).collect()
        quota = _quota({(r["from_shard"], r["to_shard"]): r["n"] for r in sums}, free)
        if not any(quota.values()):
            break
        granted = scratch.table(_granted(wishes, quota, shards, buckets), "granted")
        cells = scratch.table(_moved(cells, granted), "cells")
    return cells


def shard(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None,
          shards: int = SHARDS, rounds: int = ROUNDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``id, size, crc, shard, slot``: one row per input row; shards' row counts differ by one at most.

    ``size`` is the text's length in UTF-8 bytes plus 1, ``crc`` its CRC-32; a null text is empty. ``slot`` counts the rows of a
    shard from 0 without gap. Rows are linked by equal ``key_col`` (null: not linked), by default by equal texts; which of
    several linked rows goes where is settled by the hash of their ids. Null and repeated ids are rows like any other. An
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text)) if key_col is None else F.unhex(F.md5(F.col(key_col).cast("string")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), key.alias("key"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # Plain scans on both sides: a key with very many rows is split over tasks.
    joined = scratch.table(rows.join(scratch.table(sizes, "sizes"), "key", "left"), "joined")
    linked = joined.filter("copies IS NOT NULL")
    start = F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int")
    cells = linked.groupBy("key", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(cells, capacity, scratch, rounds, task_rows)
    # Deal the rows of a key to its cells by rank.
    spread = F.xxhash64("id", "row")
    places = ranked(linked, ["key"], spread, F.ceil(F.col("copies") / task_rows), ["id", "row"], "rank")
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bounds = scratch.table(bounds.groupBy("key").agg(F.collect_list(F.struct("first", "n", "shard")).alias("cells")), "bounds")
    inside = F.filter("cells", lambda c: (c["first"] <= F.col("rank")) & (F.col("rank") < c["first"] + c["n"]))
    dealt = scratch.table(places, "places").join(bounds, "key").withColumn("shard", F.element_at(inside, 1)["shard"])
    columns = ["id", "size", "crc", "row"]
    dealt = scratch.table(dealt.select(*columns, "shard"), "dealt")
    # Everything without a place fills the shards up.
    free = [c - load for c, load in zip(capacity, _loads(cells, shards), strict=True)]
    loose = joined.filter("copies IS NULL").select(*columns).unionByName(
        dealt.filter(F.col("shard") == NOWHERE).select(*columns)).withColumn("one", F.lit(1))
    buckets = F.lit(max(1, -(-total // task_rows)))
    fillers = ranked(loose, ["one"], spread, buckets, ["id", "row"], "rank")
    upto = [sum(free[:s + 1]) for s in range(shards)]
    chosen = sum((F.when(F.col("rank") >= u, 1).otherwise(0) for u in upto[:-1]), F.lit(0))
    placed = fillers.withColumn("shard", chosen).select(*columns, "shard").unionByName(
        dealt.filter(F.col("shard") != NOWHERE))
    placed = scratch.table(placed, "placed")
    per_shard = F.lit(max(1, -(-total // (shards * task_rows))))
    return ranked(placed, ["shard"], spread, per_shard, ["id", "row"], "slot").select("id", "size", "crc", "shard", "slot")
