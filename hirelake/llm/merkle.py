"""Merkle manifest of a table: a hash tree per group, a tree over the groups, and each row's proof.

Rows are numbered by group and id and cut into aligned blocks of ``fanout ** height`` leaves, the partitions of the tree. A
task hashes one block. The rest is a butterfly exchange over the blocks: in round ``r`` the ``fanout`` neighbouring sets of
``fanout ** r`` blocks each deal their members out by position, and the members of equal position swap their sets' roots. Each
of them hashes the common ancestor itself, so after the last round every block knows the root and all siblings on its own
way up; nothing is sent down. A set cut short by the end of the tree lets its members stand at several positions.

The roots of the groups' trees are the leaves of one more such tree. A second pass over the blocks hashes them again and joins
the ways of its leaves to the block's own.

Hashes are lower-case hexadecimal text and are concatenated as such. A run of fewer than ``fanout`` nodes, even of one, gets
a parent as well, until one node is left; a lone leaf is its own root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hirelake.operators.ranking import number_rows
from hirelake.session import Scratch

FANOUT = 3
# Levels inside a block: at most 2187 leaves.
HEIGHT = 7

PROOF = "array<struct<left: string, right: string>>"


def leaf(columns: list[Column]) -> Column:
    """Hash of the values in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(proof, node, lambda below, level: F.sha2(F.concat(level["left"], below, level["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], fanout: int, height: int, alone: bool) -> list[list[str]]:
    """The nodes and their ancestors: up to one node if the block is the whole tree, else through ``height`` levels."""
    made = [nodes]
    while len(made[-1]) > 1 if alone else len(made) <= height:
        below = made[-1]
        made.append([_digest("".join(below[k:k + fanout])) for k in range(0, len(below), fanout)])
    return made


def _nodes(table: pa.Table) -> tuple[pa.Table, list[str], bool]:
    """A block's rows in order, their hashes, and whether the block is its whole tree."""
    table = table.sort_by("at")
    whole = table["n"][0].as_py() == table.num_rows
    return table, [h.hex() for h in table["leaf"].to_pylist()], whole


def _block_roots(fanout: int, height: int):
    def run(table: pa.Table) -> pa.Table:
        table, nodes, alone = _nodes(table)
        root = _levels(nodes, fanout, height, alone)[-1][0]
        return table.slice(0, 1).select(["tree", "n", "block"]).append_column("node", pa.array([root]))

    return run


def _ways(fanout: int, height: int):
    """Joins the way inside a block to the block's own; the hashes of the block are counted once, then looked up by place."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, nodes, alone = _nodes(left)
        levels = _levels(nodes, fanout, height, alone)[:-1]
        before, after, places = [], [], []
        at = np.arange(len(nodes))
        for level in levels:
            places.append(at + len(before))
            for k in range(len(level)):
                first = k - k % fanout
                before.append("".join(level[first:k]))
                after.append("".join(level[k + 1:first + fanout]))
            at = at // fanout
        for step in right["path"][0].as_py():
            places.append(np.full(len(nodes), len(before)))
            before.append(step["left"])
            after.append(step["right"])
        taken = pa.array(np.stack(places, axis=1).ravel() if places else np.zeros(0, np.int64))
        steps = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(taken) for x in (before, after)], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * len(places)), steps)
        made = table.select(["kept"]).append_column("leaf", pa.array(nodes))
        for name in ("subroot", "root"):
            made = made.append_column(name, pa.array([right[name][0].as_py()] * len(nodes), pa.string()))
        return made.append_column("proof", proof)

    return run


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``tree, block, node, path`` of the roots ``tree, at, n, block, node`` of blocks, the ``at``-th of ``n`` of its tree: the
    root of the tree and the siblings from the block to it.

    The number of rounds is the logarithm of the largest tree's blocks. Each round is one shuffle of a row per block and at
    most as many stand-ins; a group has ``fanout`` rows at most.
    """
    state = blocks.withColumn("path", F.array().cast(PROOF))
    most = blocks.agg(F.max("n").alias("n")).first()["n"] or 0
    span = 1
    while span < most:
        grows = F.col("n") > span
        part = F.when(grows, F.floor(F.col("at") / span)).otherwise(F.lit(0))
        among = F.floor(part / fanout)
        own = F.least(F.lit(span), F.col("n") - part * span)
        widest = F.least(F.lit(span), F.col("n") - among * fanout * span)
        place = F.when(grows, F.col("at") - part * span).otherwise(F.col("at"))
        last = F.when(grows, widest - 1).otherwise(place)
        dealt = state.select(
            "tree", "n", among.alias("among"), part.alias("part"), place.alias("place"), "at", "block", "node", "path",
            F.explode(F.sequence(place, last, F.greatest(own, F.lit(1)))).alias("slot"))
        real = F.col("slot") == F.col("place")
        member = F.struct("part", "node", *[F.when(real, F.col(c)).alias(c) for c in ("at", "block", "path")])
        met = dealt.groupBy("tree", "n", "among", "slot").agg(F.sort_array(F.collect_list(member)).alias("members"))

        def joined(kept) -> Column:
            return F.array_join(F.transform(F.filter("members", kept), lambda m: m["node"]), "")

        each = met.select("tree", "n", "members", F.explode(F.filter("members", lambda m: m["block"].isNotNull())).alias("own"))
        step = F.struct(joined(lambda m: m["part"] < F.col("own.part")).alias("left"),
                        joined(lambda m: m["part"] > F.col("own.part")).alias("right"))
        state = each.select(
            "tree", "n", "own.at", "own.block",
            F.when(grows, F.sha2(joined(lambda m: F.lit(True)), 256)).otherwise(F.col("own.node")).alias("node"),
            F.when(grows, F.concat("own.path", F.array(step))).otherwise(F.col("own.path")).alias("path"))
        span *= fanout
    return state.select("tree", "block", "node", "path")


def _tops(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """``tree, block, node, path`` per block of ``leaves`` (``tree, n, block, at, leaf``)."""
    size = fanout ** height
    roots = leaves.select("tree", "n", "block", "at", "leaf").groupBy("block").applyInArrow(
        _block_roots(fanout, height), "tree long, n long, block long, node string")
    return butterfly(roots.select("tree", ((F.col("block") - F.col("tree")) / size).cast("long").alias("at"),
                                  F.ceil(F.col("n") / size).alias("n"), "block", "node"), fanout)


def _placed(numbered: DataFrame, trees: DataFrame, size: int) -> DataFrame:
    """Rows with the tree they belong to. ``trees`` (``grp, tree, n``) has a row per group, copied for each ``size`` numbers it
    spans, so that a group with most of the rows is not one key."""
    number = F.col("number") - 1
    spans = trees.select("grp", "tree", "n", F.explode(F.sequence(
        F.floor(F.col("tree") / size), F.floor((F.col("tree") + F.col("n") - 1) / size))).alias("span"))
    keyed = numbered.withColumn("span", F.floor(number / size))
    joined = keyed.join(spans.hint("merge"), keyed["grp"].eqNullSafe(spans["grp"]) & (keyed["span"] == spans["span"]))
    rank = number - F.col("tree")
    return joined.select("tree", "n", (F.col("tree") + F.floor(rank / size) * size).alias("block"),
                         F.pmod(rank, F.lit(size)).alias("at"), "leaf", "kept")


def manifest(rows: DataFrame, scratch: Scratch, keep: list[str], id_col: str = "doc_id", group_col: str = "source",
             leaf_col: str = "leaf", fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``kept`` (a struct of the columns ``keep``), ``leaf, subroot, root, proof``: one row per input row, read lazily from
    ``scratch``. ``leaf_col`` holds hexadecimal SHA-256 hashes, not null.

    Leaves of a group ascend by id (null first, ties by hash; rows that tie in that too are alike). Groups ascend by name (null
    first, by bytes). Repeated rows are leaves of their own. An empty table gives no rows; other columns are not read.
    """
    size = fanout ** height
    named = rows.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"),
                        F.unhex(leaf_col).alias("leaf"), F.monotonically_increasing_id().alias("tie"),
                        F.struct(*keep).alias("kept"))
    numbered = scratch.table(number_rows(named, ["grp", "id", "leaf", "tie"], "number", scratch).select(
        "grp", "number", "leaf", "kept"), "leaves")
    groups = numbered.groupBy("grp").agg((F.min("number") - 1).alias("tree"), F.count(F.lit(1)).alias("n"))
    trees = scratch.table(groups, "trees")
    leaves = scratch.table(_placed(numbered, trees, size), "placed")
    tops = scratch.table(_tops(leaves, fanout, height), "tops")
    subroots = tops.filter(F.col("tree") == F.col("block")).select(
        F.lit(None).cast("string").alias("grp"), F.col("tree").alias("id"), F.unhex("node").alias("leaf"),
        F.struct(F.col("tree").alias("of"), F.col("node").alias("subroot")).alias("kept"))
    over = scratch.table(number_rows(subroots, ["id"], "number", scratch), "subroots")
    one = over.groupBy("grp").agg(F.lit(0).cast("long").alias("tree"), F.count(F.lit(1)).alias("n"))
    upper = scratch.table(_placed(over, one, size), "placed")
    upper_tops = _tops(upper, fanout, height)
    ways = StructType([upper.schema["kept"], *_schema(upper)])
    above = scratch.table(upper.groupBy("block").cogroup(_ends(upper_tops, F.col("node")).groupBy("block"))
                          .applyInArrow(_ways(fanout, height), ways), "above")
    ends = tops.join(above.select(F.col("kept.of").alias("tree"), "root", F.col("proof").alias("rest"),
                                  F.col("kept.subroot").alias("subroot")), "tree")
    ends = scratch.table(ends.select("block", "subroot", "root", F.concat("path", "rest").alias("path")), "ends")
    return leaves.select("block", "at", "n", "leaf", "kept").groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(
        _ways(fanout, height), StructType([leaves.schema["kept"], *_schema(leaves)]))


def _ends(tops: DataFrame, subroot: Column) -> DataFrame:
    return tops.select("block", subroot.alias("subroot"), F.col("node").alias("root"), "path")


def _schema(leaves: DataFrame) -> list[StructField]:
    made = leaves.sparkSession.createDataFrame([], f"leaf string, subroot string, root string, proof {PROOF}")
    return list(made.schema)
