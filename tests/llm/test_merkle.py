import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hirelake.llm import merkle
from hirelake.session import Scratch


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    """The root and, per leaf, the (left, right) siblings of each level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            first = k - k % fanout
            ways[leaf].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + fanout])))
        at = [k // fanout for k in at]
        nodes = [digest("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout):
    """Rows (source, doc_id, leaf) to (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for source, i, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(source, []).append((i, leaf))
    trees = [tree([leaf for _, leaf in group], fanout) for group in groups.values()]
    if not trees:
        return []
    root, above = tree([t[0] for t in trees], fanout)
    return sorted(((i, leaf, subroot, root, tuple(way + up)) for group, (subroot, ways), up in
                   zip(groups.values(), trees, above, strict=True) for (i, leaf), way in zip(group, ways, strict=True)), key=repr)


def run(spark, rows, **options):
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame(rows, "source string, doc_id long, leaf string")
    frame = frame.selectExpr("*", "1 AS root", "'x' AS Block", "doc_id AS kept", "2 AS tree")
    made = merkle.manifest(frame, scratch, ["doc_id", "root", "Block"], **options).collect()
    scratch.drop()
    assert all(r["kept"]["root"] == 1 and r["kept"]["Block"] == "x" for r in made)
    return sorted(((r["kept"]["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in made), key=repr)


@pytest.mark.parametrize("fanout, height", [(3, 1), (2, 2), (4, 0)])
def test_equals_brute_force(spark, fanout, height):
    draw = random.Random(fanout * 10 + height)
    sizes = {None: 1, "": 2, "hot": 83, "é": 3, "z": 4, "a": 27, "Ω": 28, "b": 10, "c": 1}
    rows = [(s, draw.choice([None, *range(50)]) if n > 20 else k, digest(f"{s}{k % 25}")) for s, n in sizes.items() for k in range(n)]
    draw.shuffle(rows)
    assert run(spark, rows, fanout=fanout, height=height) == brute(rows, fanout)


@pytest.mark.parametrize("rows", [[], [(None, None, digest("a"))], [("s", 1, digest("a"))] * 5])
def test_small_tables(spark, rows):
    assert run(spark, rows, height=1) == brute(rows, 3)


def test_leaf_and_fold(spark):
    rows = [(1, "s", None, "é\n"), (None, "", "x", None)]
    frame = spark.createDataFrame(rows, "i long, s string, l string, t string")
    made = [r[0] for r in frame.select(merkle.leaf([F.col(c) for c in "islt"])).collect()]
    assert made == [digest("1:11:s-3:é\n"), digest("-0:1:x-")]
    proof = F.lit([]).cast(merkle.PROOF)
    way = F.array(F.struct(F.lit("a").alias("left"), F.lit("bc").alias("right")))
    row = frame.limit(1).select(merkle.fold(F.lit("n"), proof), merkle.siblings(proof), merkle.fold(F.lit("n"), way),
                                merkle.siblings(way)).first()
    assert tuple(row) == ("n", "", digest("anbc"), "abc")


def test_tampering_is_seen(spark):
    leaves = [digest(str(k)) for k in range(40)]
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame([("s", k, leaf) for k, leaf in enumerate(leaves)], "source string, doc_id long, leaf string")
    made = merkle.manifest(frame, scratch, ["doc_id"], height=1)
    bad = F.when(F.col("kept.doc_id") % 7 == 3, F.sha2("leaf", 256)).otherwise(F.col("leaf"))
    seen = made.select("kept.doc_id", (merkle.fold(bad, F.col("proof")) == F.col("root")).alias("ok")).collect()
    scratch.drop()
    assert sorted(r["doc_id"] for r in seen if not r["ok"]) == [3, 10, 17, 24, 31, 38]
