import random

import pytest
import xxhash
from pyspark.sql import functions as F

from hirelake.llm import neardup
from hirelake.operators import components
from hirelake.session import Scratch
from tests.llm.brute import texts


def slow_fingerprint(text):
    table = {i: i + 32 for i in range(65, 91)}
    words = [w for w in (text or "").translate(table).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius=2):
    """Smallest id per component of (id, fp) rows."""
    fps = sorted({m for _, m in marks})
    root = {m: m for m in fps}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for i, m in marks:
        least[find(m)] = min(least.get(find(m), i), i)
    return sorted((i, least[find(m)]) for i, m in marks)


def run(spark, docs, schema="doc_id long, text string", **options):
    scratch = Scratch(spark, "t")
    found = neardup.near_duplicates(spark.createDataFrame(docs, schema), scratch, **options).collect()
    scratch.drop()
    return sorted((r["id"], r["fp"] % 2**64, r["component"]) for r in found)


def test_fingerprint_equals_spark_and_brute_force(spark):
    docs = list(enumerate(texts(80, 3) + ["One TWO three Ünd", "a", "A b"]))
    assert [(i, f) for i, f, _ in run(spark, docs)] == [(i, slow_fingerprint(t)) for i, t in docs]
    shown = spark.range(1).select(F.xxhash64(F.lit("one two")).alias("h")).first()["h"] % 2**64
    assert neardup.fingerprint(b"One  two") == shown


def test_many_shingles():
    words = [f"a{i % 7000}" for i in range(80_000)]
    assert neardup.fingerprint(" ".join(words).encode()) == slow_fingerprint(" ".join(words))


@pytest.mark.parametrize("bucket", [1, 8, 64])
def test_links_equal_brute_force(spark, bucket):
    draw = random.Random(bucket)
    marks = []
    for _ in range(30):
        base = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 12])):
            flips = [draw.randrange(64) for _ in range(draw.randrange(5))]
            base ^= sum({1 << f for f in flips})
            marks.append(base)
    marks = sorted(set(marks)) + [0, 1, 2**63, 2**63 + 1]
    frame = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in set(marks)], "fp long")
    scratch = Scratch(spark, "t")
    edges = neardup.linked(frame, scratch, bucket=bucket).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in edges)
    roots = {r["node"] % 2**64: r["root"] % 2**64
             for r in components.components(neardup.linked(frame, scratch, bucket=bucket), scratch).collect()}
    scratch.drop()
    groups = {}
    for m in set(marks):
        groups.setdefault(roots.get(m, m), set()).add(m)
    wanted = {}
    for i, c in brute_components([(m, m) for m in set(marks)]):
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    scratch = Scratch(spark, "t")
    found = components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    scratch.drop()
    assert {tuple(r) for r in found} == (
        {(i, 100) for i in range(101, 161)} | {(i, 5) for i in range(200, 300)} | {(2, 1)})


def test_whole_operator_with_nulls_ties_and_other_columns(spark):
    long_text = " ".join(f"w{i}" for i in range(3000))
    docs = [(4, long_text, 1, "x"), (2, long_text.upper(), 2, "x"), (9, None, None, "x"), (8, " \n", 3, "x"),
            (None, "", 3, "x"), (4, "other words here", 3, None), (None, "alone now", 3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, fp int, component string")
    scratch = Scratch(spark, "t")
    found = {(r["id"], r["fp"] == 0, r["component"]) for r in neardup.near_duplicates(frame, scratch).collect()}
    scratch.drop()
    assert found == {(4, False, 2), (2, False, 2), (9, True, 8), (8, True, 8), (None, True, 8), (4, False, 4),
                     (None, False, None)}


def test_components_of_documents(spark):
    docs = list(enumerate(texts(150, 11, vocabulary=2, longest=5)))
    found = run(spark, docs)
    assert [(i, c) for i, _, c in found] == brute_components([(i, slow_fingerprint(t)) for i, t in docs])


def test_empty_table(spark):
    assert run(spark, []) == []
