import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hirelake.llm import simhash
from hirelake.llm.registry import LLM_QUERIES
from hirelake.session import Scratch
from tests.llm.brute import texts


def hash_of(spark, pairs):
    """Spark's own 64-bit hash of pairs of words."""
    frame = spark.createDataFrame(sorted(pairs, key=repr), "a string, b string")
    return {(r["a"], r["b"]): r["h"] % 2**64 for r in frame.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}


def terms_of(text):
    words = [w for w in "".join(" " if c in simhash.BLANKS else c for c in text or "").split(" ") if w]
    return list(zip(words, [*words[1:], None], strict=False))


def slow_fingerprint(text, hashes):
    votes, total = [0] * 64, 0
    for term in terms_of(text):
        size = sum(len(w.encode()) for w in term if w)
        weight = 1 + sum(size >= s for s in simhash.WEIGHT_STEPS)
        total += weight
        for b in range(64):
            votes[b] += weight * (hashes[term] >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, t or "") for i, t in enumerate(texts(60, 9) + ["", " one ", "ab " * 3000, "x" * 40 + " y"])]
    hashes = hash_of(spark, {p for _, t in rows for p in terms_of(t)})
    found = simhash.fingerprints(spark.createDataFrame(rows, "k long, t string"), ["k"], "t").collect()
    assert sorted((r["k"], r["fp"] % 2**64) for r in found) == [(k, slow_fingerprint(t, hashes)) for k, t in rows]


def slow_edit(docs):
    """Rows (id, text, edited, next text) of distinct ids."""
    order = sorted(docs, key=lambda d: -d[0])
    found = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t or "") // 3
        found.append((i, t or "", (t or "")[:len(t or "") - third] + (after or "")[:third], after or ""))
    return sorted(found)


@pytest.mark.parametrize("docs", [list(enumerate(texts(70, 2))), [(3, "abcdef")], [(3, None)], [],
                                  [(1, "ü" * 50_000), (2, "x"), (-5, "yz" * 30_000)]])
def test_edited_equals_brute_force(spark, docs):
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = simhash.edited(frame, scratch).collect()
    texts_by_key = {r["key"]: r["text"] for r in found}
    assert sorted((r["id"], r["text"], r["edited"], texts_by_key[r["next_key"]]) for r in found) == slow_edit(docs)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    scratch.drop()


def test_repeats_null_ids_and_other_columns(spark):
    rows = [(5, "aaaaaa", "k"), (5, "aaaaaa", "k"), (None, "bbbbbb", "k"), (7, "cccccc", None)]
    scratch = Scratch(spark, "t")
    found = simhash.edited(spark.createDataFrame(rows, "doc_id long, text string, key string"), scratch).collect()
    assert {(r["id"], r["edited"], r["copies"]) for r in found} == {
        (7, "ccccaa", 1), (5, "aaaabb", 2), (None, "bbbbcc", 1)}
    assert len(found) == 3
    scratch.drop()


@pytest.mark.parametrize(("radius", "blocks"), [(0, 2), (1, 3), (3, 6)])
def test_search_equals_brute_force(spark, radius, blocks):
    draw = random.Random(radius)
    marks = {0, 2**63, 2**64 - 1}
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(12):
            marks.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(6))}))
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    frame = spark.createDataFrame(signed, "fp long")
    queries = spark.createDataFrame(signed[::3] + signed[:2], "fp long")
    found = [(r["query"], r["fp"]) for r in simhash.within_radius(queries, frame, radius, blocks).collect()]
    wanted = [(a, b) for a in {q for q, in signed[::3] + signed[:2]} for b, in signed
              if ((a ^ b) % 2**64).bit_count() <= radius]
    assert sorted(found) == sorted(wanted)


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in LLM_QUERIES["op7_simhash"](spark, folder).collect()}
    edits = {i: e for i, _, e, _ in slow_edit(docs)}
    hashes = hash_of(spark, {p for t in [*(t for _, t in docs), *edits.values()] for p in terms_of(t)})
    marks = {i: slow_fingerprint(t, hashes) for i, t in docs}
    order = sorted(marks, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for i, text in docs:
        row, edit = found[i], slow_fingerprint(edits[i], hashes)
        assert row["fingerprint"] == f"{marks[i]:016x}" and row["edited_fingerprint"] == f"{edit:016x}"
        assert row["edited_sha256"] == hashlib.sha256(edits[i].encode()).hexdigest() and row["n_chars"] == len(text)
        assert row["near_edited"] == 1 - (marks[i] ^ edit).bit_count() / 64
        assert row["near_next"] == 1 - (marks[i] ^ marks[after[i]]).bit_count() / 64
        near = sum((marks[i] ^ m).bit_count() <= 3 for m in marks.values()) - 1
        assert row["n_within"] == (near if i % 100 == 0 else None)
