import random

import pytest

import corpus_pipeline
from hirelake.llm import similar
from hirelake.session import Scratch
from tests.llm.brute import texts

SCHEMA = "doc_id long, text string"


def brute(docs, width=5):
    """Smallest id per component of pairs with Jaccard similarity of 0.8 or more."""
    table = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, text in docs:
        words = (text or "").translate(table).split()
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    least = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and 9 * both >= 4 * (len(sets[i]) + len(sets[j])) and (both or not sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = {k: low if r == high else r for k, r in least.items()}
    return sorted(least.items())


def planted(seed, groups=12):
    """Texts in groups: a base text and copies of it, or of a copy, with a few words changed; all share one common line."""
    draw = random.Random(seed)
    made, line = [], " ".join(f"common{k}" for k in range(12))
    for _ in range(groups):
        size = draw.choice([8, 30, 90, 200])
        words = [f"v{draw.randrange(5000)}" for _ in range(size)]
        for _ in range(draw.choice([1, 2, 6])):
            made.append(" ".join([*words, line]))
            if draw.random() < 0.5:
                words = list(words)
            for _ in range(draw.randrange(max(2, size // 25))):
                words[draw.randrange(size)] = f"n{draw.randrange(10**6)}"
    draw.shuffle(made)
    return made


def run(spark, docs, **options):
    scratch = Scratch(spark, "t")
    found = sorted(map(tuple, similar.near_duplicates(spark.createDataFrame(docs, SCHEMA), scratch, **options).collect()))
    scratch.drop()
    return found


@pytest.mark.parametrize("docs", [
    list(enumerate(planted(1) + planted(2) + texts(40, 5) + ["One TWO three Ünd", "one two THREE Ünd", "x", "a b c", "", None])),
    # Few words and short texts: groups of many that are alike only in part.
    list(enumerate(texts(60, 11, vocabulary=2, longest=12))),
    []])
def test_components_equal_brute_force(spark, docs):
    wanted = brute(docs)
    assert not docs or len({c for _, c in wanted}) < len(docs)
    assert run(spark, docs) == wanted


def test_stage_drops_planted_near_copies(spark):
    draw = random.Random(4)
    docs, first = [], set()
    for group in range(6):
        words = [f"g{group}w{draw.randrange(400)}" for _ in range(150)]
        first.add(10 * group)
        for copy in range(4):
            changed = list(words)
            for k in range(copy and 2):
                changed[(37 * copy + 50 * k) % 150] = f"changed{draw.randrange(10**6)}"
            docs.append((10 * group + copy, " ".join(changed)))
    draw.shuffle(docs)
    assert {c for _, c in brute(docs)} == first
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == first


def test_one_passage_in_a_third_of_all_documents(spark):
    """Texts of a common passage and little else: all share prefix shingles, only some are alike; compared in many small blocks."""
    draw, docs = random.Random(8), []
    passage = [f"common{k}" for k in range(60)]
    for i in range(240):
        if i % 3:
            words = [f"d{i}w{draw.randrange(200)}" for _ in range(60)]
        else:
            tail = draw.choice([2, 5, 8, 11, 14])
            words = passage + [f"t{i if draw.random() < 0.8 else 1}x{k}" for k in range(tail)]
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(passage[k:k + 30])) for i, k in enumerate(range(0, 30, 2))]
    wanted = brute(docs)
    assert 100 < len({c for _, c in wanted}) < 240
    assert run(spark, docs, grid=4) == wanted


def test_odd_rows_and_columns(spark):
    long_text = " ".join(f"w{k % 7000}" for k in range(40_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, long_text), (7, long_text + " end"), (8, "x" * 2_000_000),
            *((i, "same text in very many rows") for i in range(20, 60))]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS id", "'n' AS node", "0 AS Gram", "2 AS component")
    scratch = Scratch(spark, "t")
    found = sorted(map(tuple, similar.near_duplicates(frame, scratch).collect()))
    scratch.drop()
    assert found == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), *((i, 20) for i in range(20, 60))]
