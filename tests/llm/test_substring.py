import re

import pytest

from hirelake.llm import substring
from hirelake.session import Scratch
from tests.llm.brute import texts


def brute(docs, width):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, words in split:
        for k in range(len(words) - width + 1):
            key = tuple(words[k:k + width])
            least[key] = min(least.get(key, i), i)
    found = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if least[tuple(words[k:k + width])] < i:
                gone.update(range(k, k + width))
        found.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(found)


def run(spark, docs, schema="doc_id long, text string", **options):
    frame = spark.createDataFrame(docs, schema)
    scratch = Scratch(spark, "t")
    found = [tuple(r) for r in substring.keep_first_passages(frame, scratch, ["doc_id"], **options).collect()]
    scratch.drop()
    return sorted(found, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = list(enumerate(texts(120, seed)))
    assert run(spark, docs, width=4, chunk_bytes=600, range_windows=100) == brute(docs, 4)


def test_one_chunk_and_default_width(spark):
    docs = list(enumerate(texts(60, 5, vocabulary=2, longest=60)))
    assert run(spark, docs) == brute(docs, 13)


def test_long_word_and_long_text(spark):
    long_word = "x" * 3_000_000
    docs = [(1, " ".join(f"a{i}" for i in range(50_000))), (2, " ".join(f"a{i}" for i in range(100, 40_000))),
            (3, long_word + " b c"), (4, "q " + long_word + " b c")]
    found = run(spark, docs, width=3)
    assert [r[:3] for r in found] == [(1, 50_000, 0), (2, 39_900, 39_900), (3, 3, 0), (4, 4, 3)]


def test_null_ids_ties_and_other_columns(spark):
    passage = "a b c d e"
    docs = [(None, passage, "k", 1), (7, passage, "k", 2), (7, passage, None, 3), (9, "z " + passage, "k", None)]
    found = run(spark, docs, "doc_id long, text string, id string, chunk int", width=3)
    assert found == [(7, 5, 0, passage), (7, 5, 0, passage), (9, 6, 5, "z"), (None, 5, 5, "")]


def test_columns_kept_and_texts_as_they_are(spark):
    docs = [(1, "a  b\nc d", "x", None), (2, "z a  b c d", None, 5.5), (3, "q\t q", "y", 1.0), (4, None, "y", 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, kept string, n_words double")
    scratch = Scratch(spark, "t")
    found = substring.keep_first_passages(frame, scratch, ["kept", "n_words", "doc_id"], width=3, chunk_bytes=20,
                                          names=("__n", "__r", "__t"), as_is=True)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == [
        ("x", None, 1, 4, 0, "a  b\nc d"), (None, 5.5, 2, 5, 4, "z"), ("y", 1.0, 3, 2, 0, "q\t q"), ("y", 1.0, 4, 0, 0, "")]
    scratch.drop()


def test_empty_table(spark):
    assert run(spark, []) == []
