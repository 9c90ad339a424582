import zlib

import numpy as np
import pytest

from hirelake.llm import packing
from hirelake.llm.registry import LLM_QUERIES
from hirelake.session import Scratch
from tests.llm.brute import texts

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def encoded(rows):
    coder = tokenizers.Tokenizer.from_file(PATH)
    return [(i, coder.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]


def run(spark, rows, schema="doc_id long, text string", **options):
    scratch = Scratch(spark, "t")
    found = packing.pack(spark.createDataFrame(rows, schema), scratch, PATH, **options).collect()
    scratch.drop()
    return found


def check(rows, found, length):
    """Every id in exactly one piece, checksums right, offsets and starts without gaps."""
    wanted = sorted((str(i), ids) for i, ids in encoded(rows))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert sum(r["length"] for r in pieces) <= length
    if len({i for i, _ in rows}) == len(rows):
        for i, ids in encoded(rows):
            pieces = sorted(by_doc[i], key=lambda r: r["start"])
            assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
            assert pieces[-1]["start"] + pieces[-1]["length"] == len(ids)
            for r in pieces:
                own = ids[r["start"]:r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
                assert r["doc_tokens"] == len(ids) and (r["ids"] is None or r["ids"] == own)
    assert sum(r["length"] for r in found) == sum(len(ids) for _, ids in wanted)
    return by_sequence


@pytest.mark.parametrize("shard_tokens", [300, 10**6])
def test_every_id_once(spark, shard_tokens):
    rows = list(enumerate(texts(100, 4, longest=60) + ["word " * 400]))
    sequences = check(rows, run(spark, rows, length=64, shard_tokens=shard_tokens, with_ids=True), 64)
    short = [s for s, p in sequences.items() if sum(r["length"] for r in p) < 64]
    assert shard_tokens == 300 or len(short) <= 1


def test_scores_equal_plain_bm25():
    draw = np.random.default_rng(1)
    documents = [draw.integers(0, 30, draw.integers(1, 40)) for _ in range(25)]
    idf = draw.random(30)
    index = packing.Index(documents, idf, 20.0)

    def weight(t, d):
        count = (documents[d] == t).sum()
        return idf[t] * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * len(documents[d]) / 20.0)) if count else 0

    for q in range(25):
        terms = sorted(set(documents[q].tolist()), key=lambda t: (-np.float32(weight(t, q)), t))[:8]
        wanted = [sum(weight(t, d) for t in terms) for d in range(25)]
        assert np.allclose(index.scores(q, 8), wanted, rtol=1e-4)


def test_neighbours_share_sequences(spark):
    topics = ["river water boat fish lake", "engine piston valve motor fuel", "violin cello music sonata opera"]
    rows = [(i, " ".join((topics[i % 3] + f" x{i}").split()[::(-1) ** (i // 3)]) * 2) for i in range(60)]
    sequences = check(rows, run(spark, rows, length=128), 128)
    pure = [len({r["id"] % 3 for r in p}) for p in sequences.values()]
    assert np.mean([n <= 2 for n in pure]) > 0.8 and np.mean([n == 1 for n in pure]) > 0.5


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "same text", "x"), (1, "same text", "x"), (None, "other", "x"), (3, None, None), (4, "", "x")]
    found = run(spark, rows, "doc_id long, text string, mark string")
    check([r[:2] for r in rows], found, packing.LENGTH)
    assert sorted((str(r["id"]), r["length"]) for r in found) == [("1", 3), ("1", 3), ("3", 1), ("4", 1), ("None", 2)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    frame = LLM_QUERIES["op9_packing"](spark, folder)
    assert frame.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = [{**r.asDict(), "id": r["doc_id"], "ids": None} for r in frame.collect()]
    sequences = check(rows, found, 2048)
    total = sum(r["length"] for r in found)
    assert len(sequences) * 2048 - total < 2048
