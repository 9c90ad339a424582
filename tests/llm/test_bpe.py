import random

import pytest

from hirelake.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_50k.json")
SIGNS = ["'", "'s", "'re", "'ll", "'ve", "'tis", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "a", "Rel",
         "é", "ß", "7", "٣", "²", "Ⅷ", "!", "...", "<|endoftext|>", "中文", "😀", "é", "I'd", "x'", "_", "​", "s", "re"]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(PATH)


def check(reference, texts):
    wanted = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.Encoder(PATH).encode(texts)] == wanted


def test_random_texts(reference):
    draw = random.Random(1)
    check(reference, ["".join(draw.choices(SIGNS, k=draw.randrange(25))) for _ in range(3000)])


def test_given_texts(reference, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check(reference, [r["text"] for r in rows])


def test_long_texts_small_blocks_and_full_cache(reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(bpe, "KEPT", 30)
    monkeypatch.setattr(bpe, "_TABLES", [])
    draw = random.Random(2)
    check(reference, ["".join(draw.choices(SIGNS, k=draw.choice([5, 400]))) for _ in range(60)] + ["", "x" * 500])


def test_added_token(reference):
    end = "<|endoftext|>"
    check(reference, [f"a {end} b", end, end * 3, f" {end}", f"x  {end}\n", f"{end}'s", f"<|{end}|>", f"long text {end} " * 300])
    assert next(bpe.Encoder(PATH).encode([f"a {end} b"])).tolist() == [64, 220, 50256, 275]


def test_null_is_empty():
    assert [len(x) for x in bpe.Encoder(PATH).encode([None, "", "a"])] == [0, 0, 1]
