import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import langid
from hirelake.llm.registry import LLM_QUERIES

SAMPLES = {
    "en": "the of and that with thing is on which there would about",
    "de": "der die und nicht ein schön über für ist auf sich größe",
    "fr": "le la les été où dans pour avec être français çà",
}


def corpus(count, seed):
    draw = random.Random(seed)
    made = []
    for i in range(count):
        lang = draw.choice(sorted(SAMPLES))
        words = draw.choices(SAMPLES[lang].split(), k=draw.randrange(3, 40))
        made.append((i, " ".join(words), lang))
    return made


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(corpus(600, 1), "doc_id long, text string, lang string"))


def test_accuracy_and_calibration(model):
    told = [(model.predict(t), lang) for _, t, lang in corpus(400, 2)]
    right = np.mean([p == lang for (p, _), lang in told])
    assert right > 0.97
    assert abs(np.mean([s for (_, s), _ in told]) - right) < 0.1


def test_counts_equal_slow_count():
    text = "Ab cé, 12 d!"
    grams = langid.ngram_counts(text)
    line = " ab cé d  "  # border before, one after each word, one at the end
    assert grams.sum() == len(line) + len(line) - 1 + len(line) - 2
    assert langid.ngram_counts("AB  CÉ D!").sum() == grams.sum()
    assert (langid.ngram_counts("AB--CÉ-----D ") == grams).all()


def test_blocks_do_not_matter(monkeypatch):
    text = " ".join(SAMPLES.values()) * 20
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.ngram_counts(text) == whole).all()


def test_elastic_net_makes_weights_sparse(model):
    assert (model.weights == 0).mean() > 0.9 and (model.weights != 0).any()


def test_nulls_blanks_and_other_columns(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "12 !? \n", None), (4, "die und nicht " * 20000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = langid.predict(frame.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert [tuple(r) for r in found[:3]] == [(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)]
    kept = langid.predict(frame, model, frame.columns, names=("__lang", "__score"))
    assert kept.columns == ["doc_id", "text", "score", "__lang", "__score"]
    assert [tuple(r) for r in kept.collect()] == [(*a, r["lang_pred"], r["score"]) for a, r in zip(rows, found, strict=True)]
    assert found[3]["lang_pred"] == "de" and 0.9 < found[3]["score"] <= 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for frame in (empty, unlabelled, spark.createDataFrame([(1, "..", "en")], "doc_id long, text string, lang string")):
        model = langid.fit(frame)
        assert model.predict("some text") == ("und", 0.0)
        assert langid.predict(frame, model, ["doc_id"]).count() == frame.count()


def test_sample_is_bounded(spark):
    rows = corpus(300, 3) + [(i, "der die das", "de") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert model.predict("der und die und nicht")[0] == "de"


def test_held_out_rule(spark):
    found = {r["id"]: r["h"] for r in spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    assert spark.sql("select cast(null as long) id").select(langid.held_out(F.col("id")).alias("h")).first()["h"] is False


def test_query_accuracy_on_held_out(spark):
    docs = "/root/testdata/sf0.001"
    found = LLM_QUERIES["op3_language_id"](spark, docs)
    langs = spark.read.parquet(f"{docs}/documents.parquet").select("doc_id", "lang")
    rows = found.join(langs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.9


def plain_ftrl(examples, targets, classes):
    """Per-coordinate FTRL-proximal with an elastic net, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i, c):
        total = z.get((i, c), 0.0)
        if abs(total) <= langid.L1:
            return 0.0
        sign = 1.0 if total > 0 else -1.0
        return -(total - sign * langid.L1) / ((langid.BETA + math.sqrt(n.get((i, c), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for (at, values), target in zip(examples, targets, strict=True):
            old = {(i, c): weight(i, c) for i in at for c in range(classes)}
            scores = [sum(v * old[i, c] for i, v in zip(at, values, strict=True)) for c in range(classes)]
            total = sum(math.exp(s) for s in scores)
            for i, v in zip(at, values, strict=True):
                for c in range(classes):
                    g = v * (math.exp(scores[c]) / total - (c == target))
                    before = n.get((i, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * old[i, c]
                    n[i, c] = before + g * g
    return {k: weight(*k) for k in z}


def test_training_equals_plain_ftrl():
    draw = np.random.default_rng(6)
    examples, targets = [], draw.integers(0, 3, 25)
    for t in targets:
        at = np.sort(draw.choice(40, draw.integers(1, 8), replace=False)) + 5 * t
        values = draw.random(len(at))
        examples.append((at, values / np.sqrt((values * values).sum())))
    found, wanted = langid.train(examples, targets, 3), plain_ftrl(examples, targets, 3)
    assert all(abs(found[k] - w) < 1e-12 for k, w in wanted.items())
    assert np.count_nonzero(found) == sum(w != 0 for w in wanted.values())


def test_temperature_has_the_least_loss():
    draw = np.random.default_rng(7)
    logits = draw.normal(size=(200, 3)) * 4
    chances = np.exp(logits / 2)
    targets = np.array([draw.choice(3, p=c / c.sum()) for c in chances])

    def loss(t):
        return -sum(logits[k][c] / t - math.log(np.exp(logits[k] / t).sum()) for k, c in enumerate(targets))

    best = langid.temperature(logits, targets)
    assert 1 / 32 <= best <= 32 and all(loss(best) <= loss(best * f) + 1e-9 for f in (0.5, 0.9, 1.1, 2))
