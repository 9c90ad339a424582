import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from hirelake.llm import lm
from hirelake.llm.registry import LLM_QUERIES
from hirelake.llm.words import word_hashes
from hirelake.session import Scratch
from tests.llm.brute import texts

LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_base(rows):
    """(id, text, learn) to (id, n_tokens, n_known, base_score)."""
    counts = Counter()
    for _, text, learn in rows:
        if learn:
            counts.update([*split(text), None])
    total = math.log10(sum(counts.values()) + len(counts) + 1)
    return [(i, len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10(counts[t] + 1) - total for t in tokens))
            for i, tokens in ((i, [*split(text), None]) for i, text, _ in rows)]


def brute_score(rows, model):
    """Log10 probability of each text by the definition, token by token, from the trained weights."""
    p, place = model.parts(), {int(w): k for k, w in enumerate(model.words)}
    counts, n = Counter(), len(model.words)
    for _, text, learn in rows:
        counts.update(split(text) if learn else [])
    hashed = dict(zip(sorted(counts), word_hashes([w.encode() for w in sorted(counts)]).tolist(), strict=True))
    other = [c for w, c in counts.items() if hashed[w] not in place]
    made = []
    for _, text, _ in rows:
        before, total = [n + 2] * model.context, 0.0
        for token in [*split(text), None]:
            outcome = n if token is None else place.get(hashed.get(token), n + 1)
            hidden = sum(p["mixing"][k].astype(float) * p["vector"][c] for k, c in enumerate(before))
            scores = p["target"] @ hidden + p["bias"]
            total += scores[outcome] - math.log(np.exp(scores).sum())
            if outcome == n + 1:
                total += math.log((counts[token] + 1) / (sum(other) + len(other) + 1))
            before = [outcome, *before[:-1]]
        made.append(total / math.log(10))
    return made


def run(spark, rows, **options):
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, use boolean, Learn int").repartition(3)
    found, model = lm.score(frame, scratch, ["doc_id", "Learn"], "use", **options)
    made = found.drop("Learn").collect()
    scratch.drop()
    return sorted(map(tuple, made), key=lambda r: (r[0] is None, r[0], r[1:])), model


def check(spark, rows, **options):
    found, model = run(spark, rows, **options)
    base, scores = brute_base(rows), brute_score(rows, model)
    assert len(found) == len(rows)
    wanted = sorted(((*b, s) for b, s in zip(base, scores, strict=True)), key=lambda r: (r[0] is None, r[0], r[1:]))
    for r, w in zip(found, wanted, strict=True):
        assert r[:3] == w[:3] and r[3] == pytest.approx(w[3], abs=1e-9) and r[4] == pytest.approx(w[4], rel=1e-4, abs=1e-5)
    return found, model


def test_equals_brute_force(spark):
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(texts(80, 4, vocabulary=40))]
    found, model = check(spark, rows, words=20, chunk_bytes=700)
    assert len(model.words) == 20 and model.other_words > 5
    assert model.tokens == sum(len(split(t)) + 1 for _, t, learn in rows if learn)


@pytest.mark.parametrize("rows", [
    [], [(1, None, True)], [(1, "a B a", False), (2, "", None), (None, "b", False)],
    [(5, "Ünd Ünd ünd A", True), (5, "Ünd Ünd ünd A", True), (None, "ünd", True), (6, "x" * 3_000_000 + " y", None)],
    [(1, "a " * 300_000 + "b", True), (2, "\x00 \x1f a b", True), (3, " \n", True)]])
def test_odd_tables(spark, rows):
    if rows and len(rows[0][1] or "") > 10**5:  # too long for the plain loop: counts only
        found, _ = run(spark, rows, words=3)
        assert [r[:3] for r in found] == [b[:3] for b in brute_base(rows)]
    else:
        check(spark, rows, words=2)


def test_spans_and_hashes():
    data = " é\tone\x0b\x00x  one\r" + "long" * 600_000 + " z" * 5
    found = np.frombuffer(data.encode(), dtype=np.uint8)
    words = data.encode().split()
    starts, ends = lm._spans(found)
    assert [found[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == words
    assert lm._hashes(found, starts, ends).tolist() == word_hashes(words).tolist()
    assert [len(x) for x in lm._spans(found[:0])] == [0, 0]


def plain_step(model, targets, before, sample, noise):
    """Gradients of the noise-contrastive objective by differences."""
    p, q = model.parts(), np.log(model.share * noise)

    def value():
        total = 0.0
        for t, c in zip(targets, before, strict=True):
            h = (p["vector"][c].astype(float) * p["mixing"]).sum(axis=0)
            total -= math.log1p(math.exp(-(p["target"][t] @ h + p["bias"][t] - q[t])))
            total -= sum(math.log1p(math.exp(p["target"][s] @ h + p["bias"][s] - q[s])) for s in sample)
        return total

    made = {}
    for name in ("target", "bias", "vector", "mixing"):
        grad = np.zeros(p[name].shape)
        for at in np.ndindex(*p[name].shape):
            kept = p[name][at]
            p[name][at] = kept + 1e-2
            up = value()
            p[name][at] = kept - 1e-2
            grad[at] = (up - value()) / 2e-2
            p[name][at] = kept
        made[name] = grad
    return made


def test_step_follows_the_gradient():
    model = lm.fresh(np.arange(3, dtype=np.uint64), np.array([5, 3, 2, 4, 1]), size=4, context=2)
    targets, before = np.array([0, 1, 1, 3]), np.array([[5, 5], [0, 5], [2, 1], [4, 0]])
    model.parts()["mixing"][:] = np.random.default_rng(1).normal(size=(2, 4))
    start = {k: v.copy() for k, v in model.parts().items()}
    draw = np.random.default_rng([lm.SEED, 9])
    draw.permutation(4)
    sample = np.minimum(np.searchsorted(np.cumsum(model.share), draw.random(8)), 4)
    wanted = plain_step(model, targets, before, sample, 8)
    lm.train(model, targets, before, 9, batch=4, noise=8, rate=0.1)
    for name, grad in wanted.items():
        rows = grad.reshape(len(grad), -1)
        size = np.sqrt((rows ** 2).mean(axis=1, keepdims=True) + 1e-6)
        step = (model.parts()[name] - start[name]).reshape(len(grad), -1)
        assert np.abs(step - 0.1 * rows / size).max() < 2e-3


def test_probabilities_add_up_and_order_is_learnt(spark):
    draw = random.Random(3)
    follow = {w: draw.choice("abcdefgh") for w in "abcdefgh"}
    rows = []
    for i in range(300):
        words = [draw.choice("abcdefgh")]
        while len(words) < 40:
            words.append(follow[words[-1]] if draw.random() < 0.9 else draw.choice("abcdefgh"))
        rows.append((i, " ".join(words), i % 4 > 0))
    found, model = run(spark, rows)
    outcomes = np.arange(len(model.share))
    for before in ([0, 1], [5, 10], [8, 9]):
        logs = lm.log_probabilities(model, outcomes, np.tile(before, (len(outcomes), 1)))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    held = [r for r in found if r[0] % 4 == 0]
    gain = sum(r[4] - r[3] for r in held) / sum(r[1] for r in held)
    assert gain > 0.25  # of log10(8) = 0.9 a token


def test_many_outcomes_wide_contexts_and_large_scores():
    model = lm.fresh(np.arange(3000, dtype=np.uint64), np.arange(3002), size=4, context=6)
    draw = np.random.default_rng(2)
    before, targets = draw.integers(0, 3003, (50, 6)), draw.integers(0, 3002, 50)
    before[25:] = before[:25]
    model.parts()["bias"][:10] = 200  # beyond what the exponential holds
    found, p = lm.log_probabilities(model, targets, before, rows=7), model.parts()
    for t, c, value in zip(targets, before, found, strict=True):
        scores = p["target"].astype(float) @ (p["vector"][c] * p["mixing"]).sum(axis=0) + p["bias"]
        assert value == pytest.approx(scores[t] - scores.max() - math.log(np.exp(scores - scores.max()).sum()), abs=1e-4)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    learn = {i: crc32(str(i).encode()) % 7 != 2 for i, _ in docs}
    wanted = {r[0]: r[1:] for r in brute_base([(i, t, learn[i]) for i, t in docs])}
    found = LLM_QUERIES["op13_language_model"](spark, folder).collect()
    total = sum(len(split(t)) + 1 for i, t in docs if learn[i])
    assert len(found) == len(docs)
    for r in found:
        n, known, base = wanted[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn[r["doc_id"]], n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-7) and r["score"] < 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
