import random
import re

import pytest

from hirelake.llm import decontaminate
from hirelake.session import Scratch
from tests.llm.brute import texts


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width):
    windows = {}
    for name, text in items:
        words = words_of(text)
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k:k + n]), set()).add("null" if name is None else str(name))
    found = []
    for i, text in docs:
        words, hit, names = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    names |= own
        found.append((i, len(words), sorted(hit), sorted(names)))
    return sorted(found, key=lambda r: (r[0] is None, r))


def run(spark, docs, items, schema="doc_id long, text string", **options):
    scratch = Scratch(spark, "t")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_passages(spark.createDataFrame(docs, schema), bench, scratch, **options).collect()
    scratch.drop()
    return sorted(((r["id"], r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["end"])], r["items"])
                   for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("seed", "shard_words"), [(1, 200_000), (2, 200_000), (3, 60)])
def test_equals_brute_force(spark, seed, shard_words):
    docs = list(enumerate(texts(80, seed, vocabulary=3, longest=40)))
    items = list(enumerate(texts(25, seed + 50, vocabulary=3, longest=14))) + [(None, "w0é w1é w2é w0é w1é"), (3, "lone")]
    assert run(spark, docs, items, width=5, shard_words=shard_words) == brute(docs, items, 5)


def test_default_width_and_odd_words(spark):
    passage = " ".join(f"Word{i}-É" for i in range(20))
    docs = [(1, "a b " + passage.replace(" ", ", ") + " c"), (2, " ".join(passage.split()[:12])), (3, passage[:60]),
            (4, "x" + passage.upper().replace("É", "é"))]
    items = [(7, passage), (10, passage + " more"), (9, "short item"), (8, None), (6, "...")]
    assert run(spark, docs, items) == brute(docs, items, 13)


def test_automaton_against_all_passages():
    draw = random.Random(9)
    for _ in range(60):
        items = [(str(i), [b"%d" % draw.randrange(3) for _ in range(draw.randrange(1, 12))]) for i in range(4)]
        automaton = decontaminate.Automaton(items, 4)
        words = [b"%d" % draw.randrange(4) for _ in range(60)]
        spans, names = automaton.matches(words)
        text = [(0, " ".join(w.decode() for w in words))]
        wanted = brute(text, [(n, " ".join(x.decode() for x in w)) for n, w in items], 4)[0]
        assert ([k for a, b in spans for k in range(a, b)], sorted(names)) == wanted[2:]


def test_nulls_long_texts_ties_and_other_columns(spark):
    long_text = " ".join(f"w{i % 500}" for i in range(60_000))
    docs = [(1, None, "x"), (None, "", "x"), (2, long_text, None), (2, long_text, None)]
    items = [(1, " ".join(f"w{i}" for i in range(480, 500)))]
    found = run(spark, docs, items, "doc_id long, text string, row string")
    assert [(i, n, len(h), t) for i, n, h, t in found] == [
        (1, 0, 0, []), (2, 60_000, 2400, ["1"]), (2, 60_000, 2400, ["1"]), (None, 0, 0, [])]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, [], [])]


@pytest.mark.parametrize("shard_words", [200_000, 40])
def test_clean(spark, shard_words):
    passage = " ".join(f"p{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, passage, "k"), (2, f"{filler}\n{passage}. {filler}", "k"), (3, filler, None), (4, None, "k"), (5, "", "k"),
            (6, filler + " " + passage + " " + " ".join(f"p{i}" for i in range(14)), "k")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(i, passage if i == 3 else f"other item {i} text") for i in range(12)],
                                  "item_id long, text string")
    scratch = Scratch(spark, "t")
    left = decontaminate.clean(frame, bench, scratch, shard_words=shard_words).collect()
    assert sorted(tuple(r) for r in left) == [docs[1], docs[2], docs[3], docs[4]]
    cut = decontaminate.clean(frame, bench, scratch, longest=13, shard_words=shard_words).collect()
    assert sorted(tuple(r) for r in cut)[0] == (2, f"{filler}\n. {filler}", "k")
    scratch.drop()


def brute_cut(text, items, width, longest):
    """The text without runs of more than ``longest`` covered words, until there is none."""
    while True:
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        hit, runs = brute([(0, text)], items, width)[0][2], []
        for k in hit:
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        runs = [r for r in runs if r[1] - r[0] > longest]
        if not runs:
            return text
        for first, last in reversed(runs):
            text = text[:spans[first][0]] + text[spans[last - 1][1]:]


@pytest.mark.parametrize("shard_words", [200_000, 40])
def test_cutting_goes_on_until_no_passage_is_left(spark, shard_words):
    draw, filler = random.Random(5), " ".join(f"f{i}" for i in range(400))
    p = [f"P{i}é" for i in range(13)]
    nested = " ".join([*p[:6], *p, *p[6:]])  # without the passage inside, the same passage stands there again
    docs = [(1, f"{filler} {nested}, {filler}"), (2, f"{filler} {' '.join([*p[:3], *p[:6], *p, *p[6:], *p[3:]])}. {filler}"),
            (3, filler + " " + " ".join(p[:12])), (4, None), (5, f"{filler}\n{'; '.join(p)}"), (5, f"{filler}\n{'; '.join(p)}")]
    docs += [(i, filler + " " + " ".join(draw.choice(["é", "b", "é", *p[:2]]) for _ in range(20))) for i in range(6, 12)]
    items = [(1, " ".join(p)), (2, "é b é"), (2, "é b é"), (3, None), *((k, f"item {k} of no text") for k in range(10, 20))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS Number", "2 AS kept")
    scratch = Scratch(spark, "t")
    left = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"), scratch, longest=12,
                               shard_words=shard_words).select("doc_id", "text").collect()
    scratch.drop()
    hits = {(i, t): h for (i, t), (_, _, h, _) in ((d, brute([d], items, 13)[0]) for d in docs)}
    wanted = [(i, t and brute_cut(t, items, 13, 12)) for i, t in docs if 20 * len(hits[i, t]) < max(1, len(words_of(t)))]
    assert sorted(map(tuple, left), key=str) == sorted(wanted, key=str) and len(wanted) > 6
    assert not any(len(w) >= 13 and p[0].lower() in w for w in (brute([(0, t)], items, 13)[0][2] for _, t in wanted))
