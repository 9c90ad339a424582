import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from hirelake.functions import segment as S
from hirelake.functions.tokens import keyword_rows, words

WORDS = ["数据", "分析", "工程师", "开发", "产品经理", "机器学习", "负责", "沟通"]
FILLERS = "的了和在有我这上来到时大地为子中你说生国年着就那要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种开美总从无情己面最女但现前些所同日手又行意动方期它头经长儿回位"


def texts(count, seed=1):
    draw = random.Random(seed)
    made = []
    for _ in range(count):
        parts = [draw.choice(WORDS) if draw.random() < 0.6 else draw.choice(FILLERS) for _ in range(draw.randrange(1, 9))]
        made.append("".join(parts) + draw.choice(["。", "，Java C++ ", "", " x"]))
    return made


def brute_cut(lexicon, run):
    """Every way to cut a run."""
    ways = []
    for cuts in product([0, 1], repeat=len(run) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(run[at:k])
                at = k
        parts.append(run[at:])
        costs = [lexicon.costs.get(p, lexicon.unknown if len(p) == 1 else None) for p in parts]
        if None not in costs and all(len(p) <= lexicon.longest for p in parts):
            ways.append((sum(costs), len(parts), tuple(-len(p) for p in parts), tuple(parts)))
    return min(ways)[3]


def test_cut_equals_brute_force():
    draw = random.Random(4)
    for _ in range(150):
        signs = "甲乙丙"
        costs = {"".join(draw.choices(signs, k=draw.randrange(1, 4))): draw.randrange(1, 6) for _ in range(8)}
        lexicon = S.Lexicon(costs, draw.randrange(2, 9), 3)
        run = "".join(draw.choices(signs + "丁", k=draw.randrange(1, 10)))
        assert lexicon.cut(run) == brute_cut(lexicon, run)


def plain_lexicon(rows, longest=4):
    """Lexicon by plain counting."""
    runs = [r for t in rows for r in S.RUNS.findall(t or "")]
    counts = Counter(r[k:k + n] for r in runs for n in range(1, longest + 1) for k in range(len(r) - n + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)
    sides = {}
    for r in runs:
        for n in range(2, longest + 1):
            for k in range(len(r) - n + 1):
                for side, at in ((0, k - 1), (1, k + n)):
                    border = at < 0 or at >= len(r)
                    sides.setdefault((r[k:k + n], side), []).append(None if border else r[at])
    made = {g: n for g, n in counts.items() if len(g) == 1}

    def entropy(seen):
        n, known = len(seen), Counter(s for s in seen if s is not None)
        return math.log(n) - sum(c * math.log(c) for c in known.values()) / n

    for g, n in counts.items():
        if len(g) > 1 and n >= S.LEAST_COUNT and min(
                math.log(n * total / (counts[g[:k]] * counts[g[k:]])) for k in range(1, len(g))) >= S.COHESION and min(
                entropy(sides[g, side]) for side in (0, 1)) >= S.BRANCHING:
            made[g] = n
    return {g: round(1000 * math.log(total / n)) for g, n in made.items()}


def test_lexicon_equals_plain_counts_and_finds_the_words(spark):
    rows = [*texts(1500), None, "", "no such text"]
    frame = spark.createDataFrame([(t,) for t in rows], "t string").repartition(3)
    lexicon = S.learn(frame, "t")
    assert lexicon.costs == plain_lexicon(rows)
    found = {w for w in lexicon.costs if len(w) > 1}
    assert set(WORDS) <= found and len(found) < 3 * len(WORDS)
    assert lexicon.words("负责数据分析和机器学习，用C++开发") == ["负责", "数据", "分析", "机器学习", "C++", "开发"]
    before, after = (S.whole_runs(frame, "t", w).first() for w in (words, S.segmenter(lexicon)))
    assert before["whole"] == before["tokens"] and after["whole"] < 0.2 * after["tokens"]


def test_keyword_rows(spark):
    lexicon = S.Lexicon({"数据": 1, "分析": 1, "师": 1}, 9)
    frame = spark.createDataFrame([("SQL, Go", "数据分析师负责 Java"), (None, None), ("", "的")], "skills string, description string")
    found = Counter(r["name"] for r in keyword_rows(frame, segmenter=S.segmenter(lexicon)).collect())
    assert found == Counter(["SQL", "Go", "数据", "分析", "Java"])


@pytest.mark.parametrize("rows", [[], [(None,)], [("abc",)]])
def test_nothing_to_learn(spark, rows):
    lexicon = S.learn(spark.createDataFrame(rows, "t string"), "t")
    assert lexicon.costs == {} and lexicon.words("数据 x") == ["x"]
    assert S.whole_runs(spark.createDataFrame([("数据",)], "t string"), "t", S.segmenter(lexicon)).select(
        F.coalesce("whole", F.lit(0))).first()[0] == 0
