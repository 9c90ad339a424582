import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.operators import dedupe as D
from hirelake.operators import merge as M
from hirelake.operators import ranking as R
from hirelake.operators import skew
from hirelake.plans import coverage as C
from hirelake.plans import quality as Q

STD = "pos int, job_id string, job_name string, company string, city string, salary_low double, salary_high double"


def std_row(pos, job_id, low):
    return (pos, job_id, "t", "c", "x", float(low), float(low) + 1000)


def sequential(rows):
    ids, keys, kept = set(), set(), []
    for row in sorted(rows):
        if (row[1] and row[1] in ids) or row[2:] in keys:
            continue
        if row[1]:
            ids.add(row[1])
        keys.add(row[2:])
        kept.append(row[0])
    return kept


def test_greedy_dedupe_fixture(spark):
    rows = [std_row(1, "id-1", 10000), std_row(2, "id-1", 12000), std_row(3, "id-2", 10000), std_row(4, "id-3", 20000)]
    kept = D.dedupe_greedy(spark.createDataFrame(rows, STD))
    assert sorted(r["pos"] for r in kept.collect()) == [1, 4]
    rows = [std_row(1, "1", 1), std_row(2, "2", 1), std_row(3, "2", 2)]  # a dropped row blocks nothing
    assert sorted(r["pos"] for r in D.dedupe_greedy(spark.createDataFrame(rows, STD)).collect()) == [1, 3]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6), hot=st.sampled_from([2, 10**6]), rounds=st.sampled_from([0, 1, 99]),
       settled=st.sampled_from([3, 10**6]))
def test_greedy_dedupe_equals_the_sequential_rule(spark, seed, hot, rounds, settled):
    rng = random.Random(seed)
    rows = [std_row(i, rng.choice(["", None, *"abcdefgh"]), rng.choice([1, 2, 3, 4, 5, 6])) for i in range(60)]
    kept = D.dedupe_greedy(spark.createDataFrame(rows, STD), hot_rows=hot, first_rounds=rounds, settled_rows=settled)
    assert sorted(r["pos"] for r in kept.collect()) == sequential(rows)


def test_greedy_dedupe_follows_a_long_chain(spark):
    # Each row shares its id with the row before and its key with the row after.
    rows = [std_row(i, f"id{i // 2}", (i + 1) // 2) for i in range(1000)]
    for settled in (10_000, 999, 100):  # as a whole, as one group, or round by round
        kept = D.dedupe_greedy(spark.createDataFrame(rows[:300] if settled == 100 else rows, STD), settled_rows=settled,
                               first_rounds=2 if settled > 100 else 0)
        assert sorted(r["pos"] for r in kept.collect()) == sequential(rows[:300] if settled == 100 else rows)


def test_a_hot_key_is_spread(spark):
    left = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", 1), (None, 2)], "k string, pos int")
    right = spark.createDataFrame([("hot", 7), ("cold", 8), ("none", 9)], "k string, v int")
    hot = skew.hot_keys(left, ["k"], 100)
    assert [tuple(r)[1] for r in hot.collect()] == [10]  # as many salts as the key's rows ask for
    assert skew.hot_keys(left, ["k"], 10_000) is None
    joined = skew.salted_left_join(left, right, ["k"], ["pos"], hot)
    assert joined.count() == 1002
    assert joined.groupBy("k").agg(F.sum("v").alias("s")).filter("k = 'hot'").first()["s"] == 7000
    assert joined.filter("k is null").first()["v"] is None


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 37 % 1009,) for i in range(1009)], "v int").repartition(7)
    numbered = R.number_rows(rows, ["v"], "n").collect()
    assert [r["n"] for r in sorted(numbered, key=lambda r: r["v"])] == list(range(1, 1010))


RAW = "pos int, job_id string, title string, salary string, location string, tags string, company_industry string, skills string"


def test_best_snapshot_is_completed_but_placeholders_stay(spark):
    rows = [
        (1, " a ", "T", "", "杭州", "x", "i", ""),
        (2, "a", "T2", "-", "", "", "", "s"),
        (3, "a", "", "面议", "上海", "tttt", "i3", "sql"),
        (4, "a", "", "9K", "", "", "", ""),
        (5, "", "lost", "1K", "", "", "", ""),
    ]
    best = M.best_snapshots(spark.createDataFrame(rows, RAW)).collect()
    assert len(best) == 1
    row = best[0]
    assert row["salary"] == "面议"  # row 3 is best; a placeholder of the best row is not repaired
    assert row["title"] == "T" and row["snapshots"] == 4 and row["pos"] == 1
    first = M.best_snapshots(spark.createDataFrame([rows[0], (9, "a", "T", "", "杭州", "y", "i", "")], RAW)).first()
    assert first["tags"] == "x" and first["salary"] == ""


def test_longest_description_wins_and_the_first_on_a_tie(spark):
    own = spark.createDataFrame([(1, "a", "12"), (2, "a", " 34 "), (3, "b", "")], "pos int, job_id string, jd string")
    details = spark.createDataFrame([(1, "a", "56"), (2, "c", "789")], "pos int, job_id string, jd string")
    found = {r["job_id"]: r["jd"] for r in M.longest_descriptions(own, details).collect()}
    assert found == {"a": "12", "c": "789"}


def test_upserts(spark):
    kind = "pos int, job_id string, v string"
    old = spark.createDataFrame([(1, "a", "o1"), (2, "a", "o2"), (3, None, "o3")], kind)
    new = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2"), (3, "b", "n3"), (4, "", "n4")], kind)
    assert sorted(r["v"] for r in D.upsert_keep(old, new).collect()) == ["n2", "o1", "o2", "o3"]
    merged = D.upsert_override(old, new).orderBy("pos").collect()
    assert [(r["job_id"], r["v"]) for r in merged] == [("a", "n1"), ("b", "n3")]


def test_counts_break_ties_by_name(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    assert [r["name"] for r in R.value_counts(rows, F.col("v"), 2).collect()] == ["c", "a"]


def test_yield_counts_rows_without_id_in_the_denominator(spark):
    rows = spark.createDataFrame([("a", "k", "c"), ("a", "k", "c"), ("", "k", "c"), ("b", "j", None), ("", "z", "c")],
                                 "job_id string, keyword string, batch_city string")
    found = {r["name"]: (r["records"], r["distinct_ids"], r["yield_pct"]) for r in Q.yield_by(rows, "keyword").collect()}
    assert found == {"k": (3, 1, 33.3), "j": (1, 1, 100.0)}
    assert Q.yield_by(rows, "batch_city").filter("name = '?'").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_batch_yield_equals_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(8), rng.choice(["", *map(str, range(25))])) for _ in range(120)]
    info = [(b, int(rng.random() < 0.3)) for b in range(9)]
    known, wanted = set(), {}
    for batch, code in info:
        ids = {i for b, i in rows if b == batch and i}
        fresh = ids - known
        raw = sum(b == batch for b, _ in rows)
        wanted[batch] = (raw, len(fresh), max(0, raw - len(fresh)), "failed" if code else "done" if fresh else "saturated")
        known |= set() if code else fresh
    got = C.batch_yield(spark.createDataFrame(rows, "batch_no int, job_id string"),
                        spark.createDataFrame(info, "batch_no int, exit_code int"), 1)
    assert {r["batch_no"]: (r["raw"], r["new"], r["dup"], r["status"]) for r in got.collect()} == wanted
    assert all(r["truncated"] == (r["raw"] >= V.ROWS_PER_PAGE) for r in got.collect())


def coverage_frames(spark, cities, counts, combos=()):
    from hirelake import schema

    kinds = "kind string, city string, family_id string, n long"
    return (spark.createDataFrame([(c,) for c in cities], "city string"), spark.createDataFrame(counts, kinds),
            spark.createDataFrame([{**dict.fromkeys(schema.COMBOS.fieldNames()), "slice_id": "", **c} for c in combos],
                                  schema.COMBOS))


def test_published_scores(spark):
    heavy = [n for names, _w in V.CITY_TIERS.values() for n in names]
    # 371 cities of total weight 503
    cities = [c for c in heavy if c != "襄樊"]
    cities += [f"市{i}" for i in range(371 - len(cities))]
    counts = [("city", c, None, 2) for c in ("惠州", "温州", "盐城")]
    counts += [("family", None, f, n) for f, n in (("frontend", 282), ("medical", 91), ("data", 93))]
    frames = coverage_frames(spark, cities, counts)
    total = C.city_quotas(frames[0], 25000).groupBy().sum("weight").first()[0]
    scores = {(r["city"], r["family_id"]): r["score"] for r in C.coverage_scores(*frames).collect()}
    wanted = {("惠州", "frontend"): 1.098924, ("温州", "medical"): 1.085335, ("盐城", "data"): 1.083301}
    for cell, score in wanted.items():
        assert scores[cell] == pytest.approx(score, abs=2e-6 if total == 503 else 5e-3), total


def test_blocked_cells(spark):
    counts = [("city", "北京", None, 50), ("cell", "北京", "ai", 8), ("cell", "北京", "hr", 7), ("family", None, "ai", 8)]
    combos = [{"city": "北京", "family_id": "ops", "status": "saturated", "runs": 1},
              {"city": "北京", "family_id": "sales", "status": "done", "runs": 1},
              {"city": "全国", "family_id": "ai", "status": "failed", "runs": 1}]
    frames = coverage_frames(spark, ["北京", "丽江", "全国"], counts, combos)
    got = {(r["city"], r["family_id"]): r for r in C.coverage_scores(*frames).collect()}
    assert got["北京", "ops"]["block_reason"] == "历史零新增，已拉黑" and got["北京", "ops"]["score"] == 0
    assert got["北京", "sales"]["block_reason"] == "账本记录已抓过" and got["北京", "sales"]["skip_base"]
    assert got["北京", "ai"]["block_reason"] == "归档已有 8 条"
    assert got["北京", "hr"]["block_reason"] is None and got["北京", "hr"]["open"] == 2
    assert got["全国", "ai"]["score"] == pytest.approx(2.0 * 1.15 * 12 ** 0.5 / 3.5 * (1 - 8 / (25000 * 1.15 / 18.35)), abs=1e-6)
    deep = {(r["city"], r["family_id"]): r for r in C.coverage_scores(*frames, strategy="depth").collect()}
    assert deep["丽江", "ai"]["block_reason"] == "depth 策略跳过 0 数据城市"
    assert deep["全国", "hr"]["score"] == 0
    assert C.depth_scope(frames[0], frames[1]).count() == 1
    assert C.depth_scope(frames[0], frames[1].filter("n > 999")).count() == 3


def test_a_cell_in_ledger_and_archive_counts_twice(spark):
    frames = coverage_frames(spark, ["北京"], [("cell", "北京", "ai", 8)],
                             [{"city": "北京", "family_id": "ai", "status": "done", "runs": 2}])
    assert C.families_open(frames[2], frames[1]).first()["open"] == 3


@pytest.mark.parametrize("cities, keywords", [(3, 5), (5, 3), (4, 4), (1, 2)])
def test_grid_order_is_the_diagonal_walk(spark, cities, keywords):
    words, names = [f"k{i}" for i in range(keywords)], [f"c{i}" for i in range(cities)]
    walk = []
    for offset in range(max(keywords, cities)):
        for i, word in enumerate(words):
            if (word, names[(offset + i) % cities]) not in walk:
                walk.append((word, names[(offset + i) % cities]))
    frame = spark.createDataFrame(list(zip(names, range(cities), strict=True)), "city string, city_no int")
    grid = C.combo_grid(frame, words).orderBy("place").collect()
    assert [(r["keyword"], r["city"]) for r in grid] == walk
    done = spark.createDataFrame(walk[:1], "keyword string, city string")
    pending = C.pending_combos(C.combo_grid(frame, words), done, 1).first()
    assert (pending["keyword"], pending["city"]) == walk[1]


def test_city_resolution(spark):
    codes = spark.createDataFrame([("北京", "101010100")], "city string, code string")
    inputs = spark.createDataFrame([("北京",), ("101010100",), ("123456789",), ("火星",), ("",)], "input string")
    got = {r["input"]: (r["city"], r["code"], r["resolved"]) for r in C.resolve_cities(inputs, codes).collect()}
    assert got == {"北京": ("北京", "101010100", True), "101010100": ("北京", "101010100", True),
                   "123456789": ("123456789", "123456789", True), "火星": (None, None, False), "": ("", "", True)}


def test_next_slices(spark):
    _c, _n, combos = coverage_frames(spark, [], [], [
        {"city": "a", "family_id": "ai", "status": "done", "truncated": True},
        {"city": "a", "family_id": "ai", "slice_id": "exp108", "status": "saturated"},
        {"city": "a", "family_id": "ai", "slice_id": "exp103", "status": "failed"},
        {"city": "b", "family_id": "ai", "status": "done", "truncated": False},
    ])
    got = C.next_slices(combos, limit=2).orderBy("rank").collect()
    assert [(r["city"], r["slice_id"]) for r in got] == [("a", "exp103"), ("a", "exp104")]


def test_coverage_counts_take_an_id_once(spark):
    rows = spark.createDataFrame([(1, "a", "杭州·x", "Java"), (2, "a", "北京", "护士"), (3, "", "", "护士"), (4, None, None, "护士")],
                                 "pos int, job_id string, location string, title string")
    got = {(r["kind"], r["city"], r["family_id"]): r["n"] for r in C.coverage_counts(rows).collect()}
    assert got == {("city", "杭州", None): 1, ("city", "未知", None): 2, ("family", None, "backend"): 1,
                   ("family", None, "medical"): 2, ("cell", "杭州", "backend"): 1, ("cell", "未知", "medical"): 2}


def test_markdown_report(spark):
    cities, counts, combos = coverage_frames(spark, ["北京", "香港"], [
        ("city", "北京", None, 30), ("city", "未知", None, 5), ("family", None, "ai", 30)])
    text = "\n".join(C.report_markdown(C.coverage_report(cities, counts, combos)))
    assert "| 1 | 中国香港 | 0 | 空白 |" in text and "| 2 | 北京 | 30 | 已覆盖 |" in text
    head = C.report_head(cities, counts, combos).first()
    assert (head["postings"], head["filled_cities"], head["blank_cities"], head["cities"]) == (35, 2, 1, 2)
    assert "共 1 座：香港" in text
    assert text.count("\n| ") >= len(V.FAMILIES)


def test_report_ledger_is_complete(spark):
    cities, counts, combos = coverage_frames(spark, ["北京"], [("city", "北京", None, 1)])
    rows = [(f"c{i}", "ai", "") for i in range(1500)]
    many = spark.createDataFrame(rows, "city string, family_id string, slice_id string")
    listed = combos.unionByName(many, allowMissingColumns=True)
    lines = list(C.report_markdown(C.coverage_report(cities, counts, listed)))
    assert sum(line.startswith("| c") for line in lines) == 1500
