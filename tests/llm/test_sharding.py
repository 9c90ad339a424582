import random
import zlib
from collections import Counter, defaultdict

import pytest

from hirelake.llm import sharding
from hirelake.llm.registry import LLM_QUERIES
from hirelake.session import Scratch
from tests.llm.brute import texts


def run(spark, rows, schema="doc_id long, text string", **options):
    scratch = Scratch(spark, "t")
    found = [r.asDict() for r in sharding.shard(spark.createDataFrame(rows, schema), scratch, **options).collect()]
    scratch.drop()
    return found


def check_law(rows, found, shards):
    assert sorted((repr(r["id"]), r["size"], r["crc"]) for r in found) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def cut(found):
    """Pairs of equal texts in different shards."""
    groups = defaultdict(Counter)
    for r in found:
        groups[r["crc"], r["size"]][r["shard"]] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())


@pytest.mark.parametrize("task_rows", [7, 100_000])
def test_groups_stay_together_where_they_fit(spark, task_rows):
    draw = random.Random(1)
    rows = [(i, f"single {i}") for i in range(300)] + [(1000 + i, f"text {draw.randrange(40)}") for i in range(150)]
    draw.shuffle(rows)
    found = run(spark, rows, shards=4, task_rows=task_rows)
    check_law(rows, found, 4)
    assert cut(found) == 0


def test_all_linked_and_no_room_to_spare(spark):
    rows = [(i, f"pair {i // 2}") for i in range(400)]
    found = run(spark, rows, shards=4)
    check_law(rows, found, 4)
    # By chance three quarters of the 200 pairs would be cut.
    assert cut(found) < 40


def test_group_larger_than_a_shard(spark):
    rows = [(i, "copy") for i in range(200)] + [(500 + i, f"t{i // 3}") for i in range(90)] + [(900 + i, f"s{i}") for i in range(31)]
    found = run(spark, rows, shards=5, task_rows=20)
    check_law(rows, found, 5)
    copies = Counter(r["shard"] for r in found if r["size"] == 5)
    by_chance = 200 * 199 // 2 * 4 // 5
    assert (200**2 - sum(n * n for n in copies.values())) // 2 < by_chance


@pytest.mark.parametrize("count", [0, 1, 5, 33])
def test_few_rows_and_odd_texts(spark, count):
    rows = list(enumerate(texts(count, 3)))
    check_law(rows, run(spark, rows), 16)


def test_nulls_repeats_keys_and_other_columns(spark):
    rows = [(None, "a", "k", 1), (None, "a", "k", 1), (4, None, None, 2), (5, "", "k", 2), (4, "b" * 100_000, None, 2)]
    found = run(spark, rows, "doc_id long, text string, key string, shard int", shards=3)
    check_law([r[:2] for r in rows], found, 3)
    by_key = run(spark, rows, "doc_id long, text string, key string, shard int", shards=1, key_col="key")
    check_law([r[:2] for r in rows], by_key, 1)


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = [r.asDict() for r in LLM_QUERIES["op6_sharding"](spark, folder).collect()]
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}
    renamed = [{**r, "id": r["doc_id"], "crc": r["text_crc32"]} for r in found]
    check_law(rows, renamed, 16)
    assert cut(renamed) <= 2
