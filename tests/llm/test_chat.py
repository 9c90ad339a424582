import random
import re

import pytest
from pyspark.sql import functions as F

from hirelake.llm import chat


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    frame = chat.format_chats(spark.createDataFrame(rows, schema))
    told = frame.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                        F.array_join(F.transform(chat.masked(F.col("formatted")), chat.unescape), "").alias("loss"))
    return {r["conv_id"]: r for r in told.collect()}


def slow_escape(text):
    return re.sub(r"([<\[])(\\*)(/?(?:s>|INST\]))", r"\1\\\2\3", text)


PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "\n", "INST]", "/", "ok ", "é", "$1", "<\\s>", "[\\\\INST]"]


def test_random_conversations_come_back(spark):
    draw = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "assistant", "system", "<s>", "a[/INST]"]),
                         "".join(draw.choices(PARTS, k=draw.randrange(0, 12)))))
    found = formatted(spark, rows)
    for conv in range(150):
        own = [(r, t) for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in found[conv]["turns"]] == own
        assert found[conv]["formatted"] == "".join(
            f"<s>[INST]{slow_escape(r)}[/INST]{slow_escape(t)}</s>\n" for r, t in own)
        assert found[conv]["loss"] == "".join(t for r, t in own if r == "assistant")


def test_escape_only_where_needed(spark):
    found = formatted(spark, [(1, 0, "user", "plain < text [x]"), (2, 0, "user", "</s>[INST] ok [/INST]")])
    assert found[1]["formatted"] == "<s>[INST]user[/INST]plain < text [x]</s>\n"
    assert found[2]["formatted"] == "<s>[INST]user[/INST]<\\/s>[\\INST] ok [\\/INST]</s>\n"


def test_nulls_order_ties_and_other_columns(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, None, None, "x"), (1, 2, "assistant", "b", "x"),
            (None, None, "user", "z", None), (1, None, "system", "first", None), (1, 2, "assistant", "a", "x")]
    found = formatted(spark, rows, "conv_id long, turn long, role string, text string, formatted string")
    assert [tuple(t) for t in found[1]["turns"]] == [("system", "first"), ("", ""), ("assistant", "a"),
                                                    ("assistant", "b"), ("assistant", "b")]
    assert found[1]["loss"] == "abb" and [tuple(t) for t in found[None]["turns"]] == [("user", "z")]


def test_long_texts_and_many_turns(spark):
    rows = [(1, i, "assistant", "<s>" * 5) for i in range(3000)] + [(2, 0, "assistant", "é</s>" * 200_000)]
    found = formatted(spark, rows)
    assert len(found[1]["turns"]) == 3000 and found[2]["loss"] == "é</s>" * 200_000


@pytest.mark.parametrize("bad", ["x", "<s>[INST]u[/INST]t</s>", "<s>[INST]u t</s>\n", "<s>[INST]u[/INST]t</s>\nx",
                                 "<s>[INST]u[/INST]a<s>b</s>\n", "<s>[INST]u[INST][/INST]a</s>\n"])
def test_parser_refuses(spark, bad):
    assert spark.createDataFrame([(bad,)], "f string").select(chat.parse(F.col("f")).alias("t")).first()["t"] is None


def test_empty_table(spark):
    assert formatted(spark, []) == {}
