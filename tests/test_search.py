import random

from pyspark.sql import functions as F

from hirelake.plans import dashboard as B
from hirelake.plans import search as S

SCHEMA = "n long, job_name string, company string, category string, skills string, description string"


def table(seed, count):
    draw = random.Random(seed)
    parts = ["Java", "c++", "数据", "分析师", "ß", "É", " ", "\n", "x", "\0", "😀", "Go", "%", "_"]

    def text(k):
        own = [f"w{k // 10}é", *parts]
        return draw.choice([None, "", "".join(draw.choice(own) for _ in range(draw.randrange(1, 6)))])

    return [(k, *(text(k) for _ in range(5))) for k in range(count)]


def test_equals_the_full_scan(spark, tmp_path):
    rows = spark.createDataFrame(table(1, 200), SCHEMA).withColumns({c: F.lit("") for c in B.DIMENSIONS if c != "category"})
    version = S.publish(rows.repartitionByRange(20, "n"), str(tmp_path), "served")
    draw = random.Random(2)
    words = ["", " ", "j", "JAVA", "c++", "数", "据分", "ss", "ẞ", "é", "w7É", "W1", "😀g", "no such text", "%", "_", "a\nx", "\0",
             *("".join(draw.choice(["a", "数", "v", "据", "分", "+", "é", "W", "1"]) for _ in range(draw.randrange(1, 4))) for _ in range(4))]
    pruned = 0
    for word in words:
        wanted = sorted(r["n"] for r in B.apply_filters(rows, {"keyword": word}).collect())
        assert sorted(r["n"] for r in S.search(spark, version, {"keyword": word}).collect()) == wanted, word
        files = S.candidates(spark, version, word)
        pruned += files is not None and len(files) < 20
    assert pruned > 10
    assert len(S.candidates(spark, version, "w7é")) <= 2 and S.candidates(spark, version, "no such text") == []


def test_other_filters_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame(table(3, 40), SCHEMA).withColumns({"city": F.when(F.col("n") % 2 == 0, "a"), "avg_salary": F.col("n") * 1.0})
    version = S.publish(rows, str(tmp_path), "served")
    params = {"keyword": "java", "city": "a", "min_salary": "10"}
    assert sorted(map(str, S.search(spark, version, params).collect())) == sorted(map(str, B.apply_filters(rows, params).collect()))
    version = S.publish(rows.limit(0), str(tmp_path), "empty")
    assert S.search(spark, version, {"keyword": "x"}).collect() == []
