import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake import schema
from hirelake.plans import dashboard as B
from hirelake.plans import standard as S
from hirelake.plans.quality import import_stats
from hirelake.sources import archive as A
from hirelake.sources import tables as T

HEADER = ",".join(V.STANDARD_COLUMNS)
ROWS = [
    '数据分析师,甲公司,杭州,10000,20000,本科,1-3年,互联网,"Python,SQL",数据分析',
    '数据分析师,甲公司,杭州,10000,20000,本科,1-3年,互联网,"Python,SQL",数据分析',
    "数据分析师,甲公司,杭州,3000,5000,大专,应届/无经验,互联网,Excel,",
    "运营专员,乙公司,上海,面议,,大专,未知,运营,,",
]


@pytest.fixture
def csv_file(tmp_path):
    def write(rows, encoding="utf-8-sig", header=HEADER, name="jobs.csv"):
        path = tmp_path / name
        path.write_bytes("\n".join([header, *rows]).encode(encoding))
        return str(path)

    return write


def test_cleaning_keeps_order_and_drops_duplicates(spark, csv_file):
    rows = S.ingest_csv(spark, csv_file(ROWS))
    assert rows.schema.simpleString() == schema.CLEAN_POSTING.simpleString()
    found = rows.orderBy("job_id").collect()
    assert [r["salary_low"] for r in found] == [10000.0, 3000.0]
    assert [r["job_id"] for r in found] == [1, 2]
    assert [r["avg_salary"] for r in found] == [15000.0, 4000.0]
    filtered = B.apply_filters(rows, {"city": "杭州", "min_salary": "10000"})
    assert filtered.count() == 1
    assert [r["name"] for r in B.options(rows).filter("dim = 'city'").collect()] == ["杭州"]
    assert B.job_by_id(rows, 2).first()["skills"] == "Excel"
    assert B.job_by_id(rows, 9).isEmpty()


def test_dashboard_parts(spark, csv_file):
    rows = S.ingest_csv(spark, csv_file(ROWS))
    parts = B.dashboard(rows, {}, "500")
    total = parts["summary"].first()
    assert (total["total_jobs"], total["avg_salary"], total["top_skill"]) == (2, 9500.0, "Excel")
    assert [r["value"] for r in parts["salary"].orderBy("ord").collect()] == [1, 0, 1, 0, 0, 0]
    assert [(r["name"], r["value"]) for r in parts["experience"].orderBy("ord").collect()] == [("应届/无经验", 1), ("1-3年", 1)]
    assert [r["name"] for r in parts["skills"].collect()] == ["Excel", "Python", "SQL"]
    assert "数据分析" in [r["name"] for r in parts["keywords"].collect()]
    assert parts["jobs"].count() == 2
    empty = B.summary(B.apply_filters(rows, {"keyword": "没有"})).first()
    assert (empty["total_jobs"], empty["avg_salary"], empty["top_skill"]) == (0, 0.0, "无")
    assert (B.clamp_limit("x"), B.clamp_limit("0"), B.clamp_limit(500)) == (10, 1, 100)


def test_header_only_file_has_all_columns(spark, csv_file):
    rows = S.clean(T.read_csv(spark, csv_file([])))
    assert rows.columns == V.CLEAN_COLUMNS and rows.isEmpty()
    with pytest.raises(T.NoUsableRows):
        S.ingest_csv(spark, csv_file([ROWS[3]]))


def test_other_suffix_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError):
        S.ingest_csv(spark, "jobs.xlsx")
    with pytest.raises(AnalysisException):
        S.ingest_csv(spark, str(tmp_path / "none.csv"))


def test_gb18030_and_header_spellings(spark, csv_file):
    path = csv_file(['Java,甲,"北京\n朝阳",15-20k,NA'], "gb18030", "职位名称,公司名称,工作地点,薪资,行业")
    row = S.ingest_csv(spark, path).first()
    assert (row["job_name"], row["city"], row["salary_low"], row["salary_high"]) == ("Java", "北京\n朝阳", 15000.0, 20000.0)
    assert (row["category"], row["education"], row["skills"]) == ("未知", "未知", "")


def test_encoding_is_chosen_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("job_name,salary_low,city\n护士,8千,杭州\n".encode())
    (tmp_path / "b c%.csv").write_bytes("job_name,salary_low,city\n会计,9千,北京\n".encode("gb18030"))
    rows = S.clean(T.read_csv(spark, str(tmp_path))).collect()
    assert {(r["job_name"], r["city"]) for r in rows} == {("护士", "杭州"), ("会计", "北京")}


def test_standard_csv_round_trip(spark, csv_file, tmp_path):
    rows = S.ingest_csv(spark, csv_file(ROWS))
    target = str(tmp_path / "out")
    T.write_standard(rows, target, "job_id")
    again = S.clean(T.read_csv(spark, target))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    B.export_rows(rows, {"education": "大专"}, str(tmp_path / "export"))
    exported = spark.read.option("header", True).csv(str(tmp_path / "export"))
    assert exported.columns == list(V.EXPORT_HEADERS.values()) and exported.count() == 1


@pytest.fixture
def archive(tmp_path):
    def write(**files):
        for name, content in files.items():
            path = tmp_path / "archive" / name.split("__")[0] / f"{name.split('__')[1]}.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            if isinstance(content, bytes):
                path.write_bytes(content)
            else:
                path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), "utf-8")
        return str(tmp_path / "archive")

    return write


FIRST = {"keyword": "Python", "city": "杭州", "jobs": [{"job_id": "job-1", "title": "数据分析师"}]}
SECOND = {"keyword": "数据分析", "city": "上海", "jobs": [{"job_id": "job-1", "skills": "SQL"}]}


def test_strict_reading(spark, archive):
    files = A.read_files(spark, archive(a__boss_jobs_first=FIRST, a__boss_jobs_second=SECOND))
    rows = A.strict_postings(files)
    assert rows.groupBy("job_id").count().first()["count"] == 2
    assert {(r["keyword"], r["batch_city"]) for r in rows.collect()} == {("Python", "杭州"), ("数据分析", "上海")}


@pytest.mark.parametrize("content", ["{ invalid json", {"jobs": "not-a-list"}, {"jobs": [None]}, "3", b'{"jobs":["\xff"]}', {}])
def test_strict_reading_refuses(spark, archive, content):
    path = archive(a__boss_jobs_good=FIRST, b__boss_jobs_bad=content)
    with pytest.raises(A.UnusableArchive, match="boss_jobs_bad"):
        A.strict_postings(A.read_files(spark, path))
    assert A.read_postings(spark, path).count() == 1  # the tolerant reader goes on


@pytest.mark.parametrize(("content", "titles"), [
    ('{"jobs": [{"title": "a", "title": "b"}]}', ["b"]),
    ('{"n": NaN, "m": [-Infinity, Infinity], "jobs": [{"title": "is NaN, \\\\" NaN"}]}', ['is NaN, " NaN']),
    ('  [{"title": "x"}]\\n', ["x"]),
    ('{"jobs": [{"title": "a"}]} trailing', None),
    ('{"jobs": [{"title": "a"}]}}', None),
    ('{"jobs": [{"title": "a"}]}, {}', None),
])
def test_json_is_read_as_one_value(spark, content, titles):
    files = spark.createDataFrame([("p", content.encode().decode("unicode_escape"))], "path string, content string")
    assert [r["title"] for r in A.postings(files).collect()] == (titles or [])
    assert [r["reason"] for r in A.problems(files).collect()] == ([] if titles else ["unreadable"])


def test_every_bad_file_is_listed(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"boss_jobs_{i}.json").write_text("{")
    with pytest.raises(A.UnusableArchive, match="120 batch files") as caught:
        A.strict_postings(A.read_files(spark, str(tmp_path)))
    assert spark.read.parquet(caught.value.problems).count() == 120


def test_strict_reading_needs_files(spark, archive):
    with pytest.raises(A.UnusableArchive):
        A.strict_postings(A.read_files(spark, archive(a__other=FIRST)))


def job(i, **more):
    return {"job_id": f"id-{i}", "title": "Java", "boss_name": "甲", "location": "杭州·滨江", "salary": f"{i}-20K",
            "tags": "1-3年 | 本科", "skills": "Java | SQL", "company_industry": "互联网", **more}


def test_import_end_to_end(spark, archive):
    path = archive(
        a__boss_jobs_20260101_1200={"keyword": "k", "city": "北京", "jobs": [job(1), job(2, salary="面议"), job(3, location="")]},
        a__boss_details_20260101_1200=[{"job_id": "id-1", "company": "详", "jd": " 旧 "}, {"job_id": "id-1", "company": "", "jd": "新\n文"}],
        a__boss_details_20260109_1200={"details": [{"job_id": "id-1", "jd": "错"}]},
        b__boss_jobs_x=[job(1), job(4)],
        c__boss_jobs_empty={"keyword": "e", "city": "", "jobs": []},
    )
    rows, stats = S.import_archive(spark, path)
    found = {r["job_id"]: r for r in rows.collect()}
    assert set(found) == {"id-1", "id-3", "id-4"}
    assert (found["id-1"]["description"], found["id-1"]["company"]) == ("新 文", "甲")
    assert found["id-3"]["city"] == "北京"
    per_batch = {r["batch_path"].rsplit("/", 1)[1]: r for r in stats.collect()}
    first = per_batch["boss_jobs_20260101_1200.json"]
    assert (first["raw"], first["converted"], first["skipped_no_salary"], first["with_jd"]) == (3, 2, 1, 1)
    assert per_batch["boss_jobs_empty.json"]["raw"] == 0
    only, _ = S.import_archive(spark, path, city="北京")
    assert [r["job_id"] for r in only.collect()] == ["id-3"]


def test_strict_merge_writes_only_a_sound_archive(spark, archive, tmp_path):
    job = {"job_id": "1", "title": "护士", "salary": "8-9K", "location": "杭州", "boss_name": "甲"}
    out = str(tmp_path / "merged")
    path = archive(a__boss_jobs_good={"keyword": "k", "city": "c", "jobs": [job, job]}, b__boss_jobs_bad="{")
    with pytest.raises(A.UnusableArchive, match="boss_jobs_bad"):
        S.merge_archive(spark, path, out)
    assert not (tmp_path / "merged").exists()
    (tmp_path / "archive" / "b" / "boss_jobs_bad.json").write_text('{"keyword": "q", "jobs": []}', "utf-8")
    rows, overview, parts = S.merge_archive(spark, path, out)
    assert rows.count() == spark.read.option("header", True).csv(out).count() == 1
    figures = overview.first()
    assert (figures["keywords"], figures["cities"], figures["raw_with_id"], figures["final"]) == (2, 2, 2, 1)
    assert {(r["name"], r["value"]) for r in parts.filter("section = 'total'").collect()} >= {("rows", 1.0), ("mean_low", 8000.0)}


def test_pairing_takes_the_stamp_then_the_last(spark):
    jobs = spark.createDataFrame([("x/a/boss_jobs_20260101_1200.json",), ("x/a/boss_jobs_new.json",), ("x/b/boss_jobs_1.json",)],
                                 "path string")
    details = spark.createDataFrame([("x/a/boss_details_20260101_120059.json",), ("x/a/boss_details_20260101_1200.json",),
                                     ("x/a/boss_details_9.json",)], "path string")
    found = {r["batch_path"]: r["detail_path"] for r in A.pair_details(jobs, details).collect()}
    assert found == {"x/a/boss_jobs_20260101_1200.json": "x/a/boss_details_20260101_1200.json",
                     "x/a/boss_jobs_new.json": "x/a/boss_details_9.json", "x/b/boss_jobs_1.json": None}


def test_consolidation_keeps_earlier_versions_as_input(spark, archive, tmp_path):
    path = archive(a__boss_jobs_1={"keyword": "k", "city": "c", "jobs": [job(1, skills="", jd="短"), job(5)]},
                   a__boss_details_1=[{"job_id": "id-1", "jd": "更长的描述"}])
    root = str(tmp_path / "out")
    first = S.publish_consolidated(spark, path, root)
    manifest = spark.read.parquet(first["manifest"]).first()
    assert (manifest["raw_records"], manifest["unique_jobs"], manifest["valid_rows"], manifest["jobs_with_jd"]) == (2, 2, 2, 1)
    sources = {tuple(r) for r in spark.read.parquet(first["provenance"]).collect()}
    assert ("id-1", "c|k|a") in sources
    other = str(tmp_path / "later")
    (tmp_path / "later").mkdir()
    (tmp_path / "later" / "boss_jobs_2.json").write_text(json.dumps({"jobs": [job(1, tags="")]}), "utf-8")
    second = S.publish_consolidated(spark, other, root)
    records = spark.read.parquet(second["records"])
    assert sorted(r["job_id"] for r in records.collect()) == ["id-1", "id-5"]
    assert records.filter("job_id = 'id-1'").first()["jd"] == "更长的描述"
    assert T.latest(spark, root, "records") .endswith(second["records"].rsplit("/", 1)[1])


def test_city_codes_and_ledger(spark, tmp_path):
    (tmp_path / "codes.json").write_text('{\n "全国": "100010000",\n "北京": "101010100"}', "utf-8")
    codes = T.city_codes(spark, str(tmp_path / "codes.json"))
    assert [tuple(r) for r in codes.collect()] == [("北京", "101010100")]
    assert T.city_codes(spark, str(tmp_path / "codes.json"), True).count() == 2
    ledger = {"combos": {"佛山|ops": {"status": "done", "raw": 45, "new": 45, "runs": 1}, "佛山|ops|exp103": {"status": "failed"}},
              "runs": [{"at": "2026", "raw": 3, "new_jobs": 2}]}
    (tmp_path / "ledger.json").write_text(json.dumps(ledger), "utf-8")
    combos, runs = T.read_ledger(spark, str(tmp_path / "ledger.json"))
    assert {(r["city"], r["family_id"], r["slice_id"], r["status"], r["raw"]) for r in combos.collect()} == {
        ("佛山", "ops", "", "done", 45), ("佛山", "ops", "exp103", "failed", None)}
    assert runs.first()["new_jobs"] == 2
    root = str(tmp_path / "ledger")
    T.publish_ledger(combos, runs, root)
    T.publish_ledger(spark.read.parquet(T.latest(spark, root, "combos")).filter("status = 'done'"), runs, root)
    assert spark.read.parquet(T.latest(spark, root, "combos")).count() == 1
    (tmp_path / "broken.json").write_text("{", "utf-8")
    for name in ("broken.json", "missing.json"):
        combos, runs = T.read_ledger(spark, str(tmp_path / name))
        assert combos.isEmpty() and runs.isEmpty()


def test_flattened_response(spark):
    body = {"zpData": {"jobList": [{"jobName": "Java", "salaryDesc": "1K", "cityName": "杭州", "jobExperience": "不限", "jobDegree": "本科",
                                    "skills": ["a", "b"], "encryptJobId": "e1", "bossOnline": True}, None, 3]}}
    rows = A.flatten_responses(spark.createDataFrame([(json.dumps(body),), ('{"zpData":{"jobList":3}}',)], "body string"))
    row = rows.first()
    assert rows.count() == 1
    assert (row["location"], row["tags"], row["skills"], row["boss_active_status"]) == ("杭州··", "本科", "a | b", "在线")
    assert row["job_link"] == "https://www.zhipin.com/job_detail/e1.html" and len(row["job_id"]) == 16
    assert row["salary_source"] == "api"


def test_export_layouts(spark):
    rows = spark.createDataFrame([("1", None)], "job_id string, title string")
    assert T.export_list(rows).columns == V.LIST_EXPORT_COLUMNS
    assert T.export_list(rows).first()["title"] == ""
    details = rows.withColumn("skill_tags", F.array(F.lit("a"), F.lit("b")))
    assert T.export_details(details).first()["skill_tags"] == "a | b"


def test_batches_without_postings_count_as_zero(spark):
    batch_table = spark.createDataFrame([("p", None, None)], "batch_path string, keyword string, batch_city string")
    nothing = spark.createDataFrame([], "batch_path string, description string")
    row = import_stats(nothing, nothing, batch_table).first()
    assert (row["raw"], row["converted"], row["skipped_no_salary"], row["keyword"]) == (0, 0, 0, "")


def test_schemas_of_the_tables(spark, archive):
    path = archive(a__boss_jobs_1=FIRST, a__boss_details_1=[{"job_id": "job-1", "skill_tags": ["a"]}])
    rows, details = A.read_postings(spark, path), A.read_details(spark, path)
    kinds = dict(rows.dtypes)
    assert {f.name: f.dataType.simpleString() for f in schema.RAW_POSTING}.items() <= kinds.items()
    assert kinds["pos"] == schema.POSITION.simpleString() == dict(details.dtypes)["pos"]
    assert {f.name: f.dataType.simpleString() for f in schema.DETAIL}.items() <= dict(details.dtypes).items()
    assert details.first()["skill_tags"] == ["a"]


def test_filter_codes(spark):
    codes = T.filter_codes(spark)
    assert codes.filter("domain = 'scale' and code = '301'").first()["label"] == "0-20人"
    assert codes.count() == codes.select("domain", "code").distinct().count()
