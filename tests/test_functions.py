import pytest
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions import labels as L
from hirelake.functions import pages as P
from hirelake.functions import salary as S
from hirelake.functions import text as X
from hirelake.functions import tokens as K


def test_whitespace_is_what_python_strips():
    assert set(V.WHITESPACE) == {chr(i) for i in range(0x3001) if chr(i).isspace()}


@pytest.mark.parametrize("given, wanted", [
    ("　甲公司\xa0", "甲公司"), ("  ", "未知"), (None, "未知"), ("nan", "未知"), ("None", "未知"), ("\x1c x", "x"), ("none", "none"),
])
def test_safe_text(value, given, wanted):
    assert value(X.safe_text(F.col("c")), c=given) == wanted


@pytest.mark.parametrize("given, low, high", [
    ("1.5-2万", 15000.0, 20000.0), ("300-500元/天", 6525.0, 10875.0), ("面议", None, None),
    ("15-30K", 15000.0, 30000.0), ("30-60K·15薪", 30000.0, 60000.0), ("50元/时", 8700.0, 8700.0),
    ("8千-1.2万", 12000.0, 80000.0),  # one unit serves both ends
    ("30-15K", 15000.0, 30000.0), ("8000-12000", 8000.0, 12000.0), ("", None, None), (None, None, None),
    ("薪资面议", None, None), ("10～20k", 10000.0, 20000.0), ("10至20千", 10000.0, 20000.0), ("200日结", 4350.0, 4350.0),
    ("·15薪", None, None), ("30/小时", 5220.0, 5220.0), ("None", None, None),
])
def test_monthly_salary(spark, given, low, high):
    frame = spark.createDataFrame([(given,)], "salary string")
    row = frame.transform(S.monthly_salary()).first()
    assert (row["salary_low"], row["salary_high"]) == (low, high)
    assert frame.filter(S.has_salary(F.col("salary"))).isEmpty() == (low is None)


@pytest.mark.parametrize("given, wanted", [
    ("10k", 10000.0), ("12千", 12000.0), ("10,000", 10.0),  # no thousands separators
    ("1.5万", 1.5), ("x", None), (None, None),
])
def test_single_salary(value, given, wanted):
    assert value(S.single_salary(F.col("c")), c=given) == wanted
    assert S.parse_bound(given) == wanted


@pytest.mark.parametrize("low, high, text, wanted", [
    ("10k", None, None, (10000.0, 10000.0)), ("20000", "10000", None, (10000.0, 20000.0)),
    (None, None, "3-5k", (3000.0, 5000.0)), (None, None, "7000", (7000.0, 7000.0)), (None, None, "面议", (None, None)),
    ("5000", None, "1-2k", (5000.0, 5000.0)),
])
def test_salary_pair(spark, low, high, text, wanted):
    frame = spark.createDataFrame([(low, high, text)], "salary_low string, salary_high string, salary string")
    row = frame.transform(S.salary_pair()).first()
    assert (row["salary_low"], row["salary_high"]) == wanted
    assert frame.filter(S.has_pair(columns=frame.columns)).isEmpty() == (wanted[0] is None)


@pytest.mark.parametrize("given, wanted", [
    (0.0, "10k以下"), (9999.99, "10k以下"), (10000.0, "10k-15k"), (30000.0, "30k以上"), (1e9, "30k以上"), (None, None),
])
def test_salary_bucket(value, given, wanted):
    assert value(S.salary_bucket(F.col("c")), schema="c double", c=given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("0", "应届/无经验"), ("-1", "应届/无经验"), ("2年", "1-3年"), ("3", "1-3年"), ("4.5", "3-5年"), ("7", "5年以上"),
    ("1e1", "5年以上"), ("在校", "在校"), ("", "未知"), (None, "未知"), ("1d", "1d"), ("1-3年", "1-3年"), ("inf", "5年以上"),
])
def test_experience_label(value, given, wanted):
    assert value(L.experience_label(F.col("c")), c=given) == wanted


def test_labels_of_tags(value):
    experience = L.experience_of_tags(F.col("t"), F.col("n"))
    assert value(experience, t="本科 | 5-10年", n="") == "5年以上"
    assert value(experience, t="在校/应届", n="") == "应届/无经验"
    assert value(experience, t="本科", n="Java实习生") == "应届/无经验"
    assert value(experience, t=None, n=None) == "未知"
    education = L.education_of_tags(F.col("t"))
    assert value(education, t="中专/中技") == "中专/中技"
    assert value(education, t="高中及以下") == "高中及以下"
    assert value(education, t="x") == "未知"


@pytest.mark.parametrize("title, wanted", [
    ("Java开发工程师", "backend"), ("Django web", "backend"), ("Web前端", "frontend"), ("安卓", "mobile"),
    ("医疗器械销售", "sales"), ("数据分析师", "data"), ("总裁助理", "other"), (None, "other"), ("C++工程师", "backend"),
])
def test_family_of_title(value, title, wanted):
    assert value(L.family_of_title(F.col("t")), t=title) == wanted


def test_family_agrees_with_a_plain_scan(spark):
    terms = [(f, k.lower()) for f, _n, ks, _w in V.FAMILIES for k in ks]
    terms += [(f, t) for f in V.FAMILY_MATCH_ORDER for t in V.FAMILY_TERMS[f]]
    titles = sorted({a + b for _f, a in terms[::7] for _g, b in terms[::11]})
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", L.family_of_title(F.col("t")).alias("f"))
    for row in rows.collect():
        assert row["f"] == next((f for f, t in terms if t in row["t"]), "other"), row["t"]


def test_places(value):
    city = X.city_of(F.col("l"), F.col("b"))
    assert value(city, l="杭州·滨江区·长河", b="北京") == "杭州"
    assert value(city, l=" ", b="北京") == "北京"
    assert value(city, l="·x", b="") == "未知"
    district = X.district_of(F.col("l"))
    assert value(district, l="杭州·滨江区") == "滨江区"
    assert value(district, l="杭州") == "杭州"
    assert value(district, l="杭州··x") == ""
    assert value(district, l="") is None


@pytest.mark.parametrize("given, wanted", [
    ("C/C++ | Go", "C,C++,Go"), ("a | | b；c，d、", "a,b,c,d"), (" 机器 学习 ", "机器 学习"), (None, ""), ("｜", ""),
])
def test_skills(value, given, wanted):
    assert value(X.skills_text(F.col("s")), s=given) == wanted


def test_small_text_rules(value):
    assert value(X.flat_text(F.col("c")), c=" a\n\n　b\t c ") == "a b c"
    assert value(X.skill_list(F.col("c")), c=" a, ,b ") == ["a", "b"]
    assert value(X.source_id(F.col("l"), F.col("t")), l="", t="abc") == "900150983cd24fb0"
    assert value(X.salary_label(F.col("c")), c="面议") == "未标注"
    assert value(X.salary_label(F.col("c")), c="1-2K") == "1-2K"
    tags = F.split("c", r"\|")
    assert value(X.useful_tags(tags), c="Java|五险一金|...|x|BOSS直聘认证|包吃住| Vue |一二三四五六七八九十一二三四五六") == ["Java", "Vue"]


def test_tokens(value):
    assert value(K.tokens(F.col("c")), c="负责Python/C++开发，熟悉SQL。的 a") == ["负责Python" [2:], "C++", "开发", "SQL", "a"]
    assert value(K.tokens(F.col("c")), c=None) == []


def test_report_terms_need_a_word_boundary(spark):
    frame = spark.createDataFrame([("用Python和 Java v1.2-x 机器学习平台建设 熟悉",)], "jd string")
    names = [r["name"] for r in K.term_rows(frame).collect()]
    assert names == ["Java", "v1.2-x", "机器学习平台", "建设"]


def page(spark, jd, text=""):
    frame = spark.createDataFrame([(jd, text)], "jd string, page_text string")
    return P.extract_descriptions(frame).first()


LONG = "负责系统设计与开发工作。" * 12


def test_description_with_recruiter_card(spark):
    row = page(spark, f"职位描述\n{LONG}  \n\n\n\n第二段\t\t完\n张三\n今日活跃\n某公司\n·\nHR\n\n竞争力分析\n其它")
    assert row["reject_reason"] is None
    assert row["description"] == f"{LONG}\n\n第二段 完"
    assert row["activity"] == "今日活跃"


def test_description_without_activity_line_and_with_safety_notice(spark):
    row = page(spark, f"职位描述\r\n{LONG}\r\n张三\n某公司\n·\nHR\nBOSS 安全提示\n提示")
    assert (row["description"], row["activity"]) == (LONG, "")
    row = page(spark, "", f"导航\n职位描述\n{LONG}\n BOSS 安全提示 \n提示")
    assert (row["description"], row["activity"]) == (LONG, "")


@pytest.mark.parametrize("jd, text, reason", [
    (LONG + "登录查看完整内容", "", "login"), ("", "首页 职位 公司 无障碍专区", "navigation"), ("职位描述\n太短", "", "too_short"),
    ("", "", "too_short"),
])
def test_rejected_pages(spark, jd, text, reason):
    row = page(spark, jd, text)
    assert (row["reject_reason"], row["description"]) == (reason, None)


@pytest.mark.parametrize("status, body, wanted", [
    (401, None, "unauthenticated"), (403, "", "restricted"), (429, "", "restricted"), (500, "", "response_error"),
    (200, "[1]", "response_error"), (200, "{bad", "response_error"), (200, None, "response_error"),
    (200, '{"code":"37"}', "restricted"), (200, '{"code":9,"msg":"访问频繁"}', "restricted"),
    (200, '{"code":9,"message":"no"}', "response_error"), (200, "{}", "response_error"),
    (200, '{"code":0}', "response_error"), (200, '{"code":0,"zpData":{"jobList":{}}}', "response_error"),
    (200, '{"code":0,"zpData":{"jobList":[]}}', "empty"),
    (200, '{"code":0,"zpData":{"jobList":[null,{"salaryDesc":" "}]}}', "unauthenticated"),
    (200, '{"code":0,"zpData":{"jobList":[null,{"salaryDesc":"1K"}]}}', "available"),
])
def test_response_status(value, status, body, wanted):
    expression = P.response_status(F.col("s"), F.col("b"))
    assert value(expression, schema="s int, b string", s=status, b=body) == wanted
