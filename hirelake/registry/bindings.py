"""Job-posting views over the given tables.

The given tables hold no postings. These expressions derive them, in SQL that Spark and the checking database both
read: a raw posting per ``lineitem`` row, a detail record and a captured page per ``documents`` row, a search ledger from
``orders``, and the city table from ``customer``. Every row of a table is used, and every text is used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import fixed_values as V

TITLES = [
    "Java开发工程师", "Python后端开发", "前端开发", "数据分析师", "产品经理", "销售代表", "新媒体运营", "护士",
    "课程顾问", "机械工程师", "测试工程师", "DevOps运维", "UI设计师", "会计", "物流专员", "HR薪酬专员",
    "施工员", "网络安全", "Android安卓客户端", "保洁", "算法实习生", "应届管培生", "总裁助理", "品牌策划",
]
CITIES = [
    "北京", "上海", "广州", "深圳", "成都", "杭州", "重庆", "西安", "苏州", "武汉", "惠州", "温州", "盐城",
    "厦门", "兰州", "香港", "澳门", "台湾", "三沙", "丽江", "北海", "大同", "天水", "吉林", V.NATIONWIDE,
]
SKILLS = [
    "Java", "Python", "SQL", "Excel", "C++", "Vue", "机器学习", "沟通", "Spark", "Kafka", "MySQL", "运营", "React",
    "Redis", "Go", "财务分析",
]
INDUSTRIES = ["互联网", "电子商务", "金融", "游戏", "企业服务", "教育培训", "社交网络", "医疗健康", "生活服务", "广告营销"]
EXPERIENCE = ["在校/应届", "在校生", "应届生", "经验不限", "1年以内", "1-3年", "3-5年", "5-10年", "10年以上", "1-3年", "3-5年"]
DEGREES = ["初中及以下", "中专/中技", "高中", "大专", "本科", "硕士", "博士", "学历不限", "本科"]
KEYWORDS = ["", "Java", "Python", "数据分析师", "产品经理", "销售经理", "测试工程师", "运营"]
LEDGER_FAMILIES = [f for f, _n, _k, _w in V.FAMILIES] + ["mobile"]


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def pick(key: str, values: list) -> str:
    """One of the values as text, by a key that runs from 0. The list folds into a constant array."""
    return f"split_part('{'^'.join(map(str, values))}', '^', CAST({key} AS INT) + 1)"


def every(n: int, value: str, otherwise: str, key: str = "l_orderkey") -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN {value} ELSE {otherwise} END"


Q = "(CAST(l_quantity AS INT) % 12 + 1)"
YEAR = "year(l_shipdate)"


def city_name(key: str, names: list[str] = CITIES) -> str:
    """Known names for the first keys, a made name for every other key."""
    return f"CASE WHEN {key} < {len(names)} THEN {pick(f'least({key}, {len(names) - 1})', names)} " \
           f"ELSE concat('城市', {text(key)}) END"


# The nationwide pseudo-city is a place to search, never the place of a posting.
SEEN_CITY = city_name("l_suppkey", CITIES[:-1])
# Salary texts by kind: lead, first number (factor, summand), middle, second number, tail.
SALARY_KINDS = [
    ("", 1, 0, "-", 1, 10, "K"),
    ("", 1, 0, "-", 1, 15, "K·14薪"),
    ("1.", 1, 0, "-", 1, 2, "万"),
    ("", 5, 100, "-", 5, 200, "元/天"),
    ("", 1, 20, "", None, None, "元/时"),
    ("面议", None, None, "", None, None, ""),
    ("", 100, 3000, "-", 100, 5000, ""),
    ("", 1, 10, "-", 1, 0, "K"),
    ("8千-1.2万", None, None, "", None, None, ""),
    ("", None, None, "", None, None, ""),
    ("", 1, 0, "k～", 1, 4, "k"),
    ("", 1, 0, "千至", 1, 3, "千 • 13 薪"),
    (" ", 1, 8, "", None, None, "K "),
]
KIND = f"l_orderkey % {len(SALARY_KINDS)}"


def _salary_part(i: int) -> str:
    return pick(KIND, [k[i] for k in SALARY_KINDS])


def _salary_number(i: int) -> str:
    missing = ", ".join(str(n) for n, k in enumerate(SALARY_KINDS) if k[i] is None)
    factor, summand = ([k[c] or 0 for k in SALARY_KINDS] for c in (i, i + 1))
    number = f"{Q} * CAST({pick(KIND, factor)} AS INT) + CAST({pick(KIND, summand)} AS INT)"
    return f"CASE WHEN {KIND} IN ({missing}) THEN '' ELSE {text(number)} END"


SALARY = f"concat({_salary_part(0)}, {_salary_number(1)}, {_salary_part(3)}, {_salary_number(4)}, {_salary_part(6)})"
SEPARATOR = pick("l_orderkey % 5", [" | ", "、", "/", "，", "；"])
JOB_ID = every(23, "''", f"concat({text('l_partkey')}, '-', {text('l_suppkey % 10')})")
BATCH_FOLDER = f"concat('archive/', {text(YEAR)})"
STAMP = f"concat({text(YEAR)}, '0101_', lpad({text('l_linenumber')}, 4, '0'))"
TITLE = pick("l_partkey % 24", TITLES)

# Raw posting columns, all of ``lineitem``.
RAW = {
    "batch_no": f"CAST({YEAR} * 10 + l_linenumber AS INT)",
    "batch_path": f"concat({BATCH_FOLDER}, '/boss_jobs_', {STAMP}, '.json')",
    "batch_folder": BATCH_FOLDER,
    "batch_dir": text(YEAR),
    "keyword": pick("l_linenumber % 8", KEYWORDS),
    "batch_city": pick(f"{YEAR} % 6", ["北京", "上海", "杭州", "成都", "广州", ""]),
    "job_id": JOB_ID,
    "title": f"concat({every(31, "'  '", "''")}, {TITLE}, {every(31, "' '", "''")})",
    "salary": SALARY,
    "salary_source": "CASE l_orderkey % 13 WHEN 9 THEN 'api_empty' ELSE 'api' END",
    "location": f"CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE concat({SEEN_CITY}, "
                + every(41, "''", "concat('·', " + pick("l_orderkey % 5", ["东城", "西湖", "", "高新", "滨江"])
                        + ", '·', l_returnflag)") + ") END",
    "tags": every(14, "''", f"concat({pick('l_partkey % 11', EXPERIENCE)}, "
                  + every(7, "''", f"concat(' | ', {pick('(l_partkey + l_orderkey) % 9', DEGREES)})") + ")"),
    "boss_name": every(19, "''", f"concat('Supplier#', lpad({text('l_suppkey')}, 9, '0'))"),
    "boss_title": pick("l_suppkey % 3", ["HR", "招聘经理", ""]),
    "boss_active_status": pick("l_orderkey % 4", ["在线", "", "今日活跃", "刚刚活跃"]),
    "company_scale": pick("l_suppkey % 6", list(V.FILTER_CODES["scale"][1])),
    "company_stage": pick("l_suppkey % 8", list(V.FILTER_CODES["stage"][1])),
    "company_industry": every(17, "''", every(29, "'-'", pick("l_suppkey % 10", INDUSTRIES))),
    "job_labels": every(4, "''", pick("l_partkey % 3", ["本科 | 3-5年", "大专", "硕士 | 1-3年"])),
    "skills": every(9, "''", f"concat({pick('l_partkey % 16', SKILLS)}, {SEPARATOR}, "
                    f"{pick('(l_partkey + l_linenumber) % 16', SKILLS)}, {SEPARATOR}, {pick('l_suppkey % 16', SKILLS)})"),
    "job_link": every(23, "''", f"concat('https://www.zhipin.com/job_detail/', {text('l_partkey')}, '-', "
                      f"{text('l_suppkey % 10')}, '.html')"),
    "welfare": pick("l_partkey % 3", ["五险一金 | 餐补", "", "年终奖"]),
}
PLACE = ["batch_no", "l_orderkey", "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT)"]

DETAIL_YEAR = "(1995 + doc_id % 7)"
DETAIL_PREFIX = pick("doc_id % 4", [
    "职责：负责后端开发，熟悉Java、MySQL和Redis。", "任职要求：熟悉机器学习，掌握Python/C++。", "",
    "岗位职责：参与产品设计，了解微服务与分布式。",
])
DETAIL_TEXTS = [
    f"concat({DETAIL_PREFIX}, text)",
    every(3, "concat('岗位职责：负责数据分析与Python开发，熟悉SQL。', text)", "text", "doc_id"),
    "concat(text, ' 更新')",
]
DETAIL_FILES = ["0001", "0009", "0009"]


def detail_columns(snapshot: int) -> dict[str, str]:
    path = f"concat('archive/', {text(DETAIL_YEAR)}, '/boss_details_', {text(DETAIL_YEAR)}, " \
           f"'0101_{DETAIL_FILES[snapshot]}.json')"
    return {
        "detail_path": path,
        "snapshot": str(snapshot),
        "doc_id": "doc_id",
        "job_id": f"concat({text('doc_id')}, '-', {text('doc_id % 10')})",
        "company": every(5, "''", f"concat('Detail#', {text('doc_id % 50')})", "doc_id"),
        "jd": DETAIL_TEXTS[snapshot],
        "tag_text": f"concat({pick('doc_id % 16', SKILLS)}, '|', {pick('(doc_id + 5) % 16', SKILLS)}, '|', "
                    + pick("doc_id % 7", ["五险一金", "...", "弹性工作", "Kafka", "金", "沟通能力", "x"]) + ")",
    }


CARD = ["张三", "今日活跃", "某公司", "·", "招聘经理"]


def lines(*parts: str) -> str:
    """SQL text of lines joined by line feeds; parts are SQL."""
    return "concat(" + ", chr(10), ".join(parts) + ")"


def _quoted(items: list[str]) -> list[str]:
    return [f"'{i}'" for i in items]


# A captured page per document: with a recruiter card, without one, truncated, navigation only, too short.
PAGES = {
    "doc_id": "doc_id",
    "jd": "CASE doc_id % 8 WHEN 0 THEN "
          + lines("'职位描述'", "text", *_quoted(CARD), "'竞争力分析'", "'更多'")
          + " WHEN 1 THEN " + lines("'职位描述'", "text", *_quoted([c for c in CARD if c != "今日活跃"]), "''",
                                    "'BOSS 安全提示'", "'提示'")
          + " WHEN 2 THEN " + lines("'职位描述'", "text", "'BOSS 安全提示'", "'提示'")
          + " WHEN 3 THEN " + lines("'职位描述'", "text", "'登录查看完整内容'")
          + " WHEN 5 THEN " + lines("'职位描述'", "'太短'")
          + " WHEN 7 THEN " + lines("text", "'李四'", "'在线'", "'某公司'", "'·'", "'HR'", "' '")
          + " ELSE '' END",
    "page_text": "CASE doc_id % 8 WHEN 4 THEN '首页 职位 公司 无障碍专区' WHEN 6 THEN "
                 + lines("'导航'", "'职位描述'", "text") + " ELSE '' END",
    "job_link": f"concat('https://www.zhipin.com/job_detail/', {text('doc_id')}, '-', {text('doc_id % 10')}, '.html')",
    "tag_text": detail_columns(0)["tag_text"],
}

COMBO_KEYS = {
    "city": city_name("o_custkey % 25"),
    "family_id": pick("o_orderkey % 21", LEDGER_FAMILIES),
    "slice_id": pick("o_orderkey % 5", ["", "", "exp103", "exp104", "deg202"]),
}
COMBO_FACTS = {
    "status": "CASE count(*) % 4 WHEN 0 THEN 'saturated' WHEN 3 THEN 'failed' ELSE 'done' END",
    "raw": "count(*) * 12",
    "new": "CAST(count(*) * 12 - sum(CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END) AS BIGINT)",
    "dup": "CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END) AS BIGINT)",
    "runs": "1 + count(*) % 2",
    "run_at": "CAST(CAST(max(o_orderdate) AS DATE) AS STRING)",
    "truncated": "count(*) >= 7",
}

def json_object(fields: dict[str, str]) -> str:
    """SQL text of a JSON object; values are SQL, those of names ending in ``!`` stand unquoted."""
    parts = []
    for name, value in fields.items():
        quote = "" if name.endswith("!") else '"'
        parts.append(f"""concat('"{name.rstrip('!')}":{quote}', {value}, '{quote}')""")
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


# A captured search response per event.
LISTED = json_object({
    "jobName": "event_type",
    "salaryDesc": f"CASE event_id % 5 WHEN 0 THEN '' ELSE concat({text('event_id % 30 + 3')}, 'K') END",
    "cityName": pick("event_id % 25", CITIES),
    "areaDistrict": "''",
    "businessDistrict": f"concat('B', {text('event_id % 9')})",
    "jobExperience": pick("event_id % 3", ["1-3年", "不限", ""]),
    "jobDegree": pick("event_id % 4", ["本科", "不限", "大专", ""]),
    "brandName": f"concat('U', {text('user_id')})",
    "activeTimeDesc": pick("event_id % 6", ["", "", "", "", "刚刚活跃", ""]),
    "bossOnline!": "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END",
    "jobLabels!": """'["a","b"]'""",
    "skills!": """'["SQL"]'""",
    "encryptJobId": f"CASE event_id % 7 WHEN 0 THEN '' ELSE {text('event_id')} END",
})
RESPONSES = {
    "event_id": "event_id",
    "http_status": "CASE event_id % 40 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 200 END",
    "body": "CASE event_id % 11 WHEN 1 THEN '{\"code\":37,\"message\":\"x\"}' WHEN 2 THEN "
            "'{\"code\":9,\"msg\":\"访问频繁\"}' WHEN 3 THEN '{\"code\":9,\"message\":\"other\"}' WHEN 4 THEN "
            "'{\"code\":0,\"zpData\":{\"jobList\":[]}}' WHEN 5 THEN '{\"code\":0,\"zpData\":{}}' WHEN 6 THEN '[1]' "
            "WHEN 7 THEN '{bad' ELSE concat('{\"code\":0,\"zpData\":{\"jobList\":[', " + LISTED + ", ',null,', "
            + LISTED + ", ']}}') END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan with fewer tasks than cores over all cores; a scan of as many tasks stays as it is, so a large
    table is never moved. The small tables given are a single row group each, which Spark cannot split."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def raw_postings(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Raw postings; only the columns asked for are computed."""
    wanted = list(RAW) if columns is None else columns
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    place = ", ".join(RAW["batch_no"] if p == "batch_no" else p for p in PLACE)
    return rows.selectExpr(*[f"{RAW[c]} AS {c}" for c in wanted], f"struct({place}) AS pos")


def raw_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail records of all detail files, three snapshots per document, from one scan."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    snapshots = [f"named_struct({', '.join(f"'{c}', {e}" for c, e in detail_columns(i).items())})"
                 for i in range(len(DETAIL_TEXTS))]
    rows = documents.selectExpr("doc_id AS __doc", f"inline(array({', '.join(snapshots)}))").drop("__doc")
    return rows.select("*", F.struct("detail_path", "snapshot", "doc_id").alias("pos"),
                       F.split("tag_text", r"\|").alias("skill_tags")).drop("tag_text", "snapshot", "doc_id")


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in PAGES.items()]).withColumn("tags", F.split("tag_text", r"\|"))


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    keyed = orders.selectExpr(*[f"{e} AS {c}" for c, e in COMBO_KEYS.items()], "o_orderstatus", "o_orderdate")
    grouped = keyed.groupBy(*COMBO_KEYS).agg(*[F.expr(e).alias(c) for c, e in COMBO_FACTS.items()])
    return grouped.withColumn("keyword", F.concat(F.lit("k-"), F.col("family_id")))


CITY_COLUMNS = {
    "city": city_name("c_custkey"),
    "code": text("100000000 + c_custkey"),
    "city_no": "c_custkey",
}


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {c}" for c, e in CITY_COLUMNS.items()])


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").selectExpr(*[f"{e} AS {c}" for c, e in RESPONSES.items()])


def std_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard rows of all raw postings, without details."""
    from hirelake.plans.standard import import_rows

    names = ["batch_path", "job_id", "title", "salary", "location", "tags", "job_labels", "boss_name",
             "company_industry", "skills", "batch_city"]
    return import_rows(raw_postings(spark, sf_dir, names))


def served_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a posting CSV as a reader would give them: text cells, some headers in another spelling."""
    names = ["title", "salary", "location", "tags", "boss_name", "company_industry", "skills"]
    raw = raw_postings(spark, sf_dir, names)
    return raw.select(
        "pos", *[F.expr(e).alias(h) for h, e in CSV_CELLS.items()],
    )


# Header spelling -> cell. Low and high salary cells are filled for some rows only.
CSV_CELLS = {
    "职位名称": "title",
    "公司名称": "CASE boss_name WHEN '' THEN 'None' ELSE boss_name END",
    "city": "location",
    "salary_low": "CASE WHEN salary LIKE '%万%' THEN '12k' WHEN salary LIKE '%天%' THEN '6500' END",
    "salary_high": "CASE WHEN salary LIKE '%天%' THEN '3000' WHEN salary LIKE '%1.2万%' THEN '9千' END",
    "薪资": "salary",
    "学历要求": "CASE WHEN tags LIKE '%本科%' THEN ' 本科 ' WHEN tags LIKE '%博士%' THEN 'nan' ELSE '大专' END",
    "work_years": "CASE WHEN tags LIKE '%1-3年%' THEN '2年' WHEN tags LIKE '%3-5年%' THEN '4.5' WHEN tags LIKE '%5-10年%' "
                  "THEN '7' WHEN tags LIKE '%经验不限%' THEN '0' WHEN tags LIKE '%应届%' THEN '在校' ELSE '' END",
    "行业": "company_industry",
    "skills": "replace(replace(skills, ' | ', ','), '、', ', ')",
    "description": "CASE WHEN skills LIKE '%SQL%' THEN concat('负责', title, '，熟悉SQL与C++，', location) ELSE '' END",
}
