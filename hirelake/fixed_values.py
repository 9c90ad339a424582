"""Fixed values.

Labels, word lists, code tables and constants that decide results. They are part of the data contract: changing an
entry (or the order, where order decides) changes query results. Everything here is plain data; no logic.
"""

# --- column lists -------------------------------------------------------------------------------------------------
STANDARD_COLUMNS = [
    "job_name", "company", "city", "salary_low", "salary_high",
    "education", "work_years", "category", "skills", "description",
]
CLEAN_COLUMNS = [
    "job_id", "job_name", "company", "city", "salary_low", "salary_high", "avg_salary",
    "education", "work_years", "experience", "category", "skills", "description",
]
REQUIRED_COLUMNS = [
    "job_name", "company", "city", "salary_low", "salary_high",
    "education", "work_years", "category", "skills",
]
BUSINESS_KEY = ["job_name", "company", "city", "salary_low", "salary_high"]
RAW_COLUMNS = [
    "title", "salary", "salary_source", "location", "tags", "boss_name", "boss_title", "boss_active_status",
    "company_scale", "company_stage", "company_industry", "job_labels", "skills", "security_id", "lid",
    "encrypt_job_id", "encrypt_boss_id", "encrypt_brand_id", "job_link", "company_link", "welfare", "job_id",
]
LIST_EXPORT_COLUMNS = [
    "job_id", "title", "salary", "salary_source", "location", "tags", "boss_name", "boss_active_status",
    "company_scale", "company_stage", "company_industry", "skills", "job_link", "welfare",
]
DETAIL_EXPORT_COLUMNS = [
    "job_id", "title", "company", "salary", "salary_source", "location",
    "boss_active_status", "tags_list", "job_link", "skill_tags", "jd",
]
# Completeness weights by field; also the fields that are completed from other snapshots.
COMPLETENESS_WEIGHTS = {
    "salary": 60, "location": 50, "company_industry": 40, "skills": 30, "tags": 20, "title": 10,
}
DRIFT_FIELDS = ["title", "salary", "location", "company_industry", "skills", "tags", "boss_name"]

HEADER_ALIASES = {
    "职位名称": "job_name",
    "职位": "job_name",
    "公司名称": "company",
    "工作地点": "city",
    "学历要求": "education",
    "经验要求": "work_years",
    "行业": "category",
    "行业类别": "category",
    "industry": "category",
    "岗位类别": "category",
    "技能需求": "skills",
    "技能": "skills",
    "薪资": "salary",
    "薪资范围": "salary",
    "职位描述": "description",
    "job_desc": "description",
    "job_description": "description",
}
EXPORT_HEADERS = {
    "job_id": "岗位编号",
    "job_name": "岗位名称",
    "company": "公司",
    "city": "城市",
    "salary_low": "最低薪资(元/月)",
    "salary_high": "最高薪资(元/月)",
    "avg_salary": "平均薪资(元/月)",
    "education": "学历",
    "experience": "经验",
    "category": "行业/类别",
    "skills": "技能",
    "description": "职位描述",
}
# Cell texts a CSV reader with pandas defaults takes as missing.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- text ---------------------------------------------------------------------------------------------------------
# Characters that count as white space, as in Python's str.strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
UNKNOWN = "未知"
SKILL_SEPARATORS = "|｜/、,，;；"

# --- salary -------------------------------------------------------------------------------------------------------
NO_SALARY_WORDS = ["", "-", "面议", "薪资面议", "面议薪资", "none", "nan"]
PLACEHOLDERS = ["-", "面议"]
WORK_DAYS_PER_MONTH = 21.75
WORK_HOURS_PER_DAY = 8
SALARY_LABELS = ["10k以下", "10k-15k", "15k-20k", "20k-25k", "25k-30k", "30k以上"]
SALARY_EDGES = [0, 10000, 15000, 20000, 25000, 30000]

# --- experience and education -------------------------------------------------------------------------------------
EXPERIENCE_ORDER = ["应届/无经验", "1-3年", "3-5年", "5年以上", "未知"]
EXPERIENCE_BUCKETS = {
    "在校/应届": "应届/无经验",
    "在校生": "应届/无经验",
    "应届生": "应届/无经验",
    "经验不限": "应届/无经验",
    "1年以内": "1-3年",
    "1-3年": "1-3年",
    "3-5年": "3-5年",
    "5-10年": "5年以上",
    "10年以上": "5年以上",
}
NEWCOMER_WORDS = ["实习", "应届", "在校"]
EDUCATION_LABELS = [
    "初中及以下", "中专/中技", "中专", "中技", "高中及以下", "高中", "大专", "本科", "硕士", "博士", "学历不限",
]

# --- tokens -------------------------------------------------------------------------------------------------------
STOP_WORDS = [
    "岗位", "职位", "相关", "工作", "经验", "负责", "要求", "熟悉", "优先", "具备",
    "进行", "使用", "完成", "参与", "以及", "并且", "我们", "公司", "团队", "能力",
    "以上", "以下", "其他", "可以", "能够", "根据", "通过", "对于", "这个", "一种",
    "的", "了", "和", "与", "及", "在", "有", "等", "对", "并", "以", "为", "或",
]
REPORT_STOP_WORDS = [
    "任职", "要求", "岗位", "职责", "描述", "优先", "具有",
    "负责", "相关", "经验", "能力", "以上", "及其", "工作",
    "开发", "团队", "项目", "公司", "业务", "熟悉", "熟练",
    "了解", "掌握", "参与", "完成", "进行", "能够", "学历",
    "专业", "提供", "福利", "加入", "我们", "我们只", "是通过",
    "就是", "已经", "可以", "这个", "那个", "什么", "怎么",
    "欢迎", "期待", "为你", "为你提供",
]
BASE_TERMS = [
    "Java", "Spring", "Redis", "MySQL", "Kafka", "Flink", "Spark",
    "Go", "Python", "微服务", "分布式", "高并发",
    "AI", "LLM", "RAG", "Agent", "SQL", "Linux",
]
REPORT_EXPERIENCE_MARKS = ["年", "应届", "在校", "经验不限"]
REPORT_EDUCATION_LABELS = ["大专", "本科", "硕士", "博士", "学历不限"]
BENEFIT_WORDS = [
    "五险", "补充医疗", "定期体检", "带薪年假", "年终奖", "零食", "餐补",
    "节日福利", "加班补助", "股票期权", "员工旅游", "交通补助", "通讯补贴", "团建",
    "生日福利", "免费班车", "全勤奖", "包吃", "弹性工作", "下午茶", "租房补贴",
    "体检", "健身", "文化", "充电假", "司龄假", "红包", "能量补贴", "社团", "三薪",
    "绩效", "底薪", "保底", "活动基金", "学习基金", "节日礼品", "无障碍",
]
NOISE_WORDS = ["BOSS直聘", "boss", "BOSS", "来自BOSS直聘", "金", "金币"]

# --- captured pages and responses ---------------------------------------------------------------------------------
LOGIN_MARKER = "登录查看完整内容"
DESCRIPTION_MARKER = "职位描述"
COMPETITIVENESS_MARKER = "竞争力分析"
SAFETY_MARKER = "BOSS 安全提示"
NAVIGATION_WORDS = ["无障碍专区", "首页", "职位", "公司"]
MIN_DESCRIPTION_LENGTH = 120
RESTRICTED_CODES = [31, 37]
RESTRICTED_WORDS = ["环境存在异常", "访问频繁", "操作太频繁", "安全校验", "滑块", "验证"]
ONLINE_LABEL = "在线"
JOB_LINK_FORMAT = ("https://www.zhipin.com/job_detail/", ".html")
COMPANY_LINK_FORMAT = ("https://www.zhipin.com/gongsi/", ".html")
ROWS_PER_PAGE = 15

# --- filter codes: domain -> (display name, label -> code) ------------------------------------------------------------
FILTER_CODES = {
    "scale": ("规模", {
        "0-20人": "301", "20-99人": "302", "100-499人": "303",
        "500-999人": "304", "1000-9999人": "305", "10000人以上": "306",
    }),
    "stage": ("融资", {
        "未融资": "801", "天使轮": "802", "A轮": "803", "B轮": "804",
        "C轮": "805", "D轮及以上": "806", "已上市": "807", "不需要融资": "808",
    }),
    "salary": ("薪资", {
        "不限": "0", "3K以下": "402", "3-5K": "403", "5-10K": "404",
        "10-20K": "405", "20-50K": "406", "50K以上": "407",
    }),
    "experience": ("经验", {
        "不限": "0", "在校生": "108", "应届生": "102", "经验不限": "101",
        "1年以内": "103", "1-3年": "104", "3-5年": "105", "5-10年": "106", "10年以上": "107",
    }),
    "degree": ("学历", {
        "不限": "0", "初中及以下": "209", "中专/中技": "208", "高中": "206",
        "大专": "202", "本科": "203", "硕士": "204", "博士": "205",
    }),
    "industry": ("行业", {
        "互联网": "1001", "电子商务": "1002", "金融": "1003", "游戏": "1004",
        "企业服务": "1005", "教育培训": "1006", "社交网络": "1007",
        "医疗健康": "1008", "生活服务": "1009", "广告营销": "1010",
    }),
}

# --- job families: id, name, search keywords, weight ---------------------------------------------------------------
FAMILIES = [
    ("backend", "后端开发", ["Java", "Python", "Go", "后端开发", "C++"], 1.30),
    ("sales", "销售", ["销售经理", "销售代表", "大客户销售", "渠道销售"], 1.20),
    ("ai", "算法/AI", ["算法工程师", "机器学习", "深度学习", "大模型算法"], 1.15),
    ("frontend", "前端开发", ["前端开发", "Web前端", "Vue", "React"], 1.00),
    ("operation", "运营", ["新媒体运营", "用户运营", "电商运营", "内容运营"], 1.00),
    ("edu", "教育", ["教师", "培训讲师", "课程顾问", "幼教"], 1.00),
    ("service", "服务业", ["客服专员", "餐饮店长", "酒店管理", "房产经纪人"], 1.00),
    ("mech", "机械/电气", ["机械工程师", "电气工程师", "自动化工程师", "工艺工程师"], 0.95),
    ("product", "产品", ["产品经理", "高级产品经理", "硬件产品经理"], 0.95),
    ("test", "测试", ["测试工程师", "自动化测试", "软件测试"], 0.85),
    ("data", "数据", ["数据分析师", "数据开发", "大数据工程师", "BI工程师"], 0.85),
    ("design", "设计", ["UI设计师", "视觉设计师", "交互设计师", "平面设计"], 0.85),
    ("marketing", "市场", ["市场营销", "品牌营销", "市场推广", "广告投放"], 0.85),
    ("finance", "财务/会计", ["财务会计", "会计", "出纳", "财务经理"], 0.85),
    ("medical", "医疗健康", ["护士", "医师", "药师", "医药代表"], 0.85),
    ("logistics", "物流/供应链", ["物流专员", "采购专员", "仓储主管", "供应链管理"], 0.85),
    ("hr", "人力/行政", ["人力资源", "招聘专员", "行政专员", "人事经理"], 0.80),
    ("ops", "运维/云", ["运维工程师", "DevOps", "云计算工程师", "网络工程师"], 0.80),
    ("construct", "建筑/土木", ["施工员", "土建工程师", "结构工程师", "工程造价"], 0.80),
    ("security", "安全", ["网络安全", "信息安全", "安全工程师"], 0.45),
]
OTHER_FAMILY = "other"
# Wide terms per family, used only for labelling titles.
FAMILY_TERMS = {
    "backend": ["java", "python", "golang", "go开发", "php", "c++", "node", "后端", "服务端",
                "开发工程师", "软件开发", "研发工程师", "架构师", "开发"],
    "frontend": ["前端", "web开发", "vue", "react", "html", "小程序", "h5", "页面"],
    "mobile": ["android", "ios", "移动端", "flutter", "客户端开发", "安卓"],
    "ai": ["算法", "机器学习", "深度学习", "大模型", "人工智能", "nlp", "计算机视觉",
           "推荐算法", "数据挖掘", "ai工程", "智能"],
    "test": ["测试", "qa", "质量保证"],
    "ops": ["运维", "devops", "云计算", "系统工程师", "网络工程师", "实施工程师",
            "it支持", "sre", "通信", "技术支持"],
    "data": ["数据分析", "数据开发", "大数据", "数仓", "bi", "etl", "数据工程", "商业分析"],
    "security": ["安全", "渗透", "等保", "风控"],
    "product": ["产品经理", "产品专员", "产品助理"],
    "design": ["设计师", "美工", "视觉", "ui", "交互", "平面", "设计"],
    "operation": ["运营"],
    "marketing": ["市场", "营销", "推广", "策划", "投放", "seo", "sem", "品牌", "公关"],
    "sales": ["销售", "业务员", "客户经理", "招商", "电销", "bd", "拓展", "渠道", "顾问式"],
    "hr": ["人力", "人事", "招聘", "行政", "hr", "薪酬", "培训专员"],
    "finance": ["会计", "财务", "出纳", "审计", "税务", "资金", "结算", "收银", "统计"],
    "edu": ["教师", "老师", "讲师", "教研", "教务", "助教", "培训", "课程顾问",
            "辅导", "幼教", "教练", "保育"],
    "medical": ["护士", "护理", "医师", "医生", "药师", "药店", "医药", "临床", "口腔",
                "康复", "检验", "理疗", "兽医"],
    "mech": ["机械", "电气", "自动化", "工艺", "模具", "数控", "cnc", "设备工程师",
             "结构设计", "机电", "质检员", "普工", "操作工", "技工", "生产", "焊接"],
    "construct": ["施工", "土建", "结构工程师", "造价", "监理", "测量", "工程管理",
                  "预算员", "建筑", "安装工程", "暖通", "水电"],
    "logistics": ["物流", "采购", "仓储", "仓管", "供应链", "跟单", "报关", "货运",
                  "调度", "配送", "装卸", "库存"],
    "service": ["客服", "服务员", "店员", "导购", "前台", "店长", "餐饮", "酒店", "保洁",
                "保安", "美容", "房产经纪人", "物业", "快递", "保姆", "月嫂", "司机",
                "饮品", "收银员"],
}
# Wide terms are tried in this order; the first family with a hit wins.
FAMILY_MATCH_ORDER = [
    "backend", "frontend", "mobile", "ai", "data", "test", "ops", "security", "design",
    "product", "operation", "marketing", "sales", "medical", "edu", "hr", "finance",
    "mech", "construct", "logistics", "service",
]

# --- cities -------------------------------------------------------------------------------------------------------
CITY_TIERS = {
    "一线": (["北京", "上海", "广州", "深圳"], 8.0),
    "新一线": (["成都", "杭州", "重庆", "西安", "苏州", "武汉", "南京", "天津", "郑州",
                "长沙", "东莞", "佛山", "合肥", "青岛", "沈阳", "宁波", "昆明", "无锡"], 4.0),
    "二线": (["厦门", "福州", "济南", "大连", "哈尔滨", "温州", "长春", "石家庄", "泉州",
              "南宁", "贵阳", "南昌", "金华", "常州", "南通", "嘉兴", "太原", "徐州",
              "保定", "珠海", "中山", "惠州", "烟台", "兰州", "海口", "乌鲁木齐",
              "呼和浩特", "银川", "西宁", "拉萨", "绍兴", "台州", "扬州", "潍坊",
              "临沂", "洛阳", "唐山", "襄樊", "襄阳", "宜昌", "盐城", "泰州", "镇江",
              "淄博", "济宁", "廊坊", "汕头", "湛江", "桂林", "柳州", "遵义"], 2.0),
}
DEFAULT_CITY_WEIGHT = 1.0
NATIONWIDE = "全国"
NATIONWIDE_WEIGHT = 12.0
NATIONWIDE_DIVISOR = 3.5
NATIONWIDE_FACTOR = {"balanced": 2.0, "breadth": 3.5, "depth": 0.0}
CITY_DISPLAY = {"香港": "中国香港", "澳门": "中国澳门", "台湾": "中国台湾"}
DEFAULT_EXCLUDED_CITIES = ["三沙", "东沙群岛"]
THIN_CITY_ROWS = 20

# --- coverage strategies and slices -------------------------------------------------------------------------------
STRATEGIES = {
    "balanced": {"total_target": 25000, "max_families_per_city": 6, "zero_bonus": 1.0},
    "breadth": {"total_target": 25000, "max_families_per_city": 2, "zero_bonus": 3.0},
    "depth": {"total_target": 40000, "max_families_per_city": 12, "zero_bonus": 0.5},
}
COMBO_MIN_JOBS = 8
SLICES = {
    "experience": [
        ("exp108", "在校/应届"), ("exp103", "1年以内"), ("exp104", "1-3年"),
        ("exp105", "3-5年"), ("exp106", "5-10年"), ("exp107", "10年以上"),
    ],
    "degree": [
        ("deg209", "初中及以下"), ("deg208", "中专/中技"), ("deg206", "高中"), ("deg202", "大专"),
        ("deg203", "本科"), ("deg204", "硕士"), ("deg205", "博士"),
    ],
}

# Why a search is not planned, as the plan's results state it. The empty part stands for the number of rows.
BLOCK_REASONS = {
    "saturated": "历史零新增，已拉黑",
    "done": "账本记录已抓过",
    "covered": ("归档已有 ", "", " 条"),
    "full": "该城族数已铺满",
    "unseen": "depth 策略跳过 0 数据城市",
}
