"""Checking SQL for the registered queries, for an independent engine over the same tables.

Each statement states the result from the views of ``bindings`` with its own means: windows, list functions and
subqueries instead of the engine's aggregates and joins.
"""

from __future__ import annotations

from hirelake import fixed_values as V
from hirelake.registry import bindings as I

ORACLE: dict[str, str] = {}


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def columns(table: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in table.items())


PLACE = ", ".join(I.RAW["batch_no"] if p == "batch_no" else p for p in I.PLACE)
CTES = {
    "raw": f"SELECT {columns(I.RAW)}, row_number() OVER (ORDER BY {PLACE}) AS pos, l_orderkey, l_partkey, "
           f"l_suppkey, {I.PLACE[-1]} AS cents FROM lineitem",
    "details": "SELECT *, row_number() OVER (ORDER BY detail_path, snapshot, doc_id) AS pos FROM ("
               + " UNION ALL ".join(f"SELECT {columns(I.detail_columns(i))} FROM documents" for i in range(3)) + ")",
    "pages_": f"SELECT {columns(I.PAGES)} FROM documents",
    "cities": f"SELECT {columns(I.CITY_COLUMNS)} FROM customer",
    "combos": f"SELECT *, concat('k-', family_id) AS keyword FROM (SELECT city, family_id, slice_id, "
              f"{columns(I.COMBO_FACTS)} FROM (SELECT {columns(I.COMBO_KEYS)}, o_orderstatus, o_orderdate FROM orders) "
              "GROUP BY city, family_id, slice_id)",
    "responses": f"SELECT {columns(I.RESPONSES)} FROM events",
}

WORD_SALARY = quoted(V.NO_SALARY_WORDS)


def priced(source: str) -> str:
    """Monthly salary range of ``salary`` as CTEs ``priced_``."""
    return rf"""
    p0 AS (SELECT *, CASE WHEN lower(trim(salary)) IN ({WORD_SALARY}) THEN NULL ELSE regexp_replace(
        regexp_replace(replace(trim(salary), '，', ','), '[～~至]', '-', 'g'), '[·•]\s*\d+\s*薪', '', 'g') END AS st
        FROM {source}),
    p1 AS (SELECT *, regexp_extract_all(st, '\d+(?:\.\d+)?') AS nums,
        CASE WHEN contains(st, '万') THEN 10000 WHEN regexp_matches(st, '[kK千]') THEN 1000 ELSE 1 END::DOUBLE
        * CASE WHEN regexp_matches(st, '[天日]结|/\s*[天日]') THEN 21.75
          WHEN regexp_matches(st, '/\s*(小时|时)') THEN 174.0 ELSE 1 END::DOUBLE AS f FROM p0),
    p2 AS (SELECT *, nums[1]::DOUBLE * f AS a, coalesce(nums[2], nums[1])::DOUBLE * f AS b FROM p1),
    priced_ AS (SELECT * EXCLUDE (st, nums, f, a, b), round(least(a, b), 2) AS salary_low,
        round(greatest(a, b), 2) AS salary_high FROM p2)"""


TAGS = "coalesce(nullif(tags, ''), job_labels)"
BUCKETS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.EXPERIENCE_BUCKETS.items())


def experience(tags: str) -> str:
    return (f"CASE regexp_extract({tags}, '{'|'.join(V.EXPERIENCE_BUCKETS)}') {BUCKETS} ELSE CASE WHEN "
            f"regexp_matches(title, '{'|'.join(V.NEWCOMER_WORDS)}') THEN '应届/无经验' ELSE '未知' END END")


def education(tags: str) -> str:
    return f"coalesce(nullif(regexp_extract({tags}, '{'|'.join(V.EDUCATION_LABELS)}'), ''), '未知')"


def city(fallback: str = "''") -> str:
    return (f"coalesce(nullif(trim(split_part(trim(location), '·', 1)), ''), nullif({fallback}, ''), '未知')")


SKILLS = (r"array_to_string(list_filter(list_transform(regexp_split_to_array(skills, '[|｜/、,，;；]+'), lambda x: trim(x)),"
          r" lambda x: x <> ''), ',')")


def standard(name: str, source: str, company: str = "boss_name", fallback: str = "''", description: str = "''",
             keep: str = "pos, batch_path, job_id") -> str:
    return f"""{name} AS (SELECT {keep}, trim(title) AS job_name, trim({company}) AS company,
        {city(fallback)} AS city, salary_low, salary_high, {education(TAGS)} AS education,
        {experience(TAGS)} AS work_years, trim(coalesce(nullif(company_industry, ''), '未知')) AS category,
        {SKILLS} AS skills, {description} AS description FROM {source} WHERE salary_low IS NOT NULL)"""


KEY = "job_name, company, city, salary_low, salary_high"
STD = ", ".join(V.STANDARD_COLUMNS)


def first(source: str, key: str = KEY) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY pos) = 1)"


def oracle(name: str, sql: str, *ctes: str) -> None:
    """Register a statement with the views it uses; extra CTE texts contain `` AS ``."""
    parts = []
    for c in ctes:
        parts.append(c if " AS " in c else f"{c} AS ({CTES[c]})")
    ORACLE[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql


def counts(source: str, name: str = "name", limit: int | None = None, where: str = "true") -> str:
    cut = f" ORDER BY value DESC, name LIMIT {limit}" if limit else ""
    return f"SELECT {name} AS name, count(*) AS value FROM {source} WHERE {where} GROUP BY 1{cut}"


STD_ROWS = ["raw", priced("raw"), standard("std", "priced_", fallback="batch_city")]

# --- sources and sinks --------------------------------------------------------------------------------------------
BATCH_KIND = "l_orderkey % 50"
BATCHES = ("b AS (SELECT *, concat('archive/boss_jobs_', concat_ws('_', batch_no, l_orderkey, l_partkey, l_suppkey, cents), "
           "'.json') AS path FROM raw)")
oracle("archive_read", " UNION ALL ".join(
    f"""SELECT path AS batch_path, {i} AS idx, CASE WHEN {BATCH_KIND} = 5 THEN NULL ELSE keyword END AS keyword,
    CASE WHEN {BATCH_KIND} = 5 THEN NULL ELSE batch_city END AS batch_city, {job_id} AS job_id, {title} AS title, salary, location
    FROM b WHERE {BATCH_KIND} NOT IN (1, 2, 3, 4, 8, 9)"""
    for i, (job_id, title) in enumerate([("job_id", "title"), ("concat(job_id, 'x')", "'二'")])), "raw", BATCHES)
oracle("archive_validate", f"""SELECT path, CASE {BATCH_KIND} WHEN 1 THEN 'unreadable' WHEN 8 THEN 'unreadable' WHEN 9 THEN 'unreadable' WHEN 2 THEN 'jobs is not a list'
    WHEN 3 THEN 'jobs has an entry that is not an object' ELSE 'top level is neither object nor list' END AS reason
    FROM b WHERE {BATCH_KIND} IN (1, 2, 3, 4, 8, 9)""", "raw", BATCHES)
oracle("archive_files", """SELECT keyword, batch_city, row_number() OVER (PARTITION BY batch_path, keyword, batch_city
    ORDER BY pos) - 1 AS idx, job_id, title, salary, location FROM raw""", "raw")
LATEST = ("latest AS (SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY detail_path, job_id "
          "ORDER BY pos DESC) = 1)")
oracle("stream_changed", """SELECT keyword, batch_city, count(*) AS rows, count(DISTINCT job_id) AS ids,
    (SELECT count(DISTINCT batch_path) + count(DISTINCT CASE WHEN batch_path LIKE '%_0003.json' THEN batch_path END) FROM raw) AS reads
    FROM raw WHERE NOT (batch_path LIKE '%_0003.json' AND l_orderkey % 2 = 1) GROUP BY 1, 2""", "raw")
oracle("details_latest", "SELECT detail_path, job_id, company, md5(jd) AS jd_md5 FROM latest", "details", LATEST)
PAIRS = r"""pairs AS (SELECT j.batch_path, coalesce(
    (SELECT min(d.detail_path) FROM (SELECT DISTINCT detail_path FROM details) d WHERE
        regexp_extract(d.detail_path, '^(.*)/', 1) = j.batch_folder
        AND contains(d.detail_path, regexp_extract(j.batch_path, '\d{8}_\d{4,6}'))),
    (SELECT max(d.detail_path) FROM (SELECT DISTINCT detail_path FROM details) d WHERE
        regexp_extract(d.detail_path, '^(.*)/', 1) = j.batch_folder)) AS detail_path
    FROM (SELECT DISTINCT batch_path, batch_folder FROM raw) j)"""
oracle("detail_pairing", "SELECT * FROM pairs", "raw", "details", PAIRS)
oracle("write_std", f"SELECT {STD} FROM {first('std')}", *STD_ROWS)
BEST_FIELDS = list(V.COMPLETENESS_WEIGHTS)
SCORE = " + ".join(f"CASE WHEN trim({f}) NOT IN ('', '-', '面议') THEN {w} ELSE 0 END"
                   for f, w in V.COMPLETENESS_WEIGHTS.items()) + " + least(length(skills), 60) + least(length(tags), 40)"
SCORED = f"scored AS (SELECT *, {SCORE} AS score FROM raw WHERE job_id <> '')"
BEST = ("best AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS snapshots, min(pos) OVER (PARTITION BY job_id) AS first_pos"
        " FROM scored QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, pos) = 1)")


def alternative(field: str) -> str:
    return (f"(SELECT job_id, trim({field}) AS v FROM scored WHERE trim({field}) NOT IN ('', '-', '面议') "
            "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos) = 1)")


MERGED = ("merged AS (SELECT best.job_id, best.first_pos AS pos, best.snapshots, best.boss_name, best.batch_path, best.job_labels, "
          + ", ".join(f"CASE WHEN trim(best.{f}) = '' THEN coalesce(alt_{f}.v, best.{f}) ELSE best.{f} END AS {f}"
                      for f in BEST_FIELDS)
          + " FROM best " + " ".join(f"LEFT JOIN {alternative(f)} alt_{f} ON alt_{f}.job_id = best.job_id"
                                     for f in BEST_FIELDS) + ")")
MERGE = ["raw", SCORED, BEST, MERGED]
MERGED_STD = [*MERGE, priced("merged"), standard("std", "priced_")]
LONGEST = ("longest AS (SELECT job_id, trim(jd) AS jd FROM (SELECT job_id, jd, 1 AS src, pos FROM details) WHERE trim(jd) <> ''"
           " QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY length(trim(jd)) DESC, src, pos) = 1)")
oracle("consolidate_manifest", f"""SELECT (SELECT count(DISTINCT batch_path) FROM raw) AS source_files,
    (SELECT count(*) FROM scored) AS raw_records, (SELECT count(*) FROM merged) AS unique_jobs,
    (SELECT count(*) FROM {first('std')}) AS valid_rows,
    (SELECT count(*) FROM longest WHERE job_id <> '') AS jobs_with_jd,
    (SELECT count(*) FROM std JOIN longest USING (job_id)) AS rows_with_jd""", *MERGED_STD, "details", LONGEST)

# --- served table -------------------------------------------------------------------------------------------------
CELLS = "cells AS (SELECT pos, " + ", ".join(
    f"{e} AS {V.HEADER_ALIASES.get(h, h)}" for h, e in I.CSV_CELLS.items()) + " FROM raw)"


def safe(c: str, default: str = "未知") -> str:
    return f"CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'nan', 'None') THEN '{default}' ELSE trim({c}) END"


def cell_salary(c: str) -> str:
    return (rf"TRY_CAST(nullif(regexp_extract(lower({c}), '\d+(?:\.\d+)?'), '') AS DOUBLE) * "
            f"CASE WHEN contains(lower({c}), 'k') OR contains(lower({c}), '千') THEN 1000 ELSE 1 END")


PAIR = rf"""q0 AS (SELECT *, {cell_salary('salary_low')} AS l, {cell_salary('salary_high')} AS h,
    regexp_extract_all(lower(salary), '\d+(?:\.\d+)?') AS nums,
    CASE WHEN contains(lower(salary), 'k') OR contains(salary, '千') THEN 1000 ELSE 1 END::DOUBLE AS f FROM cells),
    q1 AS (SELECT *, CASE WHEN l IS NULL AND h IS NULL THEN nums[1]::DOUBLE * f ELSE coalesce(l, h) END AS a,
        CASE WHEN l IS NULL AND h IS NULL THEN coalesce(nums[2], nums[1])::DOUBLE * f ELSE coalesce(h, l) END AS b FROM q0),
    q2 AS (SELECT * EXCLUDE (salary_low, salary_high), least(a, b) AS salary_low, greatest(a, b) AS salary_high FROM q1)"""
YEARS = r"replace(work_years, '年', '')"
NUMERIC_YEARS = rf"TRY_CAST(CASE WHEN regexp_matches({YEARS}, '^[0-9.]+$') THEN {YEARS} END AS DOUBLE)"


def years_label(column: str) -> str:
    number = NUMERIC_YEARS.replace("work_years", column)
    return (f"CASE WHEN {number} <= 0 THEN '应届/无经验' WHEN {number} <= 3 THEN '1-3年' WHEN {number} <= 5 THEN '3-5年' "
            f"WHEN {number} IS NOT NULL THEN '5年以上' ELSE {safe(column)} END")


SAFE_ROWS = f"""safe_rows AS (SELECT pos, {safe('job_name', '')} AS job_name, {safe('company')} AS company,
    {safe('city')} AS city, salary_low, salary_high, {safe('education')} AS education, {safe('work_years')} AS work_years,
    {safe('category')} AS category, {safe('skills', '')} AS skills, {safe('description', '')} AS description FROM q2
    WHERE salary_low IS NOT NULL AND trim(job_name) NOT IN ('', 'nan', 'None'))"""
SERVED_ROWS = f"""served AS (SELECT *, (salary_low + salary_high) / 2 AS avg_salary, {years_label('work_years')} AS experience,
    row_number() OVER (ORDER BY pos) AS job_id FROM {first('safe_rows')})"""
SERVED = ["raw", CELLS, PAIR, SAFE_ROWS, SERVED_ROWS]
CLEAN = ", ".join(V.CLEAN_COLUMNS)
SHOWN = ", ".join(c for c in V.CLEAN_COLUMNS if c != "job_id")
oracle("clean", f"SELECT {CLEAN} FROM served", *SERVED)
oracle("csv_ingest", f"SELECT {CLEAN} FROM served", *SERVED)
oracle("csv_split", "SELECT doc_id, source, lang, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS text_md5 FROM documents")
oracle("export_rows", "SELECT " + ", ".join(f'{c} AS "{h}"' for c, h in V.EXPORT_HEADERS.items())
       + " FROM served WHERE city = '杭州·西湖·N'", *SERVED)
oracle("export_raw", "SELECT " + ", ".join(V.LIST_EXPORT_COLUMNS) + " FROM raw", "raw")
oracle("export_detail", "SELECT job_id, '' AS title, company, '' AS salary, '' AS salary_source, '' AS location, "
       "'' AS boss_active_status, '' AS tags_list, '' AS job_link, replace(tag_text, '|', ' | ') AS skill_tags, "
       "md5(jd) AS jd FROM details", "details")
oracle("job_page", f"SELECT {CLEAN} FROM served WHERE job_id <= 50", *SERVED)
oracle("job_by_id", f"SELECT {CLEAN} FROM served WHERE job_id = 1234", *SERVED)
oracle("filter_dims", f"SELECT {SHOWN} FROM served WHERE education = '大专' AND experience = '1-3年' AND category = '金融'",
       *SERVED)
oracle("filter_layout", f"""SELECT {SHOWN} FROM served WHERE education = '大专' AND experience = '1-3年' AND category = '金融'
    AND avg_salary >= 5000""", *SERVED)
for _name in ("filter_keyword", "search_keyword"):
    oracle(_name, f"""SELECT {SHOWN} FROM served WHERE concat_ws(chr(10), upper(job_name), upper(company),
    upper(category), upper(skills), upper(description)) LIKE '%C++%'""", *SERVED)
oracle("filter_salary", f"SELECT {SHOWN} FROM served WHERE avg_salary BETWEEN 10000 AND 15000", *SERVED)
SKILL_ROWS = ("skill_rows AS (SELECT trim(s) AS name FROM (SELECT unnest(string_split(skills, ',')) AS s FROM served) "
              "WHERE trim(s) <> '')")
oracle("summary", """SELECT count(*) AS total_jobs, round(avg(avg_salary), 2) AS avg_salary,
    count(DISTINCT city) AS city_count, count(DISTINCT category) AS category_count,
    (SELECT name FROM skill_rows GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) AS top_skill FROM served""",
       *SERVED, SKILL_ROWS)
oracle("top_city", counts("served", "city", 10), *SERVED)
oracle("top_category", counts("served", "category", 10), *SERVED)
oracle("top_company", counts("served", "company", 8), *SERVED)
oracle("education_counts", counts("served", "education"), *SERVED)


def label_rows(labels: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels)) + ") AS v(ord, name)"


oracle("experience_counts", f"""SELECT ord, name, count(*) AS value FROM {label_rows(V.EXPERIENCE_ORDER)}
    JOIN served ON experience = name GROUP BY ord, name""", *SERVED)
BUCKET = "CASE " + " ".join(f"WHEN avg_salary < {u} THEN '{x}'" for x, u in zip(
    V.SALARY_LABELS, V.SALARY_EDGES[1:], strict=False)) + f" ELSE '{V.SALARY_LABELS[-1]}' END"
oracle("salary_hist", f"""SELECT ord, name, count(bucket) AS value FROM {label_rows(V.SALARY_LABELS)} LEFT JOIN (
    SELECT {BUCKET} AS bucket FROM (SELECT (salary_low + salary_high) / 2 AS avg_salary FROM {first('std')})) ON bucket = name
    GROUP BY ord, name""", *STD_ROWS)
oracle("skill_counts", counts("skill_rows", limit=12), *SERVED, SKILL_ROWS)
CJK = r"\x{4e00}-\x{9fff}"
WORDS = rf"[A-Za-z][A-Za-z0-9+#.-]*|[{CJK}]{{2,}}"
oracle("keyword_counts", counts(f"""(SELECT name FROM skill_rows UNION ALL SELECT w FROM (
    SELECT unnest(regexp_extract_all(description, '{WORDS}')) AS w FROM served) WHERE w NOT IN ({quoted(V.STOP_WORDS)}))""",
                                limit=20), *SERVED, SKILL_ROWS)
FILTERED = "f AS (SELECT * FROM served WHERE avg_salary >= 5000)"
oracle("dashboard_counts", " UNION ALL ".join([
    *[f"(SELECT '{d}' AS dim, name, value FROM ({counts('f', d, n)}))"
      for d, n in (("city", 10), ("category", 10), ("company", 8))],
    f"(SELECT 'education' AS dim, name, value FROM ({counts('f', 'education')}))",
    f"(SELECT 'experience' AS dim, name, value FROM ("
    f"{counts('f', 'experience', where=f'experience IN ({quoted(V.EXPERIENCE_ORDER)})')}))",
    f"(SELECT 'salary' AS dim, name, value FROM ({counts('f', BUCKET)}))",
]), *SERVED, FILTERED)
oracle("options", " UNION ALL ".join([
    *[f"SELECT DISTINCT '{d}' AS dim, 0 AS ord, {d} AS name FROM served" for d in ("city", "education", "category")],
    f"SELECT DISTINCT 'experience' AS dim, ord + 1 AS ord, name FROM {label_rows(V.EXPERIENCE_ORDER)} "
    "JOIN served ON experience = name",
]), *SERVED)
oracle("data_source", "SELECT 'postings.csv' AS source, count(*) AS count FROM served", *SERVED)

# --- projections --------------------------------------------------------------------------------------------------


def counted(select: str, source: str, n: int) -> str:
    return f"SELECT {select}, count(*) AS n FROM {source} GROUP BY {', '.join(str(i) for i in range(1, n + 1))}"


oracle("clean_aliases", counted("job_name, company, coalesce(category, '其他') AS category, education, '' AS work_years",
                                "cells", 5), "raw", CELLS)
oracle("clean_text", counted(f"education AS education_raw, {safe('education')} AS education, {safe('company')} AS company, "
                             f"{safe('job_name', '')} AS job_name", "cells", 4), "raw", CELLS)
oracle("salary_single", counted(f"salary, {cell_salary('salary')} AS value", "raw", 2), "raw")
oracle("salary_pair", counted("salary, salary_low, salary_high", "q2", 3), "raw", CELLS, PAIR)
oracle("salary_monthly", counted("salary, salary_low, salary_high", "priced_", 3), "raw", priced("raw"))
oracle("unpriced", "SELECT count(salary_low) AS priced, count(*) - count(salary_low) AS unpriced FROM priced_",
       "raw", priced("raw"))
oracle("city_of_location", counted(f"location, {city('batch_city')} AS city, {city()} AS city_only", "raw", 3), "raw")
oracle("experience_label", counted(f"work_years, {years_label('work_years')} AS experience", "cells", 2), "raw", CELLS)
oracle("experience_of_tags", counted(f"tags, title, {experience('tags')} AS experience", "raw", 3), "raw")
oracle("education_of_tags", counted(f"tags, {education('tags')} AS education", "raw", 2), "raw")
oracle("skills_normalize", counted(f"skills, {SKILLS} AS normalized", "raw", 2), "raw")
FLAT = r"trim(regexp_replace(text, '[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'))"
oracle("desc_flatten", f"SELECT doc_id, length({FLAT}) AS chars, md5({FLAT}) AS flat_md5 FROM documents")
oracle("tokens", f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS token
    FROM documents) WHERE token NOT IN ({quoted(V.STOP_WORDS)}) GROUP BY token""")
oracle("source_id", counted("left(md5(coalesce(nullif(job_link, ''), title)), 16) AS source_id", "raw", 1), "raw")
oracle("active_status", counted("""boss_title, boss_active_status, CASE WHEN boss_title NOT IN ('HR', '') THEN boss_title
    WHEN boss_active_status <> '' THEN boss_active_status WHEN boss_title = 'HR' THEN '在线' ELSE '' END AS status""",
                                "raw", 3), "raw")


def family(title: str) -> str:
    order = [(f, k) for f, _n, ks, _w in V.FAMILIES for k in ks]
    order += [(f, t) for f in V.FAMILY_MATCH_ORDER for t in V.FAMILY_TERMS[f]]
    terms = "[" + quoted([t.lower() for _f, t in order]) + "]"
    names = "[" + quoted([f for f, _t in order]) + "]"
    hits = f"list_transform({terms}, lambda x: contains(lower({title}), x))"
    return f"coalesce({names}[list_position({hits}, true)], '{V.OTHER_FAMILY}')"


TITLE_FAMILIES = f"families_ AS (SELECT title AS t, {family('title')} AS fid FROM (SELECT DISTINCT title FROM raw))"
oracle("family_of_title", counted("title, fid AS family_id", "raw JOIN families_ ON t = title", 2), "raw", TITLE_FAMILIES)
oracle("completeness", counted(f"CAST({SCORE} AS BIGINT) AS score", "raw", 1), "raw")


def weight(c: str) -> str:
    tiers = " ".join(f"WHEN {c} IN ({quoted(names)}) THEN {w}" for names, w in V.CITY_TIERS.values())
    return f"CAST(CASE WHEN {c} = '全国' THEN 12 {tiers} ELSE 1 END AS DOUBLE)"


def display(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.CITY_DISPLAY.items()) + f" ELSE {c} END"


oracle("city_dim", f"""SELECT city, {display('city')} AS display_city, {weight('city')} AS weight,
    sqrt({weight('city')}) AS market_factor FROM cities""", "cities")
oracle("dim_cities", "SELECT city, code FROM cities WHERE city <> '全国'", "cities")
CODE_ROWS = "(VALUES " + ", ".join(
    f"('{d}', '{n}', '{label}', '{code}')" for d, (n, codes) in V.FILTER_CODES.items() for label, code in codes.items()
) + ") AS v(domain, domain_name, label, code)"
oracle("filter_decode", f"""SELECT DISTINCT batch_no, domain, code, concat(domain_name, '=', label) AS text FROM (
    SELECT batch_no, 'scale' AS d, company_scale AS l FROM raw UNION ALL SELECT batch_no, 'stage', company_stage FROM raw)
    JOIN {CODE_ROWS} ON domain = d AND label = l""", "raw")
NOISE = V.BENEFIT_WORDS + V.NOISE_WORDS
oracle("tag_filter", f"""SELECT doc_id, array_to_string(list_filter(string_split(tag_text, '|'), lambda x:
    length(x) BETWEEN 2 AND 15 AND x <> '...' AND NOT regexp_matches(x, '{'|'.join(NOISE)}')), '|') AS kept FROM pages_""",
       "pages_")

# --- captured pages and responses ---------------------------------------------------------------------------------
PAGE_STEPS = rf"""
    g0 AS (SELECT *, concat(jd, chr(10), page_text) AS everything,
        CASE WHEN jd = '' AND contains(page_text, '职位描述') THEN page_text ELSE jd END AS chosen FROM pages_),
    g1 AS (SELECT *, string_split(CASE WHEN contains(chosen, '职位描述')
        THEN substr(chosen, instr(chosen, '职位描述') + 4) ELSE chosen END, chr(10)) AS ls FROM g0),
    g2 AS (SELECT *, list_transform(ls, lambda x: trim(x)) AS ts FROM g1),
    g3 AS (SELECT *, coalesce(list_position(ts, '竞争力分析'), 0) AS c_at, coalesce(list_position(ts, 'BOSS 安全提示'), 0) AS s_at
        FROM g2),
    g4 AS (SELECT *, [CASE WHEN c_at > 0 THEN c_at - 1 ELSE -1 END, CASE WHEN s_at > 0 THEN s_at - 1 ELSE -1 END, len(ts)]
        AS ends FROM g3),
    g5 AS (SELECT *, list_transform(ends, lambda e: list_max(list_filter(range(1, greatest(e, 0) + 1), lambda i: ts[i] <> '')))
        AS solid FROM g4),
    g6 AS (SELECT *, list_filter(solid, lambda k: k >= 4 AND ts[k - 1] = '·'
        AND (NOT (ts[k - 3] = '在线' OR ts[k - 3] LIKE '%活跃') OR k >= 5))[1] AS k FROM g5),
    g7 AS (SELECT *, coalesce(ts[k - 3] = '在线' OR ts[k - 3] LIKE '%活跃', false) AS active FROM g6),
    g8 AS (SELECT *, CASE WHEN k IS NOT NULL THEN ls[1:k - CASE WHEN active THEN 5 ELSE 4 END]
        WHEN s_at > 0 THEN ls[1:s_at - 1] ELSE ls END AS kept FROM g7),
    g9 AS (SELECT *, regexp_replace(regexp_replace(trim(array_to_string(list_transform(kept, lambda x: rtrim(x)), chr(10)),
        concat(' ', chr(10))), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), '[ \t]{{2,}}', ' ', 'g') AS body FROM g8),
    extracted AS (SELECT doc_id, job_link, tag_text, body, active, CASE WHEN active THEN ts[k - 3] ELSE '' END AS status,
        CASE WHEN contains(everything, '登录查看完整内容') THEN 'login'
        WHEN NOT contains(everything, '职位描述') AND contains(everything, '无障碍专区') AND contains(everything, '首页')
            AND contains(everything, '职位') AND contains(everything, '公司') THEN 'navigation'
        WHEN length(body) < 120 THEN 'too_short' END AS reject_reason FROM g9)"""
oracle("jd_extract", """SELECT doc_id, reject_reason, CASE WHEN reject_reason IS NULL THEN status END AS activity,
    CASE WHEN reject_reason IS NULL THEN length(body) END AS chars,
    CASE WHEN reject_reason IS NULL THEN md5(body) END AS description_md5 FROM extracted""", "pages_", PAGE_STEPS)
oracle("jd_reject_counts", "SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM extracted GROUP BY 1",
       "pages_", PAGE_STEPS)
oracle("detail_records", f"""SELECT r.job_id, title, boss_name AS company, salary, salary_source, location,
    coalesce(nullif(status, ''), trim(boss_active_status)) AS boss_active_status, tags AS tags_list, job_link,
    job_link AS link, md5(body) AS jd_md5, array_to_string(list_filter(string_split(tag_text, '|'), lambda x:
    length(x) BETWEEN 2 AND 15 AND x <> '...' AND NOT regexp_matches(x, '{'|'.join(NOISE)}')), '|') AS skill_tags
    FROM (SELECT * FROM raw WHERE job_link <> '' QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY pos) = 1) r
    JOIN extracted USING (job_link) WHERE reject_reason IS NULL""", "raw", "pages_", PAGE_STEPS)
oracle("response_status", """SELECT event_id, CASE WHEN http_status = 401 THEN 'unauthenticated'
    WHEN http_status IN (403, 429) THEN 'restricted' WHEN http_status <> 200 THEN 'response_error'
    WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'response_error'
    WHEN CAST(body ->> '$.code' AS INT) IN (31, 37) THEN 'restricted'
    WHEN CAST(body ->> '$.code' AS INT) <> 0 THEN CASE WHEN regexp_matches(coalesce(body ->> '$.message', body ->> '$.msg'),
        '环境存在异常|访问频繁|操作太频繁|安全校验|滑块|验证') THEN 'restricted' ELSE 'response_error' END
    WHEN json_type(body, '$.zpData.jobList') IS NULL THEN 'response_error'
    WHEN json_array_length(body, '$.zpData.jobList') = 0 THEN 'empty'
    WHEN regexp_matches(body, '"salaryDesc":"[^"]') THEN 'available' ELSE 'unauthenticated' END AS status FROM responses""",
       "responses")


def j(name: str) -> str:
    return f"coalesce(job ->> '$.{name}', '')"


oracle("flatten_response", f"""SELECT event_id, idx, {j('jobName')} AS title, {j('salaryDesc')} AS salary,
    CASE WHEN {j('salaryDesc')} <> '' THEN 'api' ELSE 'api_empty' END AS salary_source,
    concat({j('cityName')}, '·', {j('areaDistrict')}, '·', {j('businessDistrict')}) AS location,
    array_to_string(list_filter([{j('jobExperience')}, {j('jobDegree')}], lambda x: x NOT IN ('', '不限')), ' | ') AS tags,
    {j('brandName')} AS boss_name, '' AS boss_title, CASE WHEN {j('activeTimeDesc')} <> '' THEN {j('activeTimeDesc')}
    WHEN job ->> '$.bossOnline' = 'true' THEN '在线' ELSE '' END AS boss_active_status, '' AS company_scale,
    '' AS company_stage, '' AS company_industry, 'a | b' AS job_labels, 'SQL' AS skills, '' AS security_id, '' AS lid,
    {j('encryptJobId')} AS encrypt_job_id, '' AS encrypt_boss_id, '' AS encrypt_brand_id, link AS job_link,
    '' AS company_link, '' AS welfare, left(md5(coalesce(nullif(link, ''), {j('jobName')})), 16) AS job_id FROM (
    SELECT *, CASE WHEN {j('encryptJobId')} <> '' THEN concat('https://www.zhipin.com/job_detail/', {j('encryptJobId')}, '.html')
    ELSE '' END AS link FROM (SELECT event_id, i AS idx, json_extract(body, concat('$.zpData.jobList[', i, ']')) AS job
    FROM responses, unnest(range(3)) AS r(i) WHERE json_valid(body)) WHERE json_type(job) = 'OBJECT')""", "responses")

# --- import -------------------------------------------------------------------------------------------------------
JOINED = ("joined AS (SELECT raw.*, latest.company AS detail_company, latest.jd AS jd FROM raw LEFT JOIN pairs "
          "USING (batch_path) LEFT JOIN latest ON latest.detail_path = pairs.detail_path AND latest.job_id = raw.job_id)")
IMPORT = ["raw", "details", PAIRS, LATEST, JOINED, priced("joined"),
          standard("std", "priced_", "coalesce(nullif(detail_company, ''), boss_name)", "batch_city",
                   FLAT.replace("regexp_replace(text,", "regexp_replace(coalesce(jd, ''),"))]
oracle("import_join", f"""SELECT batch_path, job_id, {', '.join(c for c in V.STANDARD_COLUMNS if c != 'description')},
    md5(description) AS description_md5 FROM std""", *IMPORT)
oracle("import_stats", """SELECT batch_path, min(keyword) AS keyword, min(batch_city) AS city, count(*) AS raw,
    (SELECT count(*) FROM std WHERE std.batch_path = raw.batch_path) AS converted,
    (SELECT count(*) FROM std WHERE std.batch_path = raw.batch_path AND description <> '') AS with_jd,
    count(*) - (SELECT count(*) FROM std WHERE std.batch_path = raw.batch_path) AS skipped_no_salary
    FROM raw GROUP BY batch_path""", *IMPORT)
oracle("import_filtered", f"""SELECT batch_path, job_id, {STD} FROM std WHERE city = '杭州' AND contains(job_name, 'Java')""",
       *STD_ROWS)
oracle("dedupe_business", f"SELECT batch_path, job_id, {STD} FROM {first('std')}", *STD_ROWS)


def greedy(rounds: int) -> list[str]:
    """Rounds of the ordered two-key duplicate removal, unrolled; the last one fails when a row is still undecided."""
    steps = [f"u0 AS (SELECT pos, nullif(job_id, '') AS id, concat_ws(chr(1), {KEY}) AS k FROM std)"]
    for i in range(rounds):
        steps.append(
            f"j{i} AS MATERIALIZED (SELECT *, (id IS NULL OR pos = min(pos) OVER (PARTITION BY id)) "
            f"AND pos = min(pos) OVER (PARTITION BY k) AS keep FROM u{i})")
        steps.append(
            f"u{i + 1} AS (SELECT pos, id, k FROM j{i} WHERE NOT keep AND k NOT IN (SELECT k FROM j{i} WHERE keep) "
            f"AND (id IS NULL OR id NOT IN (SELECT id FROM j{i} WHERE keep AND id IS NOT NULL)))")
    kept = " UNION ALL ".join(f"SELECT pos FROM j{i} WHERE keep" for i in range(rounds))
    steps.append(f"kept AS ({kept} UNION ALL SELECT CASE WHEN error('undecided rows') IS NULL THEN pos END FROM u{rounds})")
    return steps


oracle("dedupe_greedy", f"SELECT batch_path, job_id, {STD} FROM std WHERE pos IN (SELECT pos FROM kept)",
       *STD_ROWS, *greedy(9))
oracle("dedupe_link", """SELECT batch_path, job_link, title, salary, boss_name FROM raw QUALIFY row_number() OVER (
    PARTITION BY batch_path, coalesce(nullif(job_link, ''), title) ORDER BY pos) = 1""", "raw")
oracle("detail_once_per_link", """SELECT job_link, title, salary, boss_name, batch_path FROM raw WHERE job_link <> ''
    QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY pos) = 1""", "raw")
oracle("best_snapshot", f"SELECT job_id, {', '.join(BEST_FIELDS)}, boss_name, batch_path, snapshots FROM best",
       "raw", SCORED, BEST)
oracle("merge_complete", f"SELECT job_id, {', '.join(BEST_FIELDS)}, boss_name, batch_path, snapshots FROM merged", *MERGE)
oracle("merge_std", f"SELECT {STD} FROM {first('std')}", *MERGED_STD)
oracle("provenance", "SELECT DISTINCT job_id, concat(batch_city, '|', keyword, '|', batch_dir) AS source FROM raw "
       "WHERE job_id <> ''", "raw")
oracle("jd_global", """SELECT job_id, length(trim(jd)) AS chars, md5(trim(jd)) AS jd_md5 FROM (
    SELECT job_id, job_labels AS jd, 0 AS src, pos FROM raw UNION ALL SELECT job_id, jd, 1, pos FROM details)
    WHERE job_id <> '' AND trim(jd) <> ''
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY length(trim(jd)) DESC, src, pos) = 1""", "raw", "details")
oracle("consolidate_incremental", f"""SELECT job_id, {', '.join(f'merged.{f}' for f in BEST_FIELDS)}, boss_name, batch_path, snapshots,
    length(coalesce(l.jd, '')) AS chars, md5(coalesce(l.jd, '')) AS jd_md5 FROM merged LEFT JOIN (
    SELECT job_id, trim(jd) AS jd FROM (
    SELECT job_id, job_labels AS jd, 0 AS src, pos FROM raw UNION ALL SELECT job_id, jd, 1, pos FROM details)
    WHERE job_id <> '' AND trim(jd) <> ''
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY length(trim(jd)) DESC, src, pos) = 1) l USING (job_id)""", *MERGE, "details")
oracle("upsert_keep", """SELECT job_id, title, salary, batch_dir FROM raw WHERE batch_dir < '1998' UNION ALL
    SELECT job_id, title, salary, batch_dir FROM (SELECT * FROM raw WHERE batch_dir >= '1998'
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos) = 1)
    WHERE job_id NOT IN (SELECT job_id FROM raw WHERE batch_dir < '1998')""", "raw")
oracle("upsert_override", """SELECT job_id, title, salary, batch_dir,
    CASE WHEN min(batch_dir) OVER (PARTITION BY job_id) < '1998' THEN 0 ELSE 1 END AS first_seen_in FROM raw
    WHERE job_id <> '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos DESC) = 1""", "raw")

oracle("import_archive", """SELECT keyword, batch_city AS city, count(DISTINCT batch_path) AS batches, count(*) AS raw,
    count(salary_low) AS converted, 0::BIGINT AS with_jd, count(*) - count(salary_low) AS skipped_no_salary FROM priced_
    GROUP BY 1, 2""", "raw", priced("raw"))
oracle("merge_archive", """SELECT (SELECT count(DISTINCT coalesce(nullif(keyword, ''), '?')) FROM raw) AS keywords,
    (SELECT count(DISTINCT coalesce(nullif(batch_city, ''), '?')) FROM raw) AS cities, count(*) AS raw_with_id,
    count(DISTINCT job_id) AS unique_ids, round(count(*) / count(DISTINCT job_id), 1) AS mean_repeats FROM raw
    WHERE job_id <> ''""", "raw")

# --- quality ------------------------------------------------------------------------------------------------------
oracle("import_overview", " UNION ALL ".join([
    "SELECT 'total' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM d",
    "SELECT 'total', 'mean_low', round(avg(salary_low), 2) FROM d",
    "SELECT 'total', 'mean_high', round(avg(salary_high), 2) FROM d",
    *[f"(SELECT '{c}', name, value::DOUBLE FROM ({counts('d', c, n)}))"
      for c, n in (("city", 8), ("category", 5), ("education", 6), ("work_years", None))],
]), *STD_ROWS, f"d AS (SELECT * FROM {first('std')})")
oracle("merge_distributions", " UNION ALL ".join([
    "SELECT 'total' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM d",
    "SELECT 'total', 'cities', count(DISTINCT city) FROM d", "SELECT 'total', 'industries', count(DISTINCT category) FROM d",
    "SELECT 'total', 'mean_low', round(avg(salary_low), 0) FROM d", "SELECT 'total', 'mean_high', round(avg(salary_high), 0) FROM d",
    *[f"(SELECT '{c}', name, value::DOUBLE FROM ({counts('d', c, n)}))"
      for c, n in (("city", 12), ("category", 8), ("education", 6), ("work_years", None))],
]), *MERGED_STD, f"d AS (SELECT * FROM {first('std')})")
oracle("merge_overview", f"""SELECT (SELECT count(DISTINCT coalesce(nullif(keyword, ''), '?')) FROM raw) AS keywords,
    (SELECT count(DISTINCT coalesce(nullif(batch_city, ''), '?')) FROM raw) AS cities, raw_with_id, unique_ids,
    round(raw_with_id / unique_ids, 1) AS mean_repeats, unique_ids - valid AS skipped_no_salary, valid, final,
    valid - final AS removed_by_key, round(100.0::DOUBLE * with_skills / final, 0) AS with_skills_pct FROM (
    SELECT (SELECT count(*) FROM scored) AS raw_with_id, (SELECT count(*) FROM best) AS unique_ids,
    (SELECT count(*) FROM std) AS valid, count(*) AS final, count(*) FILTER (skills <> '') AS with_skills
    FROM {first('std')})""", *MERGED_STD)
oracle("dup_profile", """SELECT count(*) AS total, count(*) FILTER (job_id = '') AS without_id,
    count(DISTINCT nullif(job_id, '')) AS distinct_ids,
    count(DISTINCT concat_ws(chr(1), trim(title), trim(boss_name), trim(split_part(location, '·', 1)), trim(salary))) AS distinct_keys,
    count(*) FILTER (trim(salary) IN ('', '-', '面议')) AS without_salary FROM raw""", "raw")
oracle("dup_multiplicity", """SELECT times, count(*) AS ids FROM (SELECT count(*) AS times FROM raw WHERE job_id <> ''
    GROUP BY job_id) GROUP BY times ORDER BY times LIMIT 12""", "raw")
oracle("dup_field_drift", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{f}' AS field, count(*) AS rows FROM (SELECT trim({f}) <> first_value(trim({f})) OVER "
    f"(PARTITION BY job_id ORDER BY pos) AS differs FROM raw WHERE job_id <> '') WHERE differs) WHERE rows > 0"
    for f in V.DRIFT_FIELDS), "raw")
oracle("dup_samples", " UNION ALL ".join(
    f"SELECT job_id, times, '{f}' AS field, array_to_string(vs[1:3], ' / ') AS \"values\" FROM (SELECT job_id, times, "
    f"list(v ORDER BY p) AS vs FROM (SELECT job_id, times, trim({f}) AS v, min(pos) AS p FROM s WHERE rn <= 4 "
    f"GROUP BY ALL) GROUP BY ALL) WHERE len(vs) > 1" for f in V.DRIFT_FIELDS), "raw",
    """s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS rn, times FROM raw JOIN (
    SELECT job_id, count(*) AS times, min(pos) AS p FROM raw WHERE job_id <> '' GROUP BY job_id HAVING count(*) > 1
    ORDER BY p LIMIT 3) USING (job_id))""")
oracle("batch_dims", f"""SELECT 'city' AS dim, * FROM ({counts('b', 'batch_city', 10)}) UNION ALL
    SELECT 'keyword' AS dim, * FROM ({counts('b', 'keyword', 20)})""", "raw",
       f"b AS (SELECT CASE WHEN {BATCH_KIND} IN (2, 3) THEN '?' ELSE keyword END AS keyword, CASE WHEN {BATCH_KIND} IN (2, 3) "
       f"THEN '?' ELSE batch_city END AS batch_city FROM raw WHERE {BATCH_KIND} NOT IN (1, 4, 5, 8, 9))")
oracle("batch_quality", """SELECT batch_path, bool_or(title <> '' AND salary <> '' AND job_link <> '' AND salary_source = 'api')
    AS usable FROM raw GROUP BY batch_path""", "raw")
YIELDS = {name: f"""SELECT {column} AS name, count(*) AS records, count(DISTINCT nullif(job_id, '')) AS distinct_ids,
    round(100.0::DOUBLE * count(DISTINCT nullif(job_id, '')) / count(*), 1) AS yield_pct FROM raw GROUP BY 1"""
          for name, column in (("yield_city", "batch_city"), ("yield_keyword", "keyword"))}
TOTAL = """SELECT count(*) AS records, count(DISTINCT job_id) AS distinct_ids,
    round(100.0::DOUBLE * count(DISTINCT job_id) / count(*), 1) AS yield_pct FROM raw WHERE job_id <> ''"""
OVERLAP = """SELECT count(*) AS ids, round(avg(k), 2) AS mean_keywords, round(avg(c), 2) AS mean_cities,
    count(*) FILTER (k > 1) AS multi_keyword_ids, round(100.0::DOUBLE * count(*) FILTER (k > 1) / count(*), 0)
    AS multi_keyword_pct FROM (SELECT count(DISTINCT keyword) AS k, count(DISTINCT batch_city) AS c FROM raw
    WHERE job_id <> '' GROUP BY job_id)"""
oracle("yield_total", TOTAL, "raw")
for _name, _query in YIELDS.items():
    oracle(_name, _query, "raw")
for _name in ("yield_overlap", "yield_bitmap_overlap"):
    oracle(_name, OVERLAP, "raw")
oracle("yield_bitmaps", f"""SELECT 'total' AS dim, '' AS name, * FROM ({TOTAL}) UNION ALL SELECT 'keyword', *
    FROM ({YIELDS['yield_keyword']}) UNION ALL SELECT 'batch_city', * FROM ({YIELDS['yield_city']})""", "raw")
oracle("new_ids", """SELECT DISTINCT job_id FROM raw WHERE batch_dir = '2001' AND job_id <> ''
    AND job_id NOT IN (SELECT job_id FROM raw WHERE batch_dir < '2001')""", "raw")
BATCH_YIELD = """ids AS (SELECT DISTINCT batch_no, job_id, batch_no % 13 = 0 AS lost FROM raw WHERE job_id <> ''),
    fresh AS (SELECT i.batch_no, count(*) AS new FROM ids i WHERE NOT EXISTS (SELECT 1 FROM ids e WHERE e.job_id = i.job_id
        AND e.batch_no < i.batch_no AND NOT e.lost) GROUP BY 1),
    yields AS (SELECT r.batch_no, count(*) AS raw, coalesce(any_value(new), 0) AS new, greatest(0, count(*) - coalesce(any_value(new), 0)) AS dup,
        CASE WHEN r.batch_no % 13 = 0 THEN 'failed' WHEN coalesce(any_value(new), 0) = 0 THEN 'saturated' ELSE 'done' END AS status,
        count(*) >= 1200 AS truncated FROM raw r LEFT JOIN fresh USING (batch_no) GROUP BY r.batch_no)"""
oracle("batch_yield", "SELECT * FROM yields", "raw", BATCH_YIELD)
oracle("run_summary", """SELECT count(*) AS executed, sum(new)::BIGINT AS new_jobs, sum(raw)::BIGINT AS raw,
    round(sum(new) * 100.0::DOUBLE / sum(raw), 0) AS yield_pct FROM yields""", "raw", BATCH_YIELD)

oracle("ledger_round_trip", """SELECT city, family_id, slice_id, status, raw, new, (SELECT count(*) FROM yields) AS executed
    FROM combos""", "raw", "combos", BATCH_YIELD)

# --- coverage -----------------------------------------------------------------------------------------------------
COVERAGE = [
    "raw", TITLE_FAMILIES,
    "once AS (SELECT * FROM raw WHERE job_id <> '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos) = 1 "
    "UNION ALL SELECT * FROM raw WHERE job_id = '')",
    f"placed AS (SELECT {city()} AS city, fid AS family_id FROM once JOIN families_ ON t = title)",
    "cc AS (SELECT city, count(*) AS n FROM placed GROUP BY 1)",
    "fc AS (SELECT family_id, count(*) AS n FROM placed GROUP BY 1)",
    "cells_ AS (SELECT city, family_id, count(*) AS n FROM placed GROUP BY 1, 2)",
]
oracle("coverage_counts", "SELECT 'city' AS kind, city, NULL AS family_id, n FROM cc UNION ALL "
       "SELECT 'family', NULL, family_id, n FROM fc UNION ALL SELECT 'cell', city, family_id, n FROM cells_", *COVERAGE)
oracle("report_city_coverage", f"""SELECT row_number() OVER (ORDER BY coalesce(n, 0), cities.city) AS rank,
    cities.city, {display('cities.city')} AS display_city, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN '空白'
    WHEN n < 20 THEN '薄弱' ELSE '已覆盖' END AS state FROM cities LEFT JOIN cc ON cc.city = cities.city""", "cities", *COVERAGE)
FAMILY_ROWS = "fam AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}', '{n}', '{' / '.join(k[:3])}', {w}::DOUBLE, [{quoted(k)}])" for i, (f, n, k, w) in enumerate(V.FAMILIES)
) + ") AS v(ord, family_id, family, keywords, weight, words))"
oracle("report_family_coverage", """SELECT ord, family, keywords, coalesce(n, 0) AS n,
    (SELECT count(*) FROM combos c WHERE c.family_id = fam.family_id AND status = 'done') AS ran
    FROM fam LEFT JOIN fc USING (family_id)""", "combos", FAMILY_ROWS, *COVERAGE)
oracle("coverage_extremes", f"""(SELECT 'least' AS kind, city AS name, n FROM cc ORDER BY n, city LIMIT 8) UNION ALL
    (SELECT 'most', city, n FROM cc ORDER BY n DESC, city LIMIT 5) UNION ALL (SELECT 'family',
    coalesce((SELECT family FROM fam WHERE fam.family_id = fc.family_id), family_id), n FROM fc
    ORDER BY n DESC, family_id LIMIT 6)""", FAMILY_ROWS, *COVERAGE)
oracle("ledger_keys", """SELECT CASE WHEN slice_id = '' THEN concat(city, '|', family_id) ELSE
    concat(city, '|', family_id, '|', slice_id) END AS key, city, family_id, slice_id FROM combos""", "combos")
oracle("ledger_status", "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in (
    "done", "saturated", "failed")) + " FROM combos", "combos")
SLICES_DONE = ("sd AS (SELECT city, family_id, count(*) AS slices_done FROM combos WHERE slice_id <> '' "
               "AND status IN ('done', 'saturated') GROUP BY 1, 2)")
oracle("ledger_slices", "SELECT * FROM sd", "combos", SLICES_DONE)
SLICE_NAME = "CASE slice_id " + " ".join(f"WHEN '{s}' THEN '{n}'" for d in V.SLICES.values() for s, n in d) + " ELSE '—' END"
LEDGER_SHOWN = f"""{display('city')} AS city, coalesce((SELECT family FROM fam WHERE fam.family_id = combos.family_id), family_id)
    AS family, keyword, {SLICE_NAME} AS slice, raw, new, run_at"""
oracle("ledger_listing", f"SELECT {LEDGER_SHOWN}, round(dup * 100.0::DOUBLE / raw, 0) AS dup_pct FROM combos", "combos",
       FAMILY_ROWS)
oracle("ledger_recent", f"SELECT {LEDGER_SHOWN} FROM (SELECT * FROM combos WHERE status = 'done' ORDER BY run_at DESC, city, "
       "family_id, slice_id LIMIT 15) combos", "combos", FAMILY_ROWS)
OPEN = """opened AS (SELECT city, sum(n)::BIGINT AS open FROM (SELECT city, runs AS n FROM combos WHERE slice_id = ''
    AND status = 'done' UNION ALL SELECT city, 1 FROM cells_ WHERE n >= 45) GROUP BY city)"""
oracle("city_family_open", "SELECT * FROM opened", "combos", *COVERAGE, OPEN)
QUOTAS = f"""quota AS (SELECT city, w AS weight, CASE WHEN city = '全国' THEN 1 ELSE greatest(1.0::DOUBLE,
    25000 * w / (SELECT sum({weight('city')}) FROM cities WHERE city <> '全国')) END AS quota
    FROM (SELECT city, {weight('city')} AS w FROM cities))"""
oracle("quotas", "SELECT city, weight, round(quota, 6) AS quota FROM quota", "cities", QUOTAS)
SCORES = f"""facts AS (SELECT quota.city, quota.weight, quota.quota, fam.family_id, fam.weight AS fw,
        greatest(1.0, 200000 * fam.weight / (SELECT sum(weight) FROM fam)) AS fq, cc.n AS have,
        coalesce(fc.n, 0) AS fhave, coalesce(cells_.n, 0) AS covered, status, coalesce(runs, 0) AS runs,
        coalesce(slices_done, 0) AS slices_done, coalesce(open, 0) AS open
        FROM quota CROSS JOIN fam LEFT JOIN cc ON cc.city = quota.city LEFT JOIN fc ON fc.family_id = fam.family_id
        LEFT JOIN cells_ ON cells_.city = quota.city AND cells_.family_id = fam.family_id
        LEFT JOIN (SELECT * FROM combos WHERE slice_id = '') c ON c.city = quota.city AND c.family_id = fam.family_id
        LEFT JOIN sd ON sd.city = quota.city AND sd.family_id = fam.family_id LEFT JOIN opened ON opened.city = quota.city),
    judged AS (SELECT *, CASE WHEN status = 'saturated' THEN '历史零新增，已拉黑'
        WHEN status = 'done' AND runs >= 1 THEN '账本记录已抓过'
        WHEN covered >= 45 THEN concat('归档已有 ', covered, ' 条')
        WHEN city <> '全国' AND open >= 14 THEN '该城族数已铺满' END AS block_reason FROM facts),
    scores AS (SELECT *, round(CASE WHEN block_reason IS NOT NULL THEN 0 WHEN city = '全国'
        THEN greatest(0, (fq - fhave) / fq) * fw * 3.5 * (sqrt(weight) / 3.5)
        ELSE greatest(0, (quota - coalesce(have, 0)) / quota) * greatest(0, (fq - fhave) / fq) * fw * sqrt(weight)
        * CASE WHEN have IS NULL THEN 3.0 ELSE 1.0 END END::DOUBLE, 6) AS score,
        coalesce(status IN ('done', 'saturated'), false) AS skip_base FROM judged)"""
SCORED_GRID = ["cities", "combos", *COVERAGE, FAMILY_ROWS, SLICES_DONE, OPEN, QUOTAS.replace("25000", "200000"), SCORES]
oracle("coverage_scores", "SELECT city, family_id, round(score, 4) AS score, block_reason, skip_base, slices_done FROM scores", *SCORED_GRID)
oracle("coverage_top", "SELECT city, family_id, round(score, 4) AS score FROM scores s WHERE s.score > 0 ORDER BY s.score DESC, weight DESC, city, "
       "family_id LIMIT 60", *SCORED_GRID)
oracle("coverage_capped", """SELECT city, family_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY city
    ORDER BY score DESC, family_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= CASE WHEN city = '全国' THEN 20 ELSE 14 - open END""", *SCORED_GRID)
oracle("keyword_rotation", f"""SELECT city, family_id, words[(rank - 1) % len(words) + 1] AS keyword FROM (
    SELECT city, row_number() OVER (ORDER BY {weight('city')} DESC, city) AS rank FROM cities) CROSS JOIN fam""",
       "cities", FAMILY_ROWS)
SLICE_ROWS = "(VALUES " + ", ".join(f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(V.SLICES["experience"])) + \
             ") AS v(ord, slice_id, slice_label)"
oracle("next_slices", f"""SELECT * EXCLUDE (ord) FROM (SELECT c.city, c.family_id, v.slice_id, v.slice_label, v.ord,
    row_number() OVER (PARTITION BY c.city, c.family_id ORDER BY v.ord) AS rank FROM combos c CROSS JOIN {SLICE_ROWS}
    WHERE c.slice_id = '' AND c.truncated AND c.status IN ('done', 'saturated') AND NOT EXISTS (SELECT 1 FROM combos d
    WHERE d.city = c.city AND d.family_id = c.family_id AND d.slice_id = v.slice_id AND d.status IN ('done', 'saturated')))
    WHERE rank <= 3""", "combos")
oracle("city_search", "SELECT city, code FROM cities WHERE contains(city, '州')", "cities")
oracle("scope_cities", "SELECT city, code FROM cities WHERE city NOT IN ('三沙', '东沙群岛')", "cities")
oracle("scope_unknown", "SELECT * FROM (VALUES ('北京'), ('火星'), ('杭州'), ('月球')) AS v(city) WHERE city NOT IN "
       "(SELECT city FROM cities)", "cities")
oracle("scope_depth", "SELECT city FROM cities WHERE city IN (SELECT city FROM cc)", "cities", *COVERAGE)
GRID = "grid AS (SELECT keyword, city, ((city_no - k + (SELECT count(*) FROM cities)) % (SELECT count(*) FROM cities)) * 18 + k + 1 AS place FROM cities CROSS JOIN (VALUES " + \
       ", ".join(f"({i}, '{t}')" for i, t in enumerate(V.BASE_TERMS)) + ") AS v(k, keyword))"
oracle("combo_grid", "SELECT keyword, city, CAST(place AS BIGINT) AS place FROM grid", "cities", GRID)
COMBO_NAMES = f"{I.pick('o_orderkey % 18', V.BASE_TERMS)} AS keyword, {I.city_name('o_custkey')} AS city"
oracle("pending_combos", f"""SELECT keyword, city, CAST(place AS BIGINT) AS place FROM grid WHERE (keyword, city) NOT IN (
    SELECT (keyword, city) FROM (SELECT {COMBO_NAMES} FROM orders WHERE o_orderstatus = 'F')) ORDER BY place LIMIT 100""",
       "cities", GRID)
oracle("progress_stats", f"""SELECT keyword, city, count(*) AS rows FROM (SELECT {COMBO_NAMES} FROM orders
    WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
oracle("progress_counts", f"""SELECT count(*) FILTER (s = 'F') AS done, count(*) FILTER (s <> 'F') AS failed FROM (
    SELECT DISTINCT {COMBO_NAMES}, CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'x' END AS s FROM orders)""")
INPUTS = (f"inputs AS (SELECT CASE c_custkey % 5 WHEN 0 THEN {I.city_name('c_custkey')} WHEN 1 THEN "
          f"{I.text('100000000 + c_custkey')} WHEN 2 THEN {I.text('200000000 + c_custkey')} WHEN 3 THEN c_name "
          "ELSE '' END AS input FROM customer)")
oracle("city_resolve", """SELECT input, CASE WHEN n.city IS NOT NULL THEN input WHEN c.city IS NOT NULL THEN c.city
    WHEN bare THEN input END AS city, CASE WHEN n.city IS NOT NULL THEN n.code WHEN c.city IS NOT NULL OR bare THEN input END AS code,
    n.city IS NOT NULL OR c.city IS NOT NULL OR bare AS resolved FROM (SELECT *, regexp_full_match(input, '[0-9]{9}') OR input = ''
    AS bare FROM inputs) i LEFT JOIN cities n ON n.city = input LEFT JOIN cities c ON c.code = input""", "cities", INPUTS)

# --- report -------------------------------------------------------------------------------------------------------
TAG_ROWS = "tag_rows AS (SELECT unnest(string_split(tags, ' | ')) AS name FROM raw)"
EXPERIENCE_TAGS = "regexp_matches(name, '年|应届|在校|经验不限')"
EDUCATION_TAGS = f"name IN ({quoted(V.REPORT_EDUCATION_LABELS)})"
oracle("report_salary_labels", counts("raw", "CASE WHEN contains(salary, 'K') OR contains(salary, '元/天') THEN salary "
                                      "ELSE '未标注' END", 15), "raw")
oracle("report_experience", counts("tag_rows", where=EXPERIENCE_TAGS), "raw", TAG_ROWS)
oracle("report_education", counts("tag_rows", where=EDUCATION_TAGS), "raw", TAG_ROWS)
oracle("report_district", counts("raw", "CASE WHEN contains(location, '·') THEN split_part(location, '·', 2) ELSE location END",
                                 10, "location <> ''"), "raw")
oracle("report_company", counts("raw", "boss_name", 10, "boss_name <> ''"), "raw")
SKILL_TAGS = "skill_tags AS (SELECT unnest(string_split(tag_text, '|')) AS name FROM details)"
oracle("report_skill_tags", counts("skill_tags", limit=25), "details", SKILL_TAGS)
# Words with letters outside ASCII are blanked first, because a word boundary here is an ASCII one.
WIDE = r"\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{4e00}-\x{9fff}"
TERMS = rf"""term_rows AS (SELECT unnest(regexp_extract_all(regexp_replace(jd, '[A-Za-z0-9_]*[{WIDE}][A-Za-z0-9_{WIDE}]*', ' ', 'g'),
        '\b[A-Za-z][A-Za-z0-9._-]+\b')) AS name FROM details UNION ALL
        SELECT unnest(regexp_extract_all(jd, '[{CJK}]{{2,6}}')) FROM details),
    frequent AS (SELECT name, row_number() OVER (ORDER BY value DESC, name) - 1 AS ord FROM (
        {counts('term_rows', limit=60, where=f'length(name) <= 30 AND name NOT IN ({quoted(V.REPORT_STOP_WORDS)})')})
        WHERE value >= 2),
    terms AS (SELECT name, source, CAST(ord AS INTEGER) AS ord FROM (SELECT * FROM (VALUES
        {', '.join(f"({i}, '{t}', 0)" for i, t in enumerate(V.BASE_TERMS))}, (0, '数据分析', 1), (1, 'Python', 1)) AS v(ord, name, source)
        UNION ALL SELECT ord, name, 2 FROM frequent) QUALIFY row_number() OVER (PARTITION BY name ORDER BY source, ord) = 1),
    term_hits AS (SELECT name, count(*) AS value FROM terms JOIN details ON contains(lower(jd), lower(name)) GROUP BY name)"""
oracle("jd_terms", "SELECT * FROM terms", "details", TERMS)
oracle("jd_term_df", """SELECT name, value, round(value * 100.0::DOUBLE / (SELECT count(*) FROM details), 0) AS pct FROM term_hits
    ORDER BY value DESC, name LIMIT 25""", "details", TERMS)


def ranked(kind: str, rows: str) -> str:
    return (f"SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY value DESC, name) AS INTEGER) AS ord, name "
            f"FROM ({rows})")


oracle("report_dominant", " UNION ALL ".join([
    ranked("skill", counts("skill_tags", limit=10)),
    ranked("term", "SELECT * FROM term_hits ORDER BY value DESC, name LIMIT 8"),
    ranked("experience", counts("tag_rows", limit=1, where=EXPERIENCE_TAGS)),
    ranked("education", counts("tag_rows", limit=1, where=EDUCATION_TAGS)),
]), "raw", TAG_ROWS, "details", SKILL_TAGS, TERMS)

oracle("report_head", f"""SELECT (SELECT count(*) FROM cities) AS cities, {len(V.FAMILIES)}::BIGINT AS families,
    (SELECT sum(n)::BIGINT FROM cc) AS postings, (SELECT count(*) FROM cc) AS filled_cities,
    (SELECT count(*) FROM cities WHERE city NOT IN (SELECT city FROM cc)) AS blank_cities,
    (SELECT count(*) FROM combos WHERE status = 'done') AS done,
    (SELECT count(*) FROM combos WHERE status = 'saturated') AS saturated""", "cities", "combos", *COVERAGE)
oracle("report_blank_cities", "SELECT city FROM cities WHERE city NOT IN (SELECT city FROM cc)", "cities", *COVERAGE)

# --- streams ------------------------------------------------------------------------------------------------------
oracle("stream_ingest", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
oracle("stream_postings", """SELECT count(*) AS raw, count(DISTINCT nullif(job_id, '')) AS new,
    count(*) - count(DISTINCT nullif(job_id, '')) AS dup FROM raw""", "raw")
oracle("stream_first_seen_within", "SELECT DISTINCT user_id FROM events")
oracle("stream_dedup", "SELECT DISTINCT user_id FROM events")
oracle("stream_first_seen", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id "
       "ORDER BY ts, event_id) = 1")
oracle("stream_ledger", "SELECT 0::BIGINT AS batch_id, count(*) AS raw, count(DISTINCT user_id) AS new, "
       "count(*) - count(DISTINCT user_id) AS dup FROM events")
