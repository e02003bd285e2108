"""Inputs the registered queries run on: captured material derived row by row from the given tables.

Each derivation is written once, in SQL both Spark and the oracle read, so both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

HOST = "split_part(url, '/', 3)"
PAGE = "cast(page_id as varchar)"

# one page address and addresses of the same site in the shapes captures contain
URL_FORMS = [
    "url",
    f"concat('HTTPS://', upper({HOST}), '/jobs/', {PAGE}, 'a-1/?utm_source=x&resource_id=7&b=2&a=1')",
    f"concat('https://', {HOST}, '/en/position/detail?jobId=', {PAGE}, '&page=2&pageSize=20')",
    f"concat('https://', {HOST}, '/app#/job/', {PAGE}, '00001')",
    f"concat('https://', {HOST}, '/news/article/', {PAGE}, '?traceId=9&token=abc')",
    f"concat('https://xg', {PAGE}, '.mokahr.com/campus-recruitment/org', {PAGE}, '/', {PAGE}, '?offset=20&limit=10')",
    f"concat('https://', split_part({HOST}, '.', 1), '.jobs.feishu.cn/index/?category=', {PAGE})",
    f"concat('https://careers.brand', {PAGE}, 'globalhr.com/search-results/?keyword=java&current=3')",
    f"concat('https://www.byd', {PAGE}, '.com.cn/locations/new-york-city.html')",
    f"concat('http://', {HOST}, ':8080/pixel/i18n/', {PAGE}, '.mp4?location=Paris&requestId=5')",
    f"concat('https://api.', split_part({HOST}, '.', 2), '.zhiye.com/social/jobs/list?page=1&page=7&size=x&per_page=50')",
    f"concat('[open](https://', {HOST}, '/go/berlin/', {PAGE}, '/)')",
]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a small input among all cores before row-wise work.

    Only an input with fewer partitions than cores moves; a large table is read as its splits lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _spark_sql(expr: str) -> str:
    return expr.replace("as varchar", "as string")


def urls(t) -> DataFrame:
    """page_id, v, url: every address form of every page."""
    forms = ", ".join(_spark_sql(e) for e in URL_FORMS)
    return t.pages.selectExpr("page_id", f"posexplode(array({forms})) as (v, url)")


URLS = ("urls as (select page_id, cast(v as integer) as v, list_extract(forms, v + 1) as url from ("
        f"select page_id, [{', '.join(URL_FORMS)}] as forms from pages), unnest(range({len(URL_FORMS)})) as r(v))")

# postings: a title, a body with headings that differ by language
TITLE = "split_part(text, chr(10), 1)"
BODY = ("case lang when 'en' then concat('Intro', chr(10), 'Responsibilities:', chr(10), text, chr(10), "
        "'Requirements', chr(10), 'R ', cast(doc_id as varchar), chr(10), 'Q') "
        f"when 'fr' then concat('岗位职责：', chr(10), text, chr(10), '任职要求', chr(10), {TITLE}) "
        "when 'de' then concat('1、alpha ', cast(doc_id as varchar), '；2、beta。3、gamma') else text end")


def postings(t) -> DataFrame:
    return spread(t.documents, "doc_id").selectExpr("doc_id", "lang", "source", "n_chars", "text", f"{_spark_sql(TITLE)} as title",
                                  f"{_spark_sql(BODY)} as body")


POSTINGS = (f"postings as (select doc_id, lang, source, n_chars, text, {TITLE} as title, {BODY} as body "
            "from documents)")

# list records: one JSON object per document, spelled differently by language
RECORD_SQL = """
case lang
when 'en' then to_json(named_struct('jobId', doc_id, 'jobName', title, 'description', body,
  'workPlaceList', array(named_struct('name', lang), named_struct('name', ' '), named_struct('name', source),
                         named_struct('name', lang)),
  'companyName', source, 'recruitNumStr', concat(cast(n_chars % 97 as string), '人'), 'subject', title,
  'publishDate', '2024-01-02', 'token', 'abc', 'detailUrl', concat('/jobs/', doc_id)))
when 'fr' then to_json(named_struct('postId', concat('P', doc_id), 'postName', title, 'duty', text, 'require', title,
  'workPlace', source, 'department', named_struct('name', lang, 'id', 7), 'headCount', n_chars, 'company_name', source,
  'updateTime', '2024-03-04', 'major', array(lang, source, lang), 'location', named_struct('city', source)))
when 'de' then to_json(named_struct('id', doc_id, 'title', title,
  'projectPositionDto', named_struct('jobResponsibility', text, 'requirements', title),
  'company_info', named_struct('show_name', source, 'name', 'n'),
  'district_list', array(named_struct('area_cn', source, 'address', lang), named_struct('area_cn', ' ', 'address', lang),
                         named_struct('area_cn', source, 'address', '')),
  'amount', n_chars % 5, 'publishDate', '0001-01-01'))
else to_json(named_struct('demandCode', concat('D', doc_id), 'name', title, 'summary', title, 'nature_cn', source,
  'city', named_struct('label', lang), 'wrap', named_struct('inner', named_struct('positionName', title)),
  'recruitNum', '若干', 'orgName', source)) end"""


def records(t) -> DataFrame:
    """doc_id, lang, source, n_chars, title, body, text, record_json, v (variant), rec (record)."""
    from ..functions import records as R

    df = postings(t).withColumn("record_json", F.expr(RECORD_SQL))
    return df.withColumn("v", R.parse("record_json")).withColumn("rec", R.as_record("v"))


# captured exchanges: one per document; its records are the lines of the text, a line of blanks (Unicode's Zs) is none
_BLANKS = " \\u00a0\\u1680" + "".join(f"\\u{n:04x}" for n in range(0x2000, 0x200b)) + "\\u202f\\u205f\\u3000"
ITEM = f"transform(filter(split(text, chr(10)), x -> trim(both '{_BLANKS}' from x) <> ''), (x, i) -> "
RECORD_ITEMS = {
    "en": "named_struct('code', concat(doc_id, '-', i), 'jobName', x, 'city', source, 'updateTime', 't')",
    "fr": "named_struct('label', x, 'url', i)",
    "de": "named_struct('id', i, 'name', x, 'value', i)",
    "es": "named_struct('positionId', i, 'positionName', x, 'description', x, 'city', source)",
}
PAYLOAD_SQL = f"""
case lang
when 'en' then to_json(named_struct('success', true, 'result', named_struct('total', n_chars, 'list', {ITEM} {RECORD_ITEMS['en']}))))
when 'fr' then to_json(named_struct('navigation', true, 'menu', {ITEM} {RECORD_ITEMS['fr']})))
when 'de' then to_json(named_struct('data', named_struct('count', 1, 'rows', {ITEM} {RECORD_ITEMS['de']}))))
else to_json({ITEM} {RECORD_ITEMS['es']}))
end"""
# the record each kind of list declares, which its SQL goes by where the list is empty
_BLANK_ITEM = "to_json(transform(array(''), (x, i) -> {})[0])"
DECLARED_SQL = (f"case lang when 'en' then {_BLANK_ITEM.format(RECORD_ITEMS['en'])} when 'fr' then {_BLANK_ITEM.format(RECORD_ITEMS['fr'])} "
                f"when 'de' then {_BLANK_ITEM.format(RECORD_ITEMS['de'])} else {_BLANK_ITEM.format(RECORD_ITEMS['es'])} end")
EXCHANGE_URL = ("concat('https://', source, '.example.net/', case lang when 'en' then 'api/job/list' "
                "when 'fr' then 'api/navigation' when 'de' then 'api/settings' else 'api/search' end, '?page=', "
                "cast(doc_id % 50 as varchar), '&size=', cast(n_chars % 3 as varchar))")


def exchanges(t) -> DataFrame:
    """entry_index, run_id, lang, url, payload_json, payload (variant), declared (variant)."""
    from ..functions import records as R

    return (spread(t.documents, "doc_id").withColumn("payload_json", F.expr(PAYLOAD_SQL))
            .withColumn("url", F.expr(_spark_sql(EXCHANGE_URL)))
            .withColumn("payload", R.parse("payload_json"))
            .withColumn("declared", R.parse(F.expr(DECLARED_SQL)))
            .withColumnRenamed("doc_id", "entry_index").withColumnRenamed("source", "run_id"))


LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
EXCHANGES = (f"exchanges as (select doc_id as entry_index, source as run_id, lang, text, n_chars, {EXCHANGE_URL} as url, "
             f"len({LINES}) as n from documents)")

# attempts: repeated fetches of numbered pages
ATTEMPT_SQL = ("event_id, user_id as run_id, {k} as page, case event_type when 'error' then 500 when 'signup' then 403 "
               "when 'click' then 302 else 200 end as status, event_type <> 'view' as success, "
               "cast(floor(value) as bigint) % 40 as list_count, ts, event_type, value")


def attempts(t) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as bigint)"
    return t.events.selectExpr(*[p for p in _split(ATTEMPT_SQL.format(k=k))])


def _split(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return out + [cur.strip()]


ATTEMPTS = "attempts as (select " + ATTEMPT_SQL.format(k="cast(json_extract_string(props, '$.k') as bigint)") + " from events)"

# pages whose article also carries job links, controls and totals
PAGE_HTML = (f"concat('<html><head><title>Jobs at Brand ', {PAGE}, '</title></head><body><nav><a href=\"/privacy\">Privacy</a></nav>', "
             f"'<ul><li><a class=\"j\" href=\"/jobs/', {PAGE}, '001\">Engineer &amp; Lead ', {PAGE}, '</a></li>', "
             f"'<li><a class=\"j\" href=\"https://', {HOST}, '/position/', {PAGE}, '002?utm_source=a\">Analyst ', {PAGE}, '</a></li>', "
             "'<li><a class=\"p\" href=\"/search?q=1\">next page</a></li>', "
             f"'<li><a class=\"e\" href=\"https://campus.', {HOST}, '/all\">校园招聘 全部职位 all jobs</a></li>', "
             f"'<li><a class=\"e\" href=\"https://campus.', {HOST}, '/jobs/9', {PAGE}, '77\">View jobs</a></li>', "
             "'<li><a class=\"x\" href=\"#top\">top</a></li></ul>', "
             f"'<iframe src=\"https://frames.', {HOST}, '/w\"></iframe><script src=\"/static/job-widget.js\"></script>', "
             f"'<p>Showing 1 to 10 of 1,', substr(cast(1000 + page_id % 1000 as varchar), 2, 3), ' and ', {PAGE}, ' open positions</p>', html)")


def pages(t) -> DataFrame:
    return spread(t.pages, "page_id").selectExpr("page_id", "url", f"{_spark_sql(PAGE_HTML)} as html")


PAGES = f"captured as (select page_id, url, {PAGE_HTML} as html from pages)"


# captured sites: each page also links to the next pages of its host
_NEXT = [("lead(url) over (partition by split_part(url, '/', 3) order by page_id)", "campus positions"),
         ("lead(url, 3) over (partition by split_part(url, '/', 3) order by page_id)", "open jobs"),
         ("first_value(url) over (partition by split_part(url, '/', 3) order by page_id)", "all campus jobs")]
_NEXT_LINKS = ", ".join(f"coalesce(concat('<a href=\"', {address}, '\">{label}</a>'), '')" for address, label in _NEXT)
SITES = f"captured as (select page_id, url, concat({PAGE_HTML}, {_NEXT_LINKS}) as html from pages)"


def sites(t) -> DataFrame:
    return spread(t.pages, "page_id").selectExpr("page_id", "url", f"concat({_spark_sql(PAGE_HTML)}, {_NEXT_LINKS}) as html")
