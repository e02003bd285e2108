"""Queries over captures, provider payloads, embedded states and export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import __version__, vocab as V
from ..functions import company as C, export as E, jd as J, records as R, redact as X
from ..operators import pages as P, planning as PL, providers as PR, reports as RP, summaries as M
from ..sources import capture as CAP
from . import inputs as I, sql as S
from .registry import query
from .summary_queries import JOBS, _jobs

digest = lambda x: F.sha2(x, 256)

# --- captures --------------------------------------------------------------------------------------


@query("S1 S2 S4 S5", f"""with {I.EXCHANGES} select entry_index as doc_id, e::bigint as entry_index, case e when 0 then 'GET' else 'POST' end as method, case e when 0 then 200 when 1 then 500 else 200 end::integer as status,
 case e when 1 then 'HAR_RESPONSE_BODY_MISSING' when 2 then case when lang = 'de' then 'HAR_RESPONSE_JSON_INVALID' end end as decode_error, case e when 0 then entry_index % 50 else 3 end::bigint as page,
 case when e = 0 and lang = 'en' then n_chars when e = 2 and lang <> 'de' then n_chars end as total from exchanges, unnest([0, 1, 2]) as u(e)""")
def captured_entries(t):
    """Entries of network recordings, one recording per document: plain, failed and base64 bodies."""
    body = F.concat(F.lit('{"result":{"total":'), "n_chars", F.lit("}}"))
    sealed = F.base64(F.encode(F.when(F.col("lang") == "de", F.lit("not json")).otherwise(body), "UTF-8"))
    entry = lambda method, url, post, status, text, enc: F.struct(
        F.struct(method.alias("method"), url.alias("url"), F.struct(post.alias("text")).alias("postData")).alias("request"),
        F.struct(status.alias("status"), F.struct(text.alias("text"), enc.alias("encoding")).alias("content")).alias("response"))
    none, lit = F.lit(None).cast("string"), F.lit
    har = F.to_json(F.struct(F.struct(F.array(
        entry(lit("GET"), F.col("url"), none, lit(200), F.col("payload_json"), none),
        entry(lit("POST"), F.col("url"), lit('{"page":3}'), lit(500), none, none),
        entry(lit("POST"), F.col("url"), lit('{"page":3}'), lit(200), sealed, lit("base64"))).alias("entries")).alias("log")))
    df = I.exchanges(t).select(F.col("entry_index").alias("doc_id"), har.alias("har"))
    out = CAP.exchange_params(CAP.decode_body(CAP.har_entries(df, "har"), "content_text", "content_encoding"), "url", "body_text")
    return out.select("doc_id", "entry_index", "method", "status", "decode_error", "page", F.try_variant_get("payload", "$.result.total", "bigint").alias("total"))


@query("S2", """select event_id, case event_type when 'view' then json_extract_string(props, '$.k')::bigint when 'click' then json_extract_string(props, '$.k')::bigint end as k,
 case event_type when 'error' then 'HAR_RESPONSE_BODY_MISSING' when 'signup' then 'HAR_RESPONSE_BODY_ENCODING_ERROR' when 'purchase' then 'HAR_RESPONSE_JSON_INVALID' end as decode_error from events""")
def decoded_bodies(t):
    """Response bodies decoded, with the three ways they can fail."""
    text = F.expr("case event_type when 'view' then props when 'click' then base64(encode(props, 'UTF-8')) when 'error' then '' when 'signup' then '@@@' else concat(props, '}') end")
    enc = F.when(F.col("event_type").isin("click", "signup"), "base64")
    df = CAP.decode_body(t.events.withColumn("x", text).withColumn("e", enc), "x", "e")
    return df.select("event_id", F.try_variant_get("payload", "$.k", "bigint").alias("k"), "decode_error")


_LATIN = "regexp_replace(text, '[^\\x01-\\xff]', '?', 'g')"


@query("S3", f"select doc_id, sha256(case lang when 'es' then {_LATIN} else text end) as hash from documents")
def charset_texts(t):
    """Response bytes to text: UTF-8 with or without a mark, declared Latin-1, UTF-16."""
    latin = F.regexp_replace("text", r"[^\x01-\xff]", "?")
    bytes_ = (F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).when(F.col("lang") == "fr", F.encode(F.concat(F.lit("﻿"), "text"), "UTF-8"))
              .when(F.col("lang") == "es", F.encode(latin, "ISO-8859-1")).otherwise(F.encode("text", "UTF-16LE")))
    kind = F.expr("case lang when 'en' then 'application/json' when 'fr' then 'text/html; charset=utf-8' when 'es' then 'text/html; charset=ISO-8859-1' else 'text/plain;charset=utf-16-le' end")
    return t.documents.select("doc_id", digest(CAP.decode_charset(bytes_, kind)).alias("hash"))


_META = "case page_id % 3 when 0 then '<meta charset=\"utf-8\">' when 1 then '<meta http-equiv=\"Content-Type\" content=\"text/html; charset=ISO-8859-1\">' else '' end"


@query("S6", f"select page_id, sha256(case page_id % 3 when 1 then regexp_replace({_META} || html, '[^\\x01-\\xff]', '?', 'g') else {_META} || html end) as hash from pages")
def page_bodies(t):
    """Pages as bytes in the charset that their own markup names, or none."""
    html = F.concat(F.expr(_META), "html")
    raw = F.when(F.col("page_id") % 3 == 1, F.encode(F.regexp_replace(html, r"[^\x01-\xff]", "?"), "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    pages = CAP.read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", raw.alias("content"))
    return CAP.page_texts(pages, "content").select("page_id", digest("html").alias("hash"))


@query("X11", "select doc_id, sha256(text) as hash from documents")
def surrogate_free_texts(t):
    """Raw bytes with an encoded lone surrogate lose only the surrogate."""
    broken = F.concat(F.encode("text", "UTF-8"), F.when(F.col("lang") == "en", F.unhex(F.lit("EDA080"))).otherwise(F.unhex(F.lit(""))))
    return t.documents.select("doc_id", digest(CAP.safe_text(broken)).alias("hash"))


_STATE = "concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"doc\":', cast({id} as string), '}</script><script>window.__INITIAL_STATE__ = {\"jobs\":{\"id\":', cast({id} as string), ',\"note\":\"a } b\"}};window.__OTHER__={\"x\":1};window.__NUXT__ = function(){return 1};</script>')"


@query("S7", "select page_id, i as source_index, case i when 0 then '{\"doc\":' || page_id || '}' else '{\"jobs\":{\"id\":' || page_id || ',\"note\":\"a } b\"}}' end as state from pages, unnest([0, 1]) as u(i)")
def embedded_states(t):
    """Serialized states of pages in source order; what is not strict JSON is left out."""
    df = t.pages.select("page_id", F.concat(F.expr(_STATE.replace("{id}", "page_id")), "html").alias("html"))
    return CAP.embedded_states(df, "html").select("page_id", "source_index", F.to_json("state").alias("state"))


@query("T3", f"""with {I.POSTINGS} select doc_id, 1 as source_index, sha256(text) as jd_hash from postings where {S.credible_jd('text')} and lang <> 'de'""")
def embedded_details(t):
    """Job detail found inside a page's serialized state: credible text and a fitting title."""
    from ..operators.payloads import embedded_detail

    title = F.when(F.col("lang") == "de", F.lit("zzz")).otherwise(F.col("title"))
    job = F.struct(F.col("title").alias("jobTitle"), F.col("text").alias("description"))
    listed = F.to_json(F.struct(F.array(F.array(job)).alias("jobs")))
    state = F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.to_json(F.struct(F.struct(job.alias("detail")).alias("page"))))
    html = F.concat(F.lit('<script type="application/json">{"a":1}</script><script>window.__INITIAL_DATA__ = '), state, F.lit("</script>"))
    df = I.postings(t).select("doc_id", F.when(F.length(F.trim("title")) > 0, title).alias("expected"), html.alias("html"))
    out = embedded_detail(CAP.embedded_states(df, "html"), "doc_id", "expected")
    return out.select("doc_id", "source_index", digest("full_jd").alias("jd_hash"))


@query("F8", f"""with e as (select event_id, case event_type when 'view' then 401 when 'click' then 403 else 200 end as status, case event_type when 'error' then '{{"msg":"Login Required"}}' when 'signup' then 'please: FORBIDDEN' else props end as body from events)
select event_id, case when status in (401, 403) then 'HTTP_' || status {' '.join(f"when contains(lower(body), {S.q(w)}) then {S.q(w)}" for w in V.PROTECTED_WORDS)} end as signal from e""")
def protected_sources(t):
    """Responses that refuse unauthenticated access."""
    status = F.expr("case event_type when 'view' then 401 when 'click' then 403 else 200 end")
    body = F.expr("""case event_type when 'error' then '{"msg":"Login Required"}' when 'signup' then 'please: FORBIDDEN' else props end""")
    return t.events.select("event_id", X.protected_signal(status, body).alias("signal"))


# --- providers -------------------------------------------------------------------------------------


@query("P15 P19", f"""with {I.POSTINGS} select doc_id, doc_id::varchar as job_id, 'Job ' || doc_id as job_title, source as company, 'Paris|Bretagne' as locations, case when lang = 'en' then '校园招聘' else '社会招聘' end as recruitment_type, 2::bigint as duties, 2::bigint as needs,
 'https://x.mokahr.com/campus-recruitment/o/1#/job/' || doc_id as detail_url, 'E' as department, 7::integer as headcount from postings""")
def envelope_jobs(t):
    """Jobs of the envelope provider."""
    detail = F.to_json(F.struct(
        F.concat(F.lit("Job "), "doc_id").alias("title"), F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", 2).otherwise(1).alias("hireMode"), F.lit(7).alias("number"), F.struct(F.lit("E").alias("name")).alias("department"),
        F.array(F.struct(F.lit("Paris").alias("cityName"), F.lit("x").alias("provinceName")), F.struct(F.lit(None).cast("string").alias("cityName"), F.lit("Bretagne").alias("provinceName"))).alias("locations"),
        F.lit("<p>a</p><p>b</p><div>任职要求</div><p>c</p>").alias("jobDescription")))
    page = F.concat(F.lit('{"code":0,"success":true,"data":{"jobs":['), detail, F.lit('],"jobStats":{"total":1}}}'))
    df = I.postings(t).withColumn("page", R.parse(page)).withColumn("l", PR.list_payload("page", "moka")).filter("l.error is null and l.total = 1")
    df = df.select("doc_id", "source", F.explode("l.records").alias("raw")).withColumns({"detail": F.col("raw"), "url": F.lit("https://x.mokahr.com/campus-recruitment/o/1/")})
    out = PR.map_moka(df, "raw", "detail", "url", "source")
    return out.select("doc_id", "job_id", "job_title", "company", F.array_join("locations", "|").alias("locations"), "recruitment_type", F.size("responsibilities").cast("bigint").alias("duties"),
                      F.size("requirements").cast("bigint").alias("needs"), "detail_url", "department", "headcount")


@query("P16 P19 T25", """select o_orderkey, o_orderkey::varchar as job_id, 'T' || o_custkey as job_title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as publish_date, 'Lyon' as locations, case when o_orderstatus = 'F' then '实习' else '社招' end as recruitment_type,
 'https://t.jobs.feishu.cn/site/position/detail/' || o_orderkey as detail_url, 'do ' || o_custkey || chr(10) || chr(10) || 'know ' || o_orderpriority as full_jd from orders""")
def translated_jobs(t):
    """Jobs of the translated-label provider."""
    kind = F.when(F.col("o_orderstatus") == "F", F.lit('{"i18n_name":"实习"}')).otherwise(F.lit('{"i18n_name":"","parent":{"id":1,"zh_cn":"社招"}}'))
    raw = F.concat(F.lit('{"code":0,"data":{"count":1,"job_post_list":[{"id":"'), "o_orderkey", F.lit('","title":"T'), "o_custkey", F.lit('","description":"do '), "o_custkey", F.lit('","requirement":"know '), "o_orderpriority",
                   F.lit('","city_list":[{"i18n_name":"Lyon"},{"name":"Lyon"}],"recruit_type":'), kind, F.lit(',"publish_time":'), F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.lit("}]}}"))
    df = I.spread(t.orders, "o_orderkey").withColumn("l", PR.list_payload(R.parse(raw), "feishu")).select("o_orderkey", F.explode("l.records").alias("raw")).withColumns(
        {"url": F.lit("https://t.jobs.feishu.cn/index"), "path": F.lit("site"), "co": F.lit("Co")})
    out = PR.map_feishu(df, "raw", "url", "path", "co")
    return out.select("o_orderkey", "job_id", "job_title", "publish_date", F.array_join("locations", "|").alias("locations"), "recruitment_type", "detail_url", "full_jd")


@query("P17 P19", """select o_orderkey, o_orderkey::varchar as job_id, 'T ' || o_custkey as job_title, case o_orderstatus when 'F' then '社会招聘' when 'O' then '校园招聘' end as recruitment_type, '岗位职责' || chr(10) || 'a' || chr(10) || chr(10) || '任职要求' || chr(10) || o_orderpriority as full_jd,
 'https://c.zhiye.com/' || case o_orderstatus when 'F' then 'social/detail' when 'O' then 'campus/detail' else 'detail' end || '?jobAdId=' || o_orderkey as detail_url, case when o_orderstatus = 'P' then null else '2024-05-06' end as publish_date, 'Tenant' as company, 'X|Y' as locations from orders""")
def alias_jobs(t):
    """Jobs of the alias provider, the detail laid over the list."""
    cat = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("9")
    lst = F.concat(F.lit('{"Code":200,"Count":1,"Data":{"Rows":[{"Id":'), "o_orderkey", F.lit(',"JobAdName":" T '), "o_custkey", F.lit('","CategoryId":"'), cat, F.lit('","Duty":"","LocNames":["X","Y"],"PostDate":"'),
                   F.when(F.col("o_orderstatus") == "P", "0001-01-01").otherwise("2024-05-06"), F.lit('"}]}}'))
    det = R.parse(F.concat(F.lit('{"Duty":" a ","Require":"'), "o_orderpriority", F.lit('"}')))
    df = I.spread(t.orders, "o_orderkey").withColumn("l", PR.list_payload(R.parse(lst), "zhiye")).select("o_orderkey", "o_orderpriority", F.explode("l.records").alias("raw"))
    df = df.withColumns({"detail": det, "url": F.lit("https://c.zhiye.com/jobs"), "co": F.lit("Tenant")})
    out = PR.map_zhiye(df, "raw", "detail", "url", "co")
    return out.select("o_orderkey", "job_id", "job_title", "recruitment_type", "full_jd", "detail_url", "publish_date", "company", F.array_join("locations", "|").alias("locations"))


@query("P18", """select page_id, i::integer as pos, case when page_id % 4 = 0 then 42 end::bigint as total, case when page_id % 4 = 1 then 7 end::bigint as pages, page_id || '0' || i as position_id, case when page_id % 4 = 1 then 'Lead ' || page_id || i when i = 0 then 'A & B ' || page_id else 'Body' end as title, null::varchar as error
from pages, unnest([0, 1]) as u(i) where page_id % 4 in (0, 1) union all
select page_id, null, case when page_id % 8 = 2 then 5 end, case when page_id % 8 = 7 then 2 end, null, null, case when page_id % 8 = 2 then 'LIST_JOB_LINKS_MISSING' when page_id % 8 = 6 then 'LIST_TOTAL_MISSING' when page_id % 8 = 3 then 'KUNLUNXIN_PAGE_COUNT_MISSING' else 'KUNLUNXIN_JOB_LINKS_MISSING' end from pages where page_id % 4 in (2, 3)""")
def cms_lists(t):
    """Server-rendered lists of both templates: posting links, stated total or pages, and why a page is no list."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    k = F.col("page_id").cast("string")
    first = text("<p>共 42 条记录</p><a title=\"A &amp; B ", k, "\" href=\"/zpdetail/", k, "00\">x</a><a href=\"/other/1\">n</a><a href='/zpdetail/", k, "01?k=1'><b>Body</b></a>")
    second = text("<script>var jobList=1</script><a href='/Campuslist?PageIndex=3'>3</a><a href='/Campuslist?a=1&PageIndex=7'>7</a><a href=\"/xiangqing?jobId=", k, "00\" class=x> <h3>Lead ", k,
                  "0</h3></a><a href='/xiangqing?jobId=", k, "01'><h3>Lead ", k, "1</h3></a><a href='/xiangqing?jobId=9'>no heading</a>")
    html = (F.when(F.col("page_id") % 4 == 0, first).when(F.col("page_id") % 4 == 1, second).when(F.col("page_id") % 8 == 2, F.lit("共5条记录<a href=/zpdetail/x>x</a>"))
            .when(F.col("page_id") % 8 == 6, F.lit("<a href=/zpdetail/1>x</a>")).when(F.col("page_id") % 8 == 3, F.lit("jobList <a href='/Campuslist'>x</a>"))
            .otherwise(F.lit("jobList <a href='/Campuslist?PageIndex=2'>x</a>")))
    return PR.cms_list(t.pages.select("page_id", F.concat(html, "html").alias("html")), "html").select("page_id", "pos", "total", "pages", "position_id", "title", "error")


@query("P18", """select page_id, case when page_id % 2 = 0 then 'Role ' || page_id else 'Other ' || page_id end as job_title, case when page_id % 2 = 0 then 'Paris' else 'Lyon' end as location, case when page_id % 2 = 0 then 'do it' else 'act' end as responsibilities, case when page_id % 2 = 0 then 'know it' else 'learn' end as requirements,
 case when page_id % 2 = 0 then 3 end::integer as headcount, case when page_id % 2 = 0 then '2024-01-01' else '2024-02-02' end as publish_date, case when page_id % 2 = 0 then null else 'DETAIL_API_JD_INCOMPLETE' end as api_error, case when page_id % 2 = 0 then '/apply/' || page_id || '?a=1&b=2' end as apply_path from pages""")
def cms_details(t):
    """Server-rendered details in both templates, and the JSON variant's failures."""
    one = F.concat(F.lit('<h1 class="a" id="detial_title">Role '), "page_id", F.lit("</h1><label>工作地点：</label> <div>Paris</div><h3>工作职责：</h3><pre>do it</pre><h3>任职资格</h3><pre>know it</pre><div>招聘人数： 3</div><div>发布时间： 2024-01-01</div><a class=b nexturl='/apply/"), "page_id", F.lit("?a=1&amp;b=2'>go</a>"))
    two = F.concat(F.lit('<div class="title"><i></i><h3>Other '), "page_id", F.lit("</h3></div><div class='sx'>a | Lyon |</div><h4>工作职责：</h4><p>act</p><h4>任职要求:</h4><p>learn</p><div class=\"time\">发布时间： 2024-02-02</div>"))
    df = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, one).otherwise(two).alias("h"))
    out = PR.cms_detail(df, "h").withColumn("p", R.parse(F.when(F.col("page_id") % 2 == 0, F.lit('{"Code":200,"Data":{"JobAdName":"x","DutyStr":"d"}}')).otherwise(F.lit('{"Code":200,"Data":{"JobAdName":"x"}}'))))
    api = PR.cms_detail_json(out.select("page_id", "p"), "p").select("page_id", F.col("error").alias("api_error"))
    return out.select("page_id", "job_title", "location", "responsibilities", "requirements", "headcount", "publish_date", "apply_path").join(api, "page_id")


@query("P19 G22", f"""with {I.URLS}, s as (select page_id, v, case page_id % 5 when 0 then 'MOKA' when 1 then 'feishu' when 2 then 'elsewhere' end as provider, case when page_id % 2 = 0 then 'HIGH' else 'MEDIUM' end as confidence from urls),
 k as (select *, case v when 5 then 'moka' when 6 then 'feishu' when 10 then case when page_id % 3 = 0 then 'beisen_cms' else 'zhiye' end end as known from s)
select page_id, v, known, case when confidence = 'HIGH' and provider in ('MOKA', 'feishu') then lower(provider) else coalesce(known, 'generic') end as route from k""")
def routed_sources(t):
    """The adapter of every source: by recognised provider, by its page, by its host, or the fallback."""
    from ..operators.adapters import standard

    html = F.when(F.col("page_id") % 3 == 0, F.lit("<script src='//stc-cms.beisen.com/CmsPortal/a.js'>")).when(F.col("page_id") % 3 == 1, F.lit("<p>"))
    provider = F.expr("case page_id % 5 when 0 then 'MOKA' when 1 then 'feishu' when 2 then 'elsewhere' end")
    df = I.urls(t).withColumns({"html": html, "provider": provider, "confidence": F.expr("case when page_id % 2 = 0 then 'HIGH' else 'MEDIUM' end")})
    known = standard()
    return df.select("page_id", "v", known.known("url", "html").alias("known"), known.route("url", "html", "provider", "confidence").alias("route"))


@query("P20", """select page_id, 'iv' || page_id as aes_iv, 'T' || page_id as tenant_name, (1 + page_id % 3)::integer as process_type, case page_id % 3 when 0 then 'social' when 1 then 'campus' end as recruitment_type from pages""")
def page_state_scopes(t):
    """Tenant scope stated in a page's start-up data."""
    html = F.concat(F.lit('<input value="{&quot;aesIv&quot;:&quot;iv'), "page_id", F.lit('&quot;}"><script>{"tenant_info":{"tenant_name":"T'), "page_id", F.lit('"},"website_info":{"process_type":'), 1 + F.col("page_id") % 3, F.lit("}}</script>"), "html")
    return PR.page_state_scope(t.pages.select("page_id", html.alias("h")), "h").select("page_id", "aes_iv", "tenant_name", "process_type", "recruitment_type")


# --- export ----------------------------------------------------------------------------------------

_CELL = "case lang when 'en' then '=' || text when 'fr' then chr(7) || text || chr(13) || chr(10) || 'x' when 'de' then repeat(text || ' ', 40) else '@|#' || text end"
_SPARK_CELL = "case lang when 'en' then concat('=', text) when 'fr' then concat(chr(7), text, chr(13), chr(10), 'x') when 'de' then repeat(concat(text, ' '), 40) else concat('@|#', text) end"
_QUOTE = lambda x: f"case when regexp_matches({x}, '^[=+@-]') then '''' || {x} else {x} end"
_MARK = V.LONG_CELL_MARKER.replace("\n", "' || chr(10) || '")
_MD = "replace(regexp_replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\', '\\\\'), '([|#*_`])', '\\\\\\1', 'g'), chr(10), ' ')"


@query("X4 X5 X7 X6", f"""with x as (select doc_id, {_CELL} as s from documents), b as (select doc_id, s, regexp_replace(regexp_replace(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\r\\n?', chr(10), 'g') as body,
  replace(regexp_replace(s, '\\r\\n?', chr(10), 'g'), chr(10), ' ⏎ ') as one, {_MD} as md from x),
 k as (select *, case when length(body) > 32767 then body[1:32767 - {len(V.CELL_MARKER)}] || '{V.CELL_MARKER}' else body end as capped from b)
select doc_id, sha256({_QUOTE('capped')}) as cell, length({_QUOTE('capped')}) as cell_length, sha256({_QUOTE('one')}) as csv, sha256(md) as markdown, length(s) > 32767 as truncated from k""")
def export_cells(t):
    """Sheet, CSV and Markdown forms of whole texts."""
    df = I.spread(t.documents, "doc_id").select("doc_id", F.expr(_SPARK_CELL).alias("s")).withColumn("cell", E.sanitize_cell("s", V.CELL_LIMIT))
    return df.select("doc_id", digest("cell").alias("cell"), F.length("cell").cast("bigint").alias("cell_length"), digest(E.csv_cell("s")).alias("csv"),
                     digest(E.md_inline("s")).alias("markdown"), E.over_limit("s").alias("truncated"))


@query("X6 X9 X5", """select p_partkey, '1. ' || p_name || chr(10) || '2. ' || p_brand as numbered, case when p_size % 2 = 0 then p_brand || '；' || p_type else p_brand end as locations, case when p_size % 3 = 0 then 'Unknown' else 'brand=' || p_brand || '; type=' || p_type end as scope, p_name || ' ⏎ ' || p_type as csv from part""")
def formatted_fields(t):
    """Numbered lists, joined places, scope text and list cells."""
    scope = F.when(F.col("p_size") % 3 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand"))
    return t.part.select("p_partkey", E.numbered(F.array("p_name", "p_brand")).alias("numbered"),
                         E.locations_text(F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))).alias("locations"), E.scope_text(scope).alias("scope"), E.csv_list(F.array("p_name", "p_type")).alias("csv"))


@query("X12 X13 S14", """select event_id, 'E_' || upper(event_type) as code, 'job_id=' || event_id || ' page=' || user_id as context, case when event_type = 'error' then 'token=[REDACTED] bad' else 'plain ' || event_type end as reason from events""")
def error_lines(t):
    """Error lines built with masked context and read back."""
    code = F.concat(F.lit("E_"), F.upper("event_type"))
    msg = F.when(F.col("event_type") == "error", "token=abc bad").otherwise(F.concat(F.lit("plain "), "event_type"))
    ctx = F.create_map(F.lit("page"), F.col("user_id").cast("string"), F.lit("job_id"), F.col("event_id").cast("string"), F.lit("apiKey"), F.lit("s"))
    df = t.events.withColumn("p", X.parse_error(X.make_error(code, msg, ctx)))
    return df.select("event_id", "p.code", "p.context", "p.reason")


def _export_jobs(t):
    jobs = _jobs(t)
    blank = F.lit(None).cast("string")
    return jobs.select(
        "run_id", "doc_id", F.col("doc_id").cast("string").alias("job_id"), F.col("title").alias("job_title"), F.when(F.col("doc_id") % 2 == 0, "-Acme").alias("company"), F.array(F.lit("Paris"), F.lit("Lyon")).alias("locations"),
        F.col("run_id").alias("department"), blank.alias("education"), F.lit("社招").alias("recruitment_type"), blank.alias("job_category"), F.array(F.lit("CS")).alias("major"), F.lit(2).alias("headcount"), F.lit("2024-01-01").alias("publish_date"),
        "responsibilities", "requirements", "full_jd", F.concat(F.lit("https://h/"), "doc_id").alias("detail_url"), blank.alias("apply_url"), F.lit("https://h").alias("source_url"), F.lit("COMPLETE").alias("jd_enrichment_status"))


@query("S11 S12", f"""with {JOBS} select doc_id::varchar as id, {_QUOTE("replace(title, chr(10), ' ⏎ ')")} as title, case when doc_id % 2 = 0 then '''-Acme' else '' end as company, 'Paris ⏎ Lyon' as location, run_id as department, '' as education, '社招' as job_type, '2024-01-01' as publish_date,
 case when resp then {_QUOTE('title')} else '' end as responsibilities, case when req then {_QUOTE("(title || ' ⏎ ' || lang)")} else '' end as requirements, 'https://h/' || doc_id as detail_url, '' as apply_url, 'COMPLETE' as jd_enrichment_status from jobs""")
def csv_rows(t):
    """The thirteen export columns of every job."""
    return RP.csv_rows(_export_jobs(t))


_RUNS = """runs as (select o_custkey % 50 as run_id, count(*) as total_fetched, count(distinct o_custkey) as total_unique, count(*) filter (o_orderstatus = 'P') as failed, max(o_totalprice) as elapsed from orders group by 1)"""


def _runs(t):
    return t.orders.groupBy((F.col("o_custkey") % 50).alias("run_id")).agg(F.count("*").alias("total_fetched"), F.count_distinct("o_custkey").alias("total_unique"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.max("o_totalprice").alias("elapsed"))


@query("S13 G29", f"""with {_RUNS}, c as (select o_custkey % 50 as run_id, count(*) filter (o_orderstatus = 'F') as complete, count(*) filter (o_orderstatus = 'O') as pending, count(*) filter (o_orderstatus = 'P') as unknown from orders group by 1)
select run_id, round(elapsed, 3) as elapsed_seconds, round(elapsed, 3) as total_elapsed_seconds, total_fetched, total_unique, complete, pending, unknown, 'LIST_ONLY' as detail_method, 1::bigint as audit_keys from runs join c using (run_id)""")
def collection_summaries(t):
    """Summary row of every run."""
    runs = _runs(t).withColumns({"elapsed_seconds": F.col("elapsed"), "total_elapsed_seconds": F.lit(0.0), "detail_resolution": F.create_map(F.lit("detail_method"), F.lit("LIST_ONLY"), F.lit("cookies"), F.lit("x"))})
    state = F.expr("case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'PENDING' end")
    counts = M.enrichment_counts(t.orders.select((F.col("o_custkey") % 50).alias("run_id"), state.alias("s")), "run_id", "s")
    out = RP.collection_summary(runs, counts, "run_id")
    return out.select("run_id", "elapsed_seconds", "total_elapsed_seconds", "total_fetched", "total_unique", "complete", "pending", "unknown", F.try_element_at("detail_resolution", F.lit("detail_method")).alias("detail_method"),
                      F.size("detail_resolution").cast("bigint").alias("audit_keys"))


@query("S14", f"""with {_RUNS} select e.event_id % 50 as run_id, 'Co' as company, 'HAR' as stage, 'E' || event_id as error_type, 'boom ' || event_type as reason, failed as retry_count, 'job_id=' || event_id as context from events e join runs on runs.run_id = e.event_id % 50 where event_type = 'error'""")
def error_reports(t):
    """Structured rows of every error line."""
    errors = t.events.filter("event_type = 'error'").select((F.col("event_id") % 50).alias("run_id"), F.concat(F.lit("E"), "event_id", F.lit(" job_id="), "event_id", F.lit(" reason=boom "), "event_type").alias("line"))
    runs = _runs(t).withColumns({"company": F.lit("Co"), "source_url": F.lit("u"), "collection_mode": F.lit("HAR"), "status": F.lit("INCOMPLETE"), "retry_count": F.col("failed")})
    return RP.error_report(errors, runs, "run_id", "line").select("run_id", "company", "stage", "error_type", "reason", "retry_count", "context")


@query("X10", f"""with {_RUNS}, s as (select *, case when run_id % 3 = 0 then 'COMPLETE' when run_id % 3 = 1 then 'INCOMPLETE' else 'FAILED' end as status, case when run_id % 2 = 0 then total_fetched end as expected from runs)
select run_id, case status when 'COMPLETE' then 'Collection complete.' when 'FAILED' then 'Collection failed.' else 'Collection incomplete.' end || chr(10) || chr(10) || 'List: ' || coalesce(expected::varchar, '?') || ' expected, ' || total_fetched || ' fetched, ' || total_unique || ' unique'
 || chr(10) || 'Detail: ' || total_unique || ' resolved (0 browser-resolved), 0 blocked, ' || failed || ' failed' || case when status = 'COMPLETE' then '' else chr(10) || chr(10) || 'Reason: ' || case when status = 'FAILED' then case when expected is null then 'the job list itself could not be acquired, so nothing can be trusted.' else 'fatal error: E1.' end
 else case when failed > 0 then failed || ' job detail request' || case when failed <> 1 then 's' else '' end || ' failed' else 'the fetched list did not match the source''s expected total.' end end end as summary from s""")
def human_summaries(t):
    """Plain-words summary of every run."""
    s = _runs(t).withColumns({"status": F.expr("case when run_id % 3 = 0 then 'COMPLETE' when run_id % 3 = 1 then 'INCOMPLETE' else 'FAILED' end"), "expected": F.expr("case when run_id % 2 = 0 then total_fetched end")})
    zero = F.lit(0)
    reason = RP.human_reason("status", "expected", F.lit("E1"), F.lit(False), zero, "failed", zero)
    return s.select("run_id", RP.human_summary("status", "expected", "total_fetched", "total_unique", "total_fetched", "total_unique", zero, zero, "failed", zero, reason).alias("summary"))


@query("S15", f"""with {JOBS}, n as (select *, row_number() over (partition by run_id order by doc_id) as no, count(*) over (partition by run_id) <= 50 as whole from jobs),
 m as (select run_id, no as job_no, u.i, u.line from n, unnest(['### ' || no || '. ' || {_MD.replace('(s,', '(title,')}, '', '- Location: Paris；Lyon', '- Category: Unknown', '- Department: ' || run_id, '- Recruitment Type: 社招', '- Detail: https://h/' || doc_id] || case when whole then ['', '#### Full JD', '', '```text', replace(coalesce(nullif(full_jd, ''), 'No full JD available.'), '```', '` ` `'), '```'] else [] end || ['']) with ordinality as u(line, i))
select run_id, job_no, (i - 1)::integer as line_no, sha256(line) as line from m union all
select run_id, 0, (i - 1)::integer, sha256(line) from (select distinct run_id from jobs), unnest(['# Job Collection Report', '', 'Generated by vacantia {__version__}', '', '## Overview', '', '- Company: Co', '- Platform: har', '- Source: u', '', '## Collection Result', '',
 '- Expected: 1', '- Fetched: 1', '- Unique: 1', '- Status: COMPLETE', '', '## Jobs', '']) with ordinality as u(line, i)""")
def report_lines(t):
    """Markdown report of every run, as ordered lines."""
    jobs = _export_jobs(t)
    runs = jobs.select("run_id").distinct().withColumns({"company": F.lit("Co"), "platform": F.lit("har"), "source_url": F.lit("u"), "total_expected": F.lit(1), "total_fetched": F.lit(1), "total_unique": F.lit(1), "status": F.lit("COMPLETE")})
    return RP.report_lines(runs, jobs, "run_id", "doc_id", compact=None).select("run_id", "job_no", "line_no", digest("line").alias("line"))


_BODY = lambda x: f"regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\r\\n?', chr(10), 'g')"
_SHEET = lambda x: _QUOTE(_BODY(x))


@query("S16", f"""with {JOBS}, n as (select *, row_number() over (partition by run_id order by doc_id) as no, case when resp then '1. ' || title else '' end as r1, case when req then '1. ' || title || chr(10) || '2. ' || lang else '' end as r2 from jobs)
select run_id, no as "序号", case when doc_id % 2 = 0 then '''-Acme' else '' end as "公司", {_SHEET('title')} as "岗位名称", doc_id::varchar as "Job ID", '社招' as "招聘类型", '' as "岗位类别", {_SHEET('run_id')} as "部门", 'Paris；Lyon' as "工作地点", '' as "学历", 'CS' as "专业",
 2::integer as "招聘人数", '2024-01-01' as "发布时间", {_SHEET('r1')} as "岗位职责", {_SHEET('r2')} as "任职要求", {_SHEET("coalesce(full_jd, '')")} as "完整 JD", '查看岗位' as "Detail URL", '' as "Apply URL", '来源网页' as "Source URL",
 case when coalesce(full_jd, '') = '' then 'MISSING_JD' when resp and req then 'COMPLETE' else 'STRUCTURE_PARTIAL' end as "数据完整性", 'COMPLETE' as "JD 获取状态",
 greatest(length(r1), length(r2), length(coalesce(full_jd, '')), length(title)) > 32767 as over_limit from n""")
def workbook_jobs(t):
    """Jobs sheet of every run, all columns, whole texts."""
    return RP.workbook_jobs(_export_jobs(t), "run_id", "doc_id")


@query("S16", f"""with {_RUNS} select run_id, metric, value from (select run_id, 'Fetched' as metric, total_fetched::varchar as value from runs union all select run_id, 'Unique', total_unique::varchar from runs union all select run_id, 'Company', '''=Co' from runs union all select run_id, 'Errors count', failed::varchar from runs)""")
def workbook_summaries(t):
    """Summary sheet of every run."""
    runs = _runs(t).withColumns({"company": F.lit("=Co"), "errors": F.col("failed")})
    return RP.workbook_summary(runs, "run_id").select("run_id", "metric", "value")


@query("S17 T26 W13", """with e as (select event_id, ts, event_type, user_id % 4 as v, case user_id % 4 when 0 then '比亚迪' when 1 then 'a_b' when 2 then '_unknown' else 'Plain' end as company_dir, event_type = 'error' as failed from events),
 s as (select *, strftime(date_trunc('day', ts), '%Y-%m-%d_%H%M%S') as st from e), o as (select *, row_number() over (partition by failed, company_dir, st order by event_id) as r from s)
select event_id, case when failed then '_failed' else 'ok' end as outcome, company_dir, st || case when r > 1 then '_' || r else '' end as stamp from o""")
def run_folders(t):
    """Folder of every run, with ordinals for runs of the same second."""
    name = F.expr("case user_id % 4 when 0 then 'BYD Auto' when 1 then 'a/b' when 2 then 'x.com' else ' Plain ' end")
    df = t.events.select("event_id", F.date_trunc("day", "ts").alias("at"), name.alias("company"), F.lit("https://h.example/x").alias("url"), (F.col("event_type") == "error").alias("failed"))
    return RP.run_partition(df, "company", "url", "failed", "at", "event_id").select("event_id", "outcome", "company_dir", "stamp")


@query("T26", """select event_id, strftime(ts, '%Y-%m-%d_%H%M%S') as stamp, 'h_' || user_id || '_example_com_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' as file from events""")
def run_stamps(t):
    """Stamps and file names of runs."""
    return t.events.select("event_id", C.run_stamp("ts").alias("stamp"), C.output_name(F.concat(F.lit("https://h-"), "user_id", F.lit(".example.com/a")), "ts").alias("file"))


@query("S10", """with e as (select 'https://h' || user_id || '.example/a?' as base, ts, event_type, user_id from events), f as (select user_id, ts from e where event_type <> 'error' and epoch(timestamp '2024-01-20 00:00:00') - epoch(date_trunc('second', ts)) between 0 and 86400)
select 'https://h' || user_id || '.example/a?b=1&c=2' as source_key, max(ts) as finished, count(*) as candidates from f group by user_id""")
def reusable_artifacts(t):
    """Freshest reusable discovery per source within a day."""
    url = F.concat(F.lit("HTTPS://H"), "user_id", F.when(F.col("event_id") % 2 == 0, F.lit(".example/a/?c=2&b=1#x")).otherwise(F.lit(".example/a?b=1&c=2")))
    df = t.events.select(url.alias("url"), F.col("ts").alias("finished"), F.when(F.col("event_type") == "error", "old").otherwise("1").alias("version"))
    return PL.latest_reusable(df, "url", "finished", "version", "2024-01-20 00:00:00", "1")
