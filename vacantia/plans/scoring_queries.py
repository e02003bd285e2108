"""Queries that find and judge job sources among captured exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import records as R, score as K, urls as U
from ..operators import discovery as D, planning as P
from ..operators.grouping import top_k
from . import inputs as I, sql as S
from .registry import query

join = lambda x, sep="|": F.array_join(x, sep)

_SCORED = f"""scored as (select *, case lang when 'en' then 21 when 'fr' then 4 when 'de' then 8 + (case when n <= 1 then 2 else 0 end) else 20 end
  + (case when n >= 5 then 3 else 0 end) as raw, case lang when 'en' then 'result.list' when 'fr' then 'menu' when 'de' then 'data.rows' else '$' end as list_path,
 case lang when 'fr' then 'NAVIGATION_PAYLOAD|LOW_JOB_ENTITY_DENSITY' when 'de' then 'CONFIG_PAYLOAD|REFERENCE_DATA_PAYLOAD|LOW_JOB_ENTITY_DENSITY' else '' end as reasons,
 case when lang in ('en', 'es') then 1.0 else 0.0 end::double as density from exchanges),
 judged as (select *, (case when reasons <> '' then least(raw, 9) else raw end)::integer as score from scored)"""


@query("G14 G15 G18 F11 F13", f"""with {I.EXCHANGES}, {_SCORED} select entry_index, list_path, n::integer as list_length, 1.0::double as homogeneity, density, reasons, score,
 case when score >= 15 then 'HIGH' when score >= 10 then 'MEDIUM' else 'LOW' end as confidence, (lang in ('en', 'es') and score >= 15) as reliable,
 case lang when 'en' then 'code' when 'de' then 'id' when 'es' then 'positionId' end as id_field,
 case lang when 'en' then 'jobName' when 'de' then 'name' when 'es' then 'positionName' end as title_field,
 case lang when 'en' then 'result.total' when 'de' then case when n <= 1 then 'data.count' end end as total_path from judged""")
def list_scores(t):
    """Score every captured response as a job-list source."""
    df = D.score_exchanges(I.exchanges(t), "url", "payload", declared="declared")
    return df.select("entry_index", "list_path", "list_length", "homogeneity", "density", join("reasons").alias("reasons"), "score", "confidence",
                     K.reliable("confidence", "reasons", "density", "fields").alias("reliable"),
                     F.when(F.col("lang") != "en", F.col("id_field")).otherwise(F.col("id_field")).alias("id_field"), "title_field", "total_path")


@query("G15", f"""with {I.EXCHANGES}, {_SCORED} select entry_index, (case lang when 'en' then 9 when 'fr' then 2 + 2 when 'de' then 3 + 3 + case when n <= 1 then 1 else 0 end else 8 end
 + case when n >= 5 then 1 else 0 end)::integer as facts, lang = 'en' as has_total_text from judged""")
def list_evidence(t):
    """The evidence behind each score, in fixed order."""
    df = D.score_exchanges(I.exchanges(t), "url", "payload", declared="declared")
    return df.select("entry_index", F.size("evidence").alias("facts"), F.array_contains("evidence", "response has total field: result.total").alias("has_total_text"))


@query("G16", f"""with {I.POSTINGS} select doc_id, (case lang when 'en' then 4 + 7 + 3 + 2 when 'fr' then 4 + 3 + 2 when 'de' then -8 + 3 + 2 + 7 else 3 end)::integer as detail_score from postings""")
def detail_scores(t):
    """Score captured responses as detail sources."""
    url = F.expr("case lang when 'en' then 'https://h/api/job/1' when 'fr' then 'https://h/detail' when 'de' then 'https://h/config/x' else 'https://h/x' end")
    return D.score_details(I.records(t).withColumn("url", url), "url", "v").select("doc_id", "detail_score")


@query("F12", f"""with {I.EXCHANGES} select entry_index, (lang in ('de', 'es') and n >= 2) as job_array from exchanges""")
def job_arrays(t):
    """Arrays whose first objects carry an id and a title."""
    items = F.coalesce(R.as_array("payload"), F.try_variant_get("payload", "$.data.rows", "array<variant>"), F.try_variant_get("payload", "$.menu", "array<variant>"),
                       F.try_variant_get("payload", "$.result.list", "array<variant>"))
    return I.exchanges(t).select("entry_index", K.is_job_array(items).alias("job_array"))


@query("G17 G38", f"""with {I.EXCHANGES} select entry_index, case lang when 'en' then 'result,success' when 'fr' then 'menu,navigation' when 'de' then 'data' end as top_level_keys,
 case lang when 'en' then 'result.list' when 'fr' then 'menu' when 'de' then 'data.rows' else '$' end as array_path, n::integer as array_length,
 case lang when 'en' then 'city,code,jobName,updateTime' when 'fr' then 'label,url' when 'de' then 'id,name,value' else 'city,description,positionId,positionName' end as sample_fields,
 case lang when 'en' then 'result.total' when 'de' then case when n <= 1 then 'data.count' end end as total_field, least(n, 20)::integer as sampled from exchanges""")
def response_shapes(t):
    """Shape of each response: keys, longest array, sampled fields, credible total."""
    df = D.response_shape(I.exchanges(t), "payload", declared="declared")
    return df.select("entry_index", join("top_level_keys", ",").alias("top_level_keys"), "array_path", "array_length", join("sample_fields", ",").alias("sample_fields"),
                     "total_field", F.least("array_length", F.lit(20)).alias("sampled"))


@query("K2", f"""with {I.EXCHANGES} select entry_index, case lang when 'en' then 'result' when 'fr' then 'menu' when 'de' then 'data' end as top_level_key, n::integer as array_length,
 case lang when 'en' then 'city,code' when 'fr' then 'label,url' when 'de' then 'id,name' else 'city,description' end as sample_fields from exchanges""")
def sampled_shapes(t):
    """Shape of each response from a bounded sample: the first twenty items, two names of them, one key."""
    df = D.response_shape(I.exchanges(t), "payload", items=20, most=2, declared="declared")
    return df.select("entry_index", F.get("top_level_keys", F.lit(0)).alias("top_level_key"), "array_length", join("sample_fields", ",").alias("sample_fields"))


@query("W9 K4", f"""with {I.EXCHANGES}, {_SCORED}, g as (select run_id, lang, min(entry_index) filter (score = m) as entry_index, any_value(m) as score, any_value(cnt) as sample_count, any_value(reasons) as reasons
 from (select *, max(score) over (partition by run_id, lang) as m, count(*) over (partition by run_id, lang) as cnt from judged) group by run_id, lang)
select run_id, case lang when 'en' then 'api/job/list' else 'api/search' end as endpoint, score, entry_index, sample_count from g where reasons = '' and score > 0""")
def ranked_candidates(t):
    """Best exchange per endpoint of each run, with the number of exchanges behind it."""
    df = D.score_exchanges(I.exchanges(t), "url", "payload", declared="declared").withColumn("endpoint", F.regexp_extract("url", r"net/([^?]*)", 1))
    return D.rank_candidates(df, ["run_id", "endpoint"], "entry_index").select("run_id", "endpoint", "score", "entry_index", "sample_count")


@query("K1", f"""with {I.EXCHANGES}, {_SCORED} select run_id, entry_index, score, rank::integer as rank from (select *, row_number() over (partition by run_id order by score desc, entry_index) as rank from judged) where rank <= 5""")
def top_candidates(t):
    """Top five candidates per run."""
    df = D.score_exchanges(I.exchanges(t), "url", "payload", declared="declared").select("run_id", "entry_index", "score")
    return top_k(df, "run_id", [F.desc("score"), F.asc("entry_index")], 5)


@query("K4", f"""with p as (select o_custkey as site, o_orderkey as ordinal, o_orderstatus = 'F' as list_sufficient, case o_orderpriority when '1-URGENT' then 5.0 when '2-HIGH' then 4.5 when '3-MEDIUM' then 4.0 when '5-LOW' then 2.0 else 1.0 end::double as tier,
 case when o_orderkey % 3 = 0 then 'HIGH' else 'MEDIUM' end as confidence from orders)
select site, ordinal, tier, confidence from (select *, row_number() over (partition by site order by list_sufficient desc, tier desc, confidence = 'HIGH' desc, ordinal) as r from p) where r = 1""")
def selected_sources(t):
    """Best plan per site: list-sufficient, tier, confidence, support, first seen."""
    mode = F.expr("case o_orderpriority when '1-URGENT' then 'HTTP_API' when '2-HIGH' then 'HTML' when '3-MEDIUM' then 'BROWSER_RUNTIME_DATA' else 'OTHER' end")
    ready = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    df = t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderstatus") == "F").alias("list_sufficient"),
                         P.plan_tier(mode, ready, F.col("o_orderpriority") == "5-LOW").alias("tier"),
                         F.when(F.col("o_orderkey") % 3 == 0, "HIGH").otherwise("MEDIUM").alias("confidence"), F.lit(True).alias("supported"))
    return P.select_source(df, "site").select("site", "ordinal", "tier", "confidence")


@query("G19", f"""with {I.POSTINGS}, f as (select source, lang, count(*) as n, count(*) filter ({S.strip('title')} <> '') as titled from postings group by source, lang)
select source, case lang when 'en' then 'jobId' when 'fr' then 'postId' when 'de' then 'id' end as field, n as coverage from (
 select *, row_number() over (partition by source order by n desc, case lang when 'en' then 'jobId' when 'fr' then 'postId' else 'id' end collate "C") as r from f where lang <> 'es') where r = 1""".replace(' collate "C"', ''))
def field_coverage(t):
    """Most covered id field per run."""
    profile = D.field_profile(I.records(t).select("source", "rec"), "source", "rec")
    return D.best_fields(profile, "source", V.ARRAY_ID_KEY)


@query("G20", """with d as (select source, count(*) as n, count(*) filter (lang = 'en') as en from documents group by source)
select source, case when en > 0 then 'detailUrl' end as url_field, round(en / n, 6) as url_coverage, true as ids_unique from d""")
def url_fields(t):
    """Address field of a run's records, its coverage, and id uniqueness."""
    return D.url_field_profile(I.records(t), "source", "v", None, F.col("doc_id"))


@query("G21", """with d as (select distinct c_nationkey as run_id, c_name as name from customer), r as (select *, row_number() over (partition by run_id order by name) as r, count(*) over (partition by run_id) as n from d)
select run_id, any_value(n) as company_count, string_agg(name, '|' order by name) as companies from r where r <= 30 group by run_id""")
def observed_employers(t):
    """Distinct employers per run, the first thirty shown."""
    return D.observed_companies(t.customer.select(F.col("c_nationkey").alias("run_id"), F.col("c_name").alias("name")), "run_id", "name")


_SIGNALS = """signals as (select user_id as site, case event_type when 'view' then 'moka' when 'click' then 'moka' when 'error' then 'zhiye' else 'feishu' end as provider,
 case event_type when 'view' then 'API_PATH' when 'click' then 'RESPONSE_ENVELOPE' else 'ROUTE_PATTERN' end as signal_type, event_id % 4 as weight,
 case event_type when 'view' then 'api' when 'click' then 'envelope' when 'error' then 'route' else event_type end as grp, (event_type = 'error' and value > 200) as host_match from events)"""


@query("G22 G23", f"""with {_SIGNALS}, p as (select site, provider, sum(weight)::bigint as score, count(distinct grp) as groups, count(*) as n, bool_or(host_match) as hm, bool_or(signal_type = 'RESPONSE_ENVELOPE') as enc from signals group by site, provider),
 k as (select *, case when hm then 3 when groups >= 2 and score >= 5 then 3 when groups >= 2 then 2 else 1 end as rank from p),
 b as (select *, row_number() over (partition by site order by rank desc, groups desc, n desc, provider) as r from k)
select site, case when not hm and rank = 1 then 'UNKNOWN' else provider end as provider, score, groups, case rank when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as confidence,
 case when hm then 'KNOWN_ADAPTER' || case when enc then '|ENCRYPTED_BROWSER_API' else '|DOM_ONLY' end when enc then 'ENCRYPTED_BROWSER_API' else 'DOM_ONLY' end as capability from b where r = 1""")
def provider_fingerprints(t):
    """Which provider runs a site, and what collection it allows."""
    df = t.events.selectExpr(
        "user_id as site", "case event_type when 'view' then 'moka' when 'click' then 'moka' when 'error' then 'zhiye' else 'feishu' end as provider",
        "case event_type when 'view' then 'API_PATH' when 'click' then 'RESPONSE_ENVELOPE' else 'ROUTE_PATTERN' end as signal_type", "event_id % 4 as weight",
        "case event_type when 'view' then 'api' when 'click' then 'envelope' when 'error' then 'route' else event_type end as independent_group",
        "(event_type = 'error' and value > 200) as host_match")
    out = D.provider_fingerprint(df, "site")
    no = F.lit(False)
    return out.select("site", "provider", "score", "groups", "confidence",
                      join(D.capability("host_match", "encrypted", no, no, F.lit("GET"), F.lit(True))).alias("capability"))


@query("G27", f"""with {I.URLS} select page_id, v, case v when 2 then 'PAGE' when 5 then 'OFFSET' when 10 then 'PAGE' end as kind,
 case v when 2 then 'page' when 5 then 'offset' when 10 then 'page' end as page_param, case v when 2 then 'pageSize' when 5 then 'limit' when 10 then 'per_page' end as size_param,
 case v when 10 then 1 end::bigint as first_page, case v when 2 then 20 when 5 then 10 when 10 then 50 end::bigint as page_size,
 case when v in (2, 5, 10) then case when v = 5 then 0.94 else 0.8 end else 0.0 end::double as confidence from urls""")
def inferred_pagination(t):
    """Pagination model of a request from its own field names."""
    df = I.urls(t).withColumn("p", D.infer_pagination(U.pairs(U.query("url")), F.when(F.col("v") == 5, F.lit(100))))
    return df.select("page_id", "v", "p.*")


@query("G39", f"""with o as (select user_id as run_id, event_id % 30 * 10 as off, case event_type when 'view' then 10 when 'click' then 20 else 50 end as lim from events),
 m as (select run_id, lim, count(*) as n from o group by run_id, lim), b as (select *, row_number() over (partition by run_id order by n desc, lim) as r from m)
select o.run_id, min(off)::bigint as initial_offset, count(*) as requests, any_value(b.lim)::integer as modal_limit from o join b on o.run_id = b.run_id and b.r = 1 group by o.run_id""")
def observed_pages(t):
    """Smallest offset and usual limit of each run's requests."""
    df = t.events.selectExpr("user_id as run_id", "event_id % 30 * 10 as off", "case event_type when 'view' then 10 when 'click' then 20 else 50 end as lim")
    return D.observed_pagination(df, "run_id", "off", "lim").select("run_id", "initial_offset", "requests", "modal_limit")


@query("G26", """with e as (select o_custkey as container, o_orderkey % 40 as value, case when o_orderkey % 7 = 0 then 'page 3' when o_orderkey % 7 = 1 then '12 jobs shown' when o_orderkey % 7 = 2 then 'showing 1 to 10' else 'total' end as text, o_orderkey % 5 as cards, 60 + o_orderkey % 20 as near from orders),
 s as (select container, value, case when text = 'page 3' then 'PAGE_NUMBER' when text = '12 jobs shown' then 'CURRENT_PAGE_COUNT' when text = 'showing 1 to 10' then 'RANGE_END' when value < cards then 'CURRENT_PAGE_COUNT' when near < 70 then 'UNKNOWN_TOTAL' else 'TOTAL_RESULTS' end as sem from e)
select container, case when count(distinct value) filter (sem = 'TOTAL_RESULTS') = 1 then min(value) filter (sem = 'TOTAL_RESULTS') end as total, count(distinct value) filter (sem = 'TOTAL_RESULTS') > 1 as conflict from s group by container""")
def bound_totals(t):
    """Total of a list container from the counts shown around it."""
    df = t.orders.selectExpr("o_custkey as container", "o_orderkey % 40 as value", "o_orderkey % 5 as cards", "60 + o_orderkey % 20 as near",
                             "case when o_orderkey % 7 = 0 then 'page 3' when o_orderkey % 7 = 1 then '12 jobs shown' when o_orderkey % 7 = 2 then 'showing 1 to 10' else 'total' end as text")
    return D.bind_total(df.withColumn("sem", D.classify_total("text", "value", "cards", F.lit(False), "near")), "container", "value", "sem", "TOTAL_RESULTS")


@query("G36", f"""with {I.EXCHANGES} select entry_index, 'generic-' || sha256(concat_ws('|', run_id || '.example.net', 'GET', case lang when 'en' then 'result.list' when 'fr' then 'menu' when 'de' then 'data.rows' else '$' end,
 case lang when 'de' then 'id' when 'es' then 'positionId' else '' end, case lang when 'de' then 'name' when 'es' then 'positionName' else '' end))[1:16] as profile_id from exchanges""")
def source_profiles(t):
    """Stable profile id of a source contract."""
    df = D.response_shape(I.exchanges(t), "payload")
    pick = lambda vocab: F.filter("sample_fields", lambda k: F.lower(k).isin(vocab))
    ids, titles = pick([x.lower() for x in V.RECORD_ID_FIELDS]), pick(["title", "name", "jobtitle", "positionname"])
    return df.select("entry_index", D.profile_digest(U.host("url"), F.lit("GET"), "array_path", ids, titles).alias("profile_id"))


@query("G12", """with n as (select s_nationkey % 3 as site, trim(s_name) as name, trim(regexp_extract(trim(s_name), '^[A-Za-z0-9][A-Za-z0-9 &.-]{2,15}', 0)) as head from supplier union all
 select s_nationkey % 3, '中国远洋' || s_suppkey, '中国远洋' from supplier),
 t as (select site, count(distinct name) as names from n group by site), p as (select site, head[1:i] as prefix, count(*) as n from n, range(2, 30) as r(i) where i <= length(head) group by site, prefix),
 b as (select *, row_number() over (partition by site order by n desc, length(prefix) desc, prefix) as r from p)
select site, prefix, n, names from b join t using (site) where r = 1 and n >= 5 and n / names >= 0.3""")
def dominant_brands(t):
    """Brand prefix shared by the employers of a portal."""
    cjk = t.supplier.select((F.col("s_nationkey") % 3).alias("site"), F.concat(F.lit("中国远洋"), "s_suppkey").alias("name"))
    return D.dominant_prefix(t.supplier.select((F.col("s_nationkey") % 3).alias("site"), F.col("s_name").alias("name")).unionAll(cjk), "site", "name")


@query("G13", """select s_suppkey, case when s_suppkey % 3 = 0 then 'Coscoship ' || s_suppkey when s_suppkey % 3 = 1 then 'Title ' || s_suppkey end as site_company, case when s_suppkey % 3 = 2 then null when s_suppkey % 3 = 1 then null else 'Coscoship ' || s_suppkey end as tenant_name from supplier""")
def site_owners(t):
    """Owner of a hosted portal: a parentless tenant node or the title, backed by the host or the employers."""
    third = F.col("s_suppkey") % 3
    node = F.concat(F.lit('{"code":0,"data":{"list":{"company_id":1,"company_parent_id":'), F.when(third == 1, '"9"').otherwise('""'),
                    F.lit(',"name":"Coscoship '), "s_suppkey", F.lit('"}}}'))
    df = t.supplier.withColumn("p", R.parse(F.when(third == 2, F.lit("{}")).otherwise(node)))
    df = D.tenant_roots(df, "p").withColumn("url", F.concat(F.lit("https://coscoship"), F.when(third == 1, F.lit("x")).otherwise(F.col("s_suppkey").cast("string")), F.lit(".iguopin.com/")))
    df = df.withColumn("brand", F.when(third == 1, F.concat(F.lit("Title "), "s_suppkey"))).withColumn("prefix", F.when(third == 1, F.lit("Title")).otherwise(F.lit(None).cast("string")))
    return D.site_owner(df, "url", "tenant_name", "brand", "prefix").select("s_suppkey", "site_company", "tenant_name")


@query("G33", """with s as (select user_id as site, event_type, count(*) over (partition by user_id) as attempts from events)
select site, count(distinct case when site % 3 = 0 then 'same' when site % 3 = 1 then (event_type = 'view')::varchar else event_type end) as signatures, any_value(attempts) as attempts,
 case when count(distinct case when site % 3 = 0 then 'same' when site % 3 = 1 then (event_type = 'view')::varchar else event_type end) = 1 then 'STABLE'
 when count(distinct case when site % 3 = 0 then 'same' when site % 3 = 1 then (event_type = 'view')::varchar else event_type end) = 2 and any_value(attempts) >= 3 then 'MOSTLY_STABLE' else 'UNSTABLE' end as state from s group by site""")
def discovery_stability(t):
    """Agreement of repeated discovery runs."""
    sign = F.expr("case when user_id % 3 = 0 then 'same' when user_id % 3 = 1 then cast(event_type = 'view' as string) else event_type end")
    df = t.events.select(F.col("user_id").alias("site"), F.substring(F.sha2(F.to_json(F.struct(sign.alias("terminal"))), 256), 1, 16).alias("signature"))
    return D.stability(df, "site", "signature")


@query("W5 U3", """with e as (select user_id, min(event_id) as a, max(event_id) as b from events group by user_id having count(*) > 1),
 j as (select e.user_id, x.event_type as t1, y.event_type as t2, json_extract_string(x.props, '$.k') as k1, json_extract_string(y.props, '$.k') as k2 from e join events x on x.event_id = a join events y on y.event_id = b)
select user_id, concat_ws(', ', case when k1 <> k2 then 'page: ' || k1 || ' -> ' || k2 end, case when t1 <> t2 then 'type: ' || t1 || ' -> ' || t2 end) as observed_change from j""")
def request_changes(t):
    """What changed between the first and the last request of an endpoint."""
    df = t.events.select("user_id", "event_id", F.create_map(F.lit("page"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"),
                         F.lit("sessionKey"), F.col("event_id").cast("string")).alias("params"))
    return D.param_changes(df, "user_id", "event_id", "params")


@query("U3", """select doc_id, case lang when 'en' then 'id|title' when 'fr' then 'id' else '' end as common, case lang when 'en' then 1.0 when 'fr' then 0.3333 else 0.0 end::double as overlap from documents""")
def key_overlaps(t):
    """Common keys of two key sets and their overlap."""
    a = F.array(F.lit("title"), F.lit("id"))
    b = F.expr("case lang when 'en' then array('id', 'title') when 'fr' then array('id', 'name') else array('x') end")
    return t.documents.select("doc_id", join(D.common_keys(a, b)).alias("common"), D.jaccard(a, b).alias("overlap"))


@query("F23", """select o_orderkey, case o_orderstatus when 'F' then 'zh-CN' when 'O' then o_custkey::varchar else 'campus' end as locale,
 case o_orderstatus when 'F' then true when 'O' then true else false end as same from orders""")
def trusted_scopes(t):
    """Request scope values bound to the page's own scope; shape differences are not differences."""
    ours = F.expr("case o_orderstatus when 'F' then 'zh-CN' when 'O' then cast(o_custkey as string) else 'social' end")
    page = F.expr("case o_orderstatus when 'F' then 'ZH_cn' when 'O' then concat(cast(o_custkey as string), '.0') else 'campus' end")
    df = t.orders.withColumn("m", P.trusted_scope(F.create_map(F.lit("Site_Locale"), ours), F.create_map(F.lit("siteLocale"), page)))
    return df.select("o_orderkey", F.try_element_at("m", F.lit("Site_Locale")).alias("locale"), P.same_scope_value(ours, page).alias("same"))
