"""Queries over captured addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import company as C, redact as X, urls as U
from . import inputs as I, sql as S
from .registry import query

_CLEAN = "(select page_id, v, case when v = 11 then regexp_extract(url, '\\(([^)]*)\\)', 1) else url end as url from urls)"


@query("S4 S5 G39", f"""with {I.URLS}
select page_id, v, {S.param('url', 'page')} as page_param, {S.param('url', 'keyword')} as keyword,
 try_cast(case when v = 7 then null else {S.param('url', 'page')} end as bigint) as page,
 try_cast(case v when 2 then '20' when 5 then '10' when 10 then null end as bigint) as page_size,
 (case v when 0 then len(list_filter(string_split({S.query('url')}, '&'), lambda x: x <> '')) when 1 then 4
  when 2 then 3 when 4 then 2 when 5 then 2 when 6 then 1 when 7 then 2 when 9 then 2 when 10 then 3 else 0 end)::integer as n
from urls""")
def request_params(t):
    """Query parameters with the first key winning; page and size by canonical alias."""
    p = U.request_params("url")
    df = I.urls(t).withColumn("p", p).withColumn("pick", U.page_params("p"))
    return df.select("page_id", "v", F.try_element_at("p", F.lit("page")).alias("page_param"),
                     F.try_element_at("p", F.lit("keyword")).alias("keyword"), F.col("pick.page").alias("page"),
                     F.col("pick.size").alias("page_size"), F.size("p").alias("n"))


@query("S4", """select doc_id, cast(doc_id as varchar) as page, lang as scope, 'x' as kept,
 (case when lang = 'es' then 3 else 4 end)::integer as n from documents""")
def body_params(t):
    """JSON body keys override query keys; an unreadable body changes nothing."""
    url = F.concat(F.lit("https://h.example/api?page="), F.col("doc_id"), F.lit("&kept=x&scope="), F.col("lang"), F.lit("&scope=late"))
    body = F.when(F.col("lang") == "es", F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.col("doc_id").alias("page"), F.lit(7).alias("size"))))
    df = t.documents.select("doc_id", U.request_params(url, body).alias("p"))
    item = lambda k: F.try_element_at("p", F.lit(k))
    return df.select("doc_id", item("page").alias("page"), item("scope").alias("scope"), item("kept").alias("kept"),
                     F.size("p").alias("n"))


_KEPT = ("array_to_string(list_filter(list_transform(list_filter(string_split({q}, '&'), lambda x: x <> ''), "
         "lambda x: case when contains(x, '=') then x else x || '=' end), "
         "lambda x: not regexp_matches(split_part(x, '=', 1), '(?i)(utm_|tracking|source|campaign|ref$)')), '&')")


@query("T11", f"""with {I.URLS}, p as (select page_id, v, {S.scheme('url')} as s, lower({S.netloc('url')}) as n,
  regexp_replace({S.path('url')}, '/+$', '') as pa, {_KEPT.format(q=S.query('url'))} as k, url from urls)
select page_id, v, case when s = '' then url else s || '://' || n || pa || case when k <> '' then '?' || k else '' end end as canonical from p""")
def canonical_url(t):
    """Addresses without case, tracking and fragment noise."""
    return I.urls(t).select("page_id", "v", U.canonical_url("url").alias("canonical"))


@query("T12", f"""with {I.URLS}, p as (select page_id, v, {S.scheme('url')} as s, lower({S.netloc('url')}) as n,
  regexp_replace({S.path('url')}, '/+$', '') as pa, array_to_string(list_sort(list_transform(list_filter(string_split(
  {S.query('url')}, '&'), lambda x: x <> ''), lambda x: case when contains(x, '=') then x else x || '=' end)), '&') as k,
  url from {_CLEAN})
select page_id, v, s || '://' || n || case when pa = '' then '/' else pa end || case when k <> '' then '?' || k else '' end
 as normalized, case when v = 1 then replace(replace(url, 'HTTPS', 'https'), split_part(url, '/', 3), lower(split_part(url, '/', 3)))
 else url end as cleaned from p""")
def normalized_url(t):
    """Source address with a sorted query, after cleaning a pasted link."""
    df = I.urls(t).withColumn("cleaned", U.clean_input_url("url"))
    return df.select("page_id", "v", U.normalized_source_url("cleaned").alias("normalized"), "cleaned")


@query("T13", f"""with {I.URLS} select page_id, v,
 case v when 1 then page_id || 'a-1' when 2 then page_id::varchar
  when 3 then page_id || '00001' end as value,
 case v when 1 then 'detail_url_path_id' when 2 then 'query:jobId' when 3 then 'detail_url_fragment_id' end as source
 from urls""")
def url_identifier(t):
    """The record id a detail address carries."""
    df = I.urls(t).withColumn("f", U.url_identifier("url"))
    return df.select("page_id", "v", F.col("f.value").alias("value"), F.col("f.source").alias("source"))


@query("T5", f"""with {I.URLS} select page_id, v,
 case v when 2 then 'jobid=' || page_id || ';position=detail' when 3 then 'job=' || page_id || '00001' else '' end as ids
 from urls""")
def path_bound_ids(t):
    """Ids an address is bound to, with the key that names them."""
    df = I.urls(t).withColumn("ids", U.path_bound_ids("url"))
    shown = F.array_join(F.transform("ids", lambda s: F.concat(s["name"], F.lit("="), s["value"])), ";")
    return df.select("page_id", "v", shown.alias("ids"))


@query("T22", f"""with {I.URLS} select page_id, v, case
 {' '.join(f"when {S.any_of('lower(url)', terms)} then {S.q(name)}" for name, terms in V.REQUEST_CLASSES)}
 else 'OTHER' end as class from urls""")
def request_classes(t):
    """What kind of traffic a request is."""
    return I.urls(t).select("page_id", "v", U.classify_request("url").alias("class"))


@query("F19", f"""with {I.URLS} select page_id, v,
 {S.any_of(f"lower({S.path('url')} || '?' || {S.query('url')})", V.URL_JOB_TERMS)} as job_like,
 {S.any_of('lower(url)', V.URL_CONFIG_TERMS)} as config_like from urls""")
def url_semantics(t):
    """Job-like (path and query only) and config-like addresses."""
    return I.urls(t).select("page_id", "v", U.is_job_url("url").alias("job_like"), U.is_config_url("url").alias("config_like"))


@query("F18", f"""with {I.URLS}, b as (select page_id, url as base from urls where v = 0),
 r as (select u.page_id, u.v, {S.host('base')} = {S.host('u.url')} as same, string_split_regex(lower(case when
  {S.fragment('u.url')} <> '' then split_part({S.fragment('u.url')}, '?', 1) else {S.path('u.url')} end), '[^a-z0-9]+') as tok
  from urls u join b using (page_id))
select page_id, v, (same and len(list_intersect(tok, [{S.names(V.NON_ROUTE_TERMS)}])) = 0
 and len(list_intersect(tok, [{S.names(V.ROUTE_TERMS)}])) > 0) as in_scope from r""")
def route_scope(t):
    """Is a route on the same host and inside the recruitment part of the site?"""
    forms = I.urls(t)
    base = t.pages.select("page_id", F.col("url").alias("base"))
    return forms.join(base, "page_id").select("page_id", "v", U.route_in_scope("base", "url").alias("in_scope"))


@query("T23", f"""with {I.URLS} select page_id, v,
 case v when 7 then 'keyword=java' when 6 then 'category=' || page_id when 9 then 'location=Paris' else '' end as filters,
 case when contains(lower(url), 'campus') then 'campus' when contains(lower(url), 'social') then 'social'
  when contains(lower(url), 'intern') then 'intern' when contains(lower(url), 'graduate') then 'graduate'
  when contains(lower(url), 'experienced') then 'experienced' end as recruitment_type,
 case v when 8 then 'new york city' end as location from urls""")
def url_scopes(t):
    """The slice of jobs an address already narrows to."""
    df = I.urls(t).withColumn("s", U.url_scope("url"))
    return df.select("page_id", "v", "s.filters", "s.recruitment_type", "s.location")


@query("X2", f"""with {I.URLS} select page_id, v, case v when 1 then 'https:' || split_part(split_part(url, '?', 1), ':', 2) else split_part(split_part(url, '#', 1), '?', 1) end as url, case v
 when 0 then {S.query('url')} when 1 then 'utm_source=x&resource_id=7&b=2&a=1' when 2 then 'jobId=' || page_id || '&page=2&pageSize=20'
 when 4 then 'token=[REDACTED]' when 5 then 'offset=20&limit=10' when 6 then 'category=' || page_id
 when 7 then 'keyword=java&current=3' when 9 then 'location=Paris' when 10 then 'page=1&page=7&size=x&per_page=50'
 else '' end as query from urls""")
def safe_urls(t):
    """Addresses without their query, and the query with secrets redacted."""
    df = I.urls(t).withColumn("s", X.safe_url("url"))
    return df.select("page_id", "v", "s.url", "s.query")


@query("T9", f"""with {I.URLS}, p as (select page_id, v, {S.host('url')} as h from urls),
 q as (select page_id, v, h, split_part(h, '.', -2) as root, split_part(h, '.', 1) as first from p)
select page_id, v, case v when 5 then 'Xg' || page_id when 7 then 'Brand' || page_id when 8 then 'Byd' || page_id
 when 6 then case when length(first) < 2 or first in ({S.names(V.INFRA_LABELS)}) then null
   else upper(first[1]) || first[2:] end
 when 0 then null when 10 then case when split_part(h, '.', 2) in ({S.names(V.INFRA_LABELS)}) or length(split_part(h, '.', 2)) < 2
   then null else upper(split_part(h, '.', 2)[1]) || split_part(h, '.', 2)[2:] end end as company
 from q""")
def site_company(t):
    """Company label a site address gives away; reserved example hosts give none."""
    return I.urls(t).select("page_id", "v", C.infer_site_company("url").alias("company"))


@query("T10", f"""with {I.URLS}, p as (select page_id, v, {S.host('url')} as h from urls)
select page_id, v, case v when 5 then 'xg' || page_id when 6 then nullif(split_part(h, '.', 1), 'www')
 when 10 then split_part(h, '.', 2) end as token from p""")
def brand_tokens(t):
    """Tenant label of a hosted platform address."""
    return I.urls(t).select("page_id", "v", U.brand_token("url").alias("token"))


@query("T14 T11 T13", f"""with {I.URLS}, k as (select page_id, v, url, {S.scheme('url')} || '://' || lower({S.netloc('url')}) ||
  regexp_replace({S.path('url')}, '/+$', '') as bare, {_KEPT.format(q=S.query('url'))} as k from urls)
select page_id, v, case v when 1 then 'CANONICAL_URL_ID' when 2 then 'STRUCTURED_DETAIL_ID' when 3 then 'CANONICAL_URL_ID'
 else 'COMPOSITE_FINGERPRINT' end as identity_source,
 case v when 1 then page_id || 'a-1' when 2 then page_id::varchar when 3 then page_id || '00001'
 when 11 then sha256(concat_ws(chr(31), url, 't' || page_id, '', '', ''))[1:24]
 else sha256(concat_ws(chr(31), bare || case when k <> '' then '?' || k else '' end, 't' || page_id, '', '', ''))[1:24] end
 as identity_value from k""")
def url_identity(t):
    """Stable identity of records known only by address and title."""
    from ..operators.identity import job_identity

    df = I.urls(t).withColumn("title", F.concat(F.lit("t"), F.col("page_id")))
    return job_identity(df, url="url", title="title").select("page_id", "v", "identity_source", "identity_value")


@query("P20", f"""with {I.URLS} select page_id, v,
 case v when 5 then 'org' || page_id end as org_id, case v when 5 then page_id::bigint end as site_id,
 case v when 5 then 'campus' end as mode, case v when 10 then 'social' end as business_type,
 case v when 10 then '1' end as category from urls""")
def page_scopes(t):
    """Tenant scope a platform address states: organisation, site, mode or business type."""
    from ..operators.providers import address_scope

    return address_scope(I.urls(t), "url").select(
        "page_id", "v", "org_id", "site_id", "mode", "business_type", "category")


@query("T24", f"""with {I.URLS} select page_id, v, case v when 5 then '' when 1 then '' else '' end as identity,
 'scope ' || v as label from urls""")
def url_scope_identity(t):
    """Request fields that make a separate collection scope (none on plain addresses) and its label."""
    from ..operators.planning import scope_identity, scope_label

    df = I.urls(t).withColumn("p", U.request_params("url"))
    return df.select("page_id", "v", scope_identity("p").alias("identity"),
                     scope_label(F.lit(None), F.lit(None), F.concat(F.lit("scope "), F.col("v"))).alias("label"))


@query("T24", """select o_orderkey, 'channel=' || lower(o_orderpriority[1:1]) || ';nature=' || o_orderstatus as identity,
 case o_orderstatus when 'F' then 'tab ' || o_orderpriority when 'O' then o_orderpriority else 'scope ' || o_orderkey end as label
 from orders""")
def scope_labels(t):
    """Scope identity from request values; label from the tab, else a sample value, else its number."""
    from ..operators.planning import scope_identity, scope_label

    df = t.orders.withColumn("p", F.create_map(
        F.lit("nature"), F.col("o_orderstatus"), F.lit("channel"), F.lower(F.substring("o_orderpriority", 1, 1)),
        F.lit("page"), F.lit("3"), F.lit("limit"), F.lit("20")))
    phase = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("SCOPE_tab "), F.col("o_orderpriority"))).otherwise("LIST")
    hint = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
    return df.select("o_orderkey", scope_identity("p").alias("identity"),
                     scope_label(phase, hint, F.concat(F.lit("scope "), F.col("o_orderkey"))).alias("label"))


@query("F21 F15", f"""with {I.URLS}, b as (select page_id, {S.host('url')} as source from urls where v = 0),
 p as (select u.page_id, u.v, b.source, {S.scheme('u.url')} as s, {S.host('u.url')} as h, u.v % 5 as hops
  from urls u join b using (page_id))
select page_id, v, (s in ('http', 'https') and (h = source or ends_with(h, '.mokahr.com'))) as trusted_url,
 (source <> '' and h <> '' and hops <= 3 and h = source) as trusted_navigation from p""")
def url_trust(t):
    """Addresses allowed as detail sources, and navigations that stayed where they were sent."""
    from ..operators.filters import navigation_trust, trusted_detail_url

    df = I.urls(t).join(t.pages.select("page_id", U.host("url").alias("source")), "page_id")
    df = df.withColumn("h", U.host("url"))
    return df.select(
        "page_id", "v", trusted_detail_url("url", "source", hosts=[], observed=F.col("h").endswith(".mokahr.com")).alias("trusted_url"),
        navigation_trust("source", F.col("source"), "h", F.col("v") % 5, F.lit(True)).alias("trusted_navigation"))
