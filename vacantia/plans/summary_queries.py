"""Run-level summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import export as E, jd as J, records as R, urls as U
from ..operators import detail_urls as D, filters as L, identity as ID, summaries as M, windows as W
from . import inputs as I, sql as S
from .registry import query


def _attempts(t):
    return I.attempts(t).withColumns({"usable": L.usable("status", "success", "list_count"), "status_ok": F.col("status").between(200, 299)})


def _records(best):
    """Records of the chosen pages: one row per list position."""
    pages = best.filter("usable")
    return pages.select("run_id", "event_id", F.posexplode(F.sequence(F.lit(1).cast("bigint"), "list_count")).alias("pos", "_i"), "page").select(
        "run_id", "event_id", "pos", ((F.col("page") * 7 + F.col("_i")) % 500).alias("job_id"))


_BEST = f"""{I.ATTEMPTS}, a as (select *, status between 200 and 299 as status_ok, (status between 200 and 299 and success and list_count > 0) as usable from attempts),
 best as (select * from (select *, row_number() over (partition by run_id, page order by usable desc, status_ok desc, list_count desc, event_id desc) as r from a) where r = 1),
 recs as (select run_id, event_id, i - 1 as pos, (page * 7 + i) % 500 as job_id from best, unnest(range(1, list_count + 1)) as u(i) where usable)"""


@query("W1 F1", f"with {_BEST} select run_id, page, event_id, usable, list_count from best")
def best_pages(t):
    """Best attempt of every logical page of a run."""
    return W.best_per_page(_attempts(t), "run_id", "page", "event_id", "usable", "status_ok", "list_count").select("run_id", "page", "event_id", "usable", "list_count")


@query("G1", f"""with {_BEST}, e as (select run_id, count(*) as har_entries, count(*) filter (usable) as usable_responses, count(*) filter (event_type = 'error') as malformed from a group by 1),
 b as (select run_id, count(*) filter (usable) as pages_observed from best group by 1), r as (select run_id, count(*) as raw_rows, count(distinct job_id) as unique_jobs from recs group by 1)
select run_id, har_entries, har_entries as matched, usable_responses, har_entries - usable_responses as failed_responses, malformed as malformed_json_responses, pages_observed, coalesce(raw_rows, 0) as raw_rows,
 coalesce(unique_jobs, 0) as unique_jobs, coalesce(raw_rows - unique_jobs, 0) as duplicate_jobs from e join b using (run_id) left join r using (run_id)""")
def import_metrics(t):
    """Import counters of every run: attempts, pages, rows, unique ids, copies."""
    a = _attempts(t)
    best = W.best_per_page(a, "run_id", "page", "event_id", "usable", "status_ok", "list_count")
    out = M.har_metrics(a.withColumn("malformed", F.col("event_type") == "error"), best, _records(best), "run_id")
    return out.select("run_id", "har_entries", "matched", "usable_responses", "failed_responses", "malformed_json_responses", "pages_observed", "raw_rows", "unique_jobs", "duplicate_jobs")


@query("W1 W2", f"""with {_BEST.split(' best as')[0]} p as (select * replace (case when event_id % 7 <> 0 then page end as page) from a), k as (select *, coalesce(page::varchar, 'index' || event_id) as page_key from p),
 f as (select *, min(event_id) over (partition by run_id, page_key) as page_rank, row_number() over (partition by run_id, page_key order by usable desc, status_ok desc, list_count desc, event_id desc) as best from k),
 o as (select run_id, event_id, page_rank, i - 1 as pos, (coalesce(page, event_id) * 7 + i) % 500 as job_id from f, unnest(range(1, list_count + 1)) as u(i) where best = 1 and usable),
 d as (select *, row_number() over (partition by run_id, job_id order by page_rank, pos) as r from o) select run_id, job_id, event_id, pos::integer as pos from d where r = 1""")
def first_records(t):
    """First record of every stable id, pages in order of first appearance."""
    a = _attempts(t)
    # every seventh attempt names no page: it stands alone, at its own place
    a = ID.page_ranked(a.withColumn("page", F.when(F.col("event_id") % 7 != 0, F.col("page"))), "run_id", "page", "event_id")
    best = W.best_per_page(a, "run_id", "page", "event_id", "usable", "status_ok", "list_count").filter("usable")
    records = best.select("run_id", "event_id", "page_rank", F.posexplode(F.sequence(F.lit(1).cast("bigint"), "list_count")).alias("pos", "_i"), "page")
    records = records.withColumn("job_id", (F.coalesce("page", "event_id") * 7 + F.col("_i")) % 500)
    return ID.dedupe_first(records.select("run_id", "job_id", "event_id", "pos", "page_rank"), ["run_id", "job_id"], ["page_rank", "pos"]).select("run_id", "job_id", "event_id", "pos")


@query("W2", "select min(doc_id) as doc_id, sha256(text) as job_id from documents group by sha256(text)")
def first_documents(t):
    """First copy of every distinct text."""
    df = t.documents.select(F.sha2("text", 256).alias("job_id"), "doc_id")
    return ID.dedupe_first(df, "job_id", "doc_id").select("doc_id", "job_id")


@query("G2 U1", """select o_custkey as run_id, case when count(distinct o_orderstatus = 'F') = 1 and count(distinct o_orderkey % 2) = 1 then min(o_orderkey % 2)::bigint end as agreed_total from orders group by 1""".replace("count(distinct o_orderstatus = 'F') = 1 and ", ""))
def agreed_totals(t):
    """The total all responses of a run agree on."""
    return M.agreed_total(t.orders.select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 2).alias("total")), "run_id", "total")


def _jobs(t):
    """Jobs of a run: text by language, structure by label."""
    none = F.array().cast("array<string>")
    df = I.postings(t).join(t.labels, "doc_id", "left")
    return df.select(
        F.col("source").alias("run_id"), "doc_id", "title", F.expr("case lang when 'de' then null when 'es' then title else body end").alias("full_jd"),
        F.expr("case lang when 'en' then 'FULL_TEXT' when 'fr' then 'SPLIT' when 'es' then 'SUMMARY' else null end").alias("jd_state"),
        F.when(F.col("quality") == 1, F.array("title")).otherwise(none).alias("responsibilities"),
        F.when(F.col("toxic") == 0, F.array("title", "lang")).otherwise(none).alias("requirements"), F.when(F.col("lang") == "fr", "require").alias("requirements_field"))


JOBS = f"""{I.POSTINGS}, jobs as (select source as run_id, doc_id, title, lang, case lang when 'de' then null when 'es' then title else body end as full_jd, case lang when 'en' then 'FULL_TEXT' when 'fr' then 'SPLIT' when 'es' then 'SUMMARY' end as jd_state,
 coalesce(quality = 1, false) as resp, coalesce(toxic = 0, false) as req from postings left join labels using (doc_id))"""


@query("G3", f"""with {JOBS}, g as (select *, coalesce(full_jd, '') <> '' as has, lang in ('en', 'fr') or (lang = 'de' and (length(coalesce(full_jd, '')) >= 160 or req or resp)) as ok from jobs)
select run_id, count(*) as total_jobs, count(*) filter (has) as complete_jobs, count(*) filter (not has) as missing_jd_jobs, count(*) filter (not req) as missing_requirements_jobs, count(*) filter (not resp) as missing_responsibilities_jobs,
 count(*) filter (has and ok) as jd_complete, count(*) filter (not (has and ok)) as jd_incomplete, count(*) filter (lang in ('en', 'fr')) as list_sufficient, count(*) filter (has and ok and lang <> 'fr') as source_requirements_absent,
 round(count(*) filter (has) / count(*), 6) as completeness_ratio from g group by run_id""")
def data_completeness(t):
    """Completeness counters per run."""
    return M.completeness(_jobs(t), "run_id")


@query("G4 G5", """with r as (select o_custkey as run_id, count(*) as fetched, count(distinct o_orderpriority) as uniq, count(*) filter (o_orderstatus = 'P') as errors, count(*) filter (o_orderkey % 50 = 0) as failed, o_custkey % 7 as expected_mod from orders group by o_custkey),
 e as (select *, case when expected_mod = 0 then null when expected_mod < 4 then uniq else fetched end as expected from r)
select run_id, case when expected is null then 'FAILED' when errors > 0 or failed > 0 or uniq <> expected then 'INCOMPLETE' else 'COMPLETE' end as status,
 case when expected_mod = 6 then 'FAILED' when coalesce(expected = fetched and (fetched = uniq or (fetched - uniq > 0 and errors = 0)) and errors = 0 and failed = 0 and (uniq > 0 or expected = 0), false) then 'COMPLETE' else 'INCOMPLETE' end as strict_status from e""")
def run_statuses(t):
    """Plain status and the strict completion contract of every run."""
    n = F.count_if
    r = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("fetched"), F.count_distinct("o_orderpriority").alias("uniq"),
                                                                n(F.col("o_orderstatus") == "P").alias("errors"), n(F.col("o_orderkey") % 50 == 0).alias("failed"))
    mod = F.col("run_id") % 7
    r = r.withColumn("expected", F.when(mod == 0, None).when(mod < 4, F.col("uniq")).otherwise(F.col("fetched")))
    no, zero = F.lit(False), F.lit(0)
    return r.select("run_id", M.collection_status(F.lit(True), "expected", "uniq", "errors", "failed", no, no).alias("status"),
                    M.completion_contract(F.when(mod == 6, 0).otherwise(1), "expected", "fetched", "uniq", F.col("fetched") - F.col("uniq"), "errors", "errors", F.lit(True), zero, "failed", zero, zero).alias("strict_status"))


_IDENT = """ident as (select doc_id, text, source as url, split_part(text, chr(10), 1) as title, lang as raw_id, case when lang = 'es' then 'COMPOSITE_FINGERPRINT' else 'STABLE_API_ID' end as identity_source, lower(split_part(text, ' ', 1)) as identity_value, sha256(text) as fp from documents),
 grp as (select identity_source, identity_value, count(*) as records, case when count(distinct fp) = 1 then 'IDENTICAL_SOURCE_RECORD' when identity_source <> 'COMPOSITE_FINGERPRINT' and count(distinct title) = 1 then 'SAME_REQUISITION_DUPLICATE_PRESENTATION'
  when count(distinct url) > 1 or count(distinct title) > 1 or count(distinct raw_id) > 1 then 'AMBIGUOUS_ID_COLLISION' else 'UNEXPLAINED_DUPLICATE' end as reason from ident group by 1, 2 having count(*) >= 2)"""


def _identified(t):
    return t.documents.select("doc_id", F.col("source").alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("lang").alias("raw_id"),
                              F.when(F.col("lang") == "es", "COMPOSITE_FINGERPRINT").otherwise("STABLE_API_ID").alias("identity_source"),
                              F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("identity_value"), F.sha2("text", 256).alias("fp"))


def _groups(t):
    return ID.duplicate_groups(_identified(t), ["identity_source", "identity_value"], "title", "url", "raw_id", "fp")


@query("G6", f"with {_IDENT} select identity_source, identity_value, records, reason from grp")
def duplicate_groups(t):
    """Identities seen more than once and why."""
    return _groups(t)


@query("G6", f"""with {_IDENT} select identity_source, count(*) as groups, sum(case when reason in ('IDENTICAL_SOURCE_RECORD', 'SAME_REQUISITION_DUPLICATE_PRESENTATION') then records - 1 else 0 end)::bigint as collapsed_count,
 sum(case when reason in ('IDENTICAL_SOURCE_RECORD', 'SAME_REQUISITION_DUPLICATE_PRESENTATION') then 0 else records - 1 end)::bigint as unexplained_count from grp group by 1""")
def duplicate_audit(t):
    """Collapsed and unexplained copies."""
    return ID.duplicate_audit(_groups(t), "identity_source")


@query("W7", f"""with {_IDENT}, f as (select *, min(doc_id) filter (title <> '') over (partition by identity_source, identity_value) as first_id from ident), j as (select f.*, g.reason as why from f left join grp g using (identity_source, identity_value))
select doc_id, case when title = '' then 'DROPPED_INVALID' when why in ('AMBIGUOUS_ID_COLLISION', 'UNEXPLAINED_DUPLICATE') then 'PRESERVED_COLLISION_SUFFIX' when doc_id > first_id then 'DROPPED_DUPLICATE' else 'PRESERVED' end as classification,
 case when title = '' then null when why in ('AMBIGUOUS_ID_COLLISION', 'UNEXPLAINED_DUPLICATE') then identity_value || ':' || sha256(fp)[1:12] else identity_value end as job_id,
 case when title = '' then 'TITLE_NOT_MAPPED' when why in ('AMBIGUOUS_ID_COLLISION', 'UNEXPLAINED_DUPLICATE') then null when doc_id > first_id then 'IDENTITY_ALREADY_PRESENT' end as reason from j""")
def dedup_trace(t):
    """Fate of every record."""
    out = ID.dedup_trace(_identified(t), ["identity_source", "identity_value"], "doc_id", _groups(t), "fp", F.col("title") != "", F.lit("TITLE_NOT_MAPPED"))
    return out.select("doc_id", "classification", "job_id", "reason")


@query("W8", """with i as (select doc_id, source as url, split_part(text, chr(10), 1) as title, lower(split_part(text, ' ', 1)) as idv from documents), f as (select *, min(doc_id) over (partition by idv) as first_id, first_value(url) over (partition by idv order by doc_id) as u0, first_value(title) over (partition by idv order by doc_id) as t0 from i)
select doc_id, case when doc_id = first_id then 'PRESERVED' when url = u0 and title = t0 then 'SAME_REQUISITION_DUPLICATE_PRESENTATION' else 'AMBIGUOUS_ID_COLLISION' end as classification,
 case when doc_id = first_id or (url = u0 and title = t0) then idv else idv || ':' || sha256(url)[1:12] end as job_id from f""")
def card_collisions(t):
    """Rendered cards that share an id."""
    df = t.documents.select("doc_id", F.col("source").alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("idv"))
    return ID.dom_collisions(df, "idv", "doc_id", "url", "title").select("doc_id", "classification", "job_id")


@query("W10", f"""with {I.POSTINGS}, c as (select *, count(*) over (partition by source, title) as n from postings)
select doc_id, case when lang = 'en' then 'J' || doc_id when title <> '' and n = 1 and lang <> 'de' then 'title:' || sha256(title)[1:24] end as identity, case when lang = 'en' then 'attribute' when title <> '' and n = 1 and lang <> 'de' then 'unique_title' end as identity_source,
 (lang <> 'en' and title <> '' and n > 1) as ambiguous from c""")
def title_identities(t):
    """Card identity by attribute, else by a title unique on its page."""
    df = I.postings(t).select("doc_id", "source", "title", F.when(F.col("lang") == "en", F.concat(F.lit("J"), "doc_id")).alias("explicit"), (F.col("lang") != "de").alias("has_sections"))
    return ID.title_identity(df, "source", "title", "explicit", "doc_id", "has_sections").select("doc_id", "identity", "identity_source", "ambiguous")


_CODES = [("BOT_CHALLENGE", "quality = 0"), ("JD_NOT_FOUND", "toxic = 1")]


@query("G7", """with r as (select source as run_id, doc_id, case lang when 'en' then 'DETAIL_API' when 'fr' then 'BROWSER_DOM' end as src, quality, toxic from documents left join labels using (doc_id)),
 b as (select run_id, case when src like 'BROWSER%' then 'browser' when src is not null then 'http' when quality = 0 then 'blocked' when toxic = 1 then 'failed' else 'pending' end as k from r)
select run_id, count(*) as total, count(*) filter (k = 'http') as http_resolved, count(*) filter (k = 'browser') as browser_resolved, count(*) filter (k = 'blocked') as blocked, count(*) filter (k = 'failed') as failed, count(*) filter (k = 'pending') as pending from b group by run_id""")
def detail_accounting(t):
    """Every record of a run in one detail bucket."""
    records = t.documents.select(F.col("source").alias("run_id"), "doc_id", F.expr("case lang when 'en' then 'DETAIL_API' when 'fr' then 'BROWSER_DOM' end").alias("src"))
    own = t.labels.join(t.documents.select("doc_id", F.col("source").alias("run_id")), "doc_id")
    errors = own.select("run_id", "doc_id", F.explode(F.array_compact(F.array(
        F.when(F.col("quality") == 0, "BOT_CHALLENGE"), F.when(F.col("toxic") == 1, "JD_NOT_FOUND"), F.lit("OTHER_NOTE")))).alias("code"))
    return M.detail_accounting(records, errors, "run_id", "doc_id", "src")


def _scoped(t):
    return t.orders.select((F.col("o_custkey") % 20).alias("run_id"), F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("scope"),
                           F.substring("o_orderpriority", 1, 1).cast("int").alias("scope_order"), F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") != "P").alias("stable"))


@query("G8", """with o as (select o_custkey % 20 as run_id, o_custkey as job_id, o_orderpriority as scope, o_orderpriority[1:1]::integer as so, o_orderkey as pos, o_orderstatus <> 'P' as stable from orders),
 p as (select run_id, job_id, scope, min(so) as so, min(pos) as pos, arg_min(stable, pos) as st, count(*) as n from o group by 1, 2, 3)
select run_id, job_id, arg_min(pos, so) as first_row, string_agg(scope, '|' order by so) as scopes, sum(n)::bigint as rows, case when arg_min(st, so) then count(*) filter (st) - 1 else 0 end as merged_rows from p group by 1, 2""")
def merged_scopes(t):
    """One row per posting across scopes, with the scopes in order."""
    return M.merge_scopes(_scoped(t), "run_id", "job_id", "scope", "scope_order", "pos", "stable")


_PROGRESS = """p as (select o_custkey % 20 as run_id, o_orderpriority as scope, count(*) as fetched, count(distinct o_custkey) as unique_jobs, case when o_orderpriority < '4' then count(*) else 5 end as official_total from orders group by 1, 2)"""


def _progress(t):
    totals = _scoped(t).groupBy("run_id", "scope").agg(F.count("*").alias("_n")).select("run_id", "scope", F.when(F.col("scope") < "4", F.col("_n")).otherwise(5).alias("official_total"))
    return M.scope_progress(_scoped(t), totals, "run_id", "scope", "job_id")


@query("G9", f"with {_PROGRESS} select run_id, scope, fetched, unique_jobs, official_total, case when official_total = fetched then 'SCOPE_COMPLETE' else 'SCOPE_INCOMPLETE' end as status from p")
def scope_progress(t):
    """Progress of every scope."""
    return _progress(t)


@query("G9", f"with {_PROGRESS} select run_id, case when bool_and(official_total = fetched) then 'SITE_COMPLETE' else 'SITE_INCOMPLETE' end as site_completion from p group by run_id")
def site_completion(t):
    """A site is complete when all its scopes are."""
    return M.site_completion(_progress(t), "run_id")


@query("G10 G11", """with u as (select o_custkey as run_id, case when count(distinct nullif(trim(case when o_custkey % 3 = 0 then 'Acme ' when o_orderstatus = 'F' then 'F co' else ' ' end), '')) = 1 then max(nullif(trim(case when o_custkey % 3 = 0 then 'Acme ' when o_orderstatus = 'F' then 'F co' else ' ' end), '')) end as unified from orders group by 1)
select run_id, unified as unified_company, coalesce(unified, case when run_id % 2 = 0 then 'Site' end, 'Brand' || run_id) as company from u""")
def run_companies(t):
    """Employer of a run: agreed by jobs, stated by the site, read from the host."""
    df = t.orders.select(F.col("o_custkey").alias("run_id"), F.expr("case when o_custkey % 3 = 0 then 'Acme ' when o_orderstatus = 'F' then 'F co' else ' ' end").alias("company"))
    runs = M.unified_company(df, "run_id", "company").withColumns({"explicit": F.when(F.col("run_id") % 2 == 0, "Site").otherwise(""),
                                                                 "url": F.concat(F.lit("https://careers.brand"), "run_id", F.lit(".com/x"))})
    return M.resolve_company(runs, "unified_company", "explicit", "url").select("run_id", "unified_company", "company")


def _targets(t):
    list_url = F.expr("case when lang = 'en' then concat('https://', source, '.example.net/api/jobs?id=1&page=2') else concat('https://', source, '.example.net/campus/list') end")
    df = I.records(t).withColumn("list_url", list_url)
    df = D.detail_url_candidates(df, "rec", "list_url")
    none = F.array().cast("array<string>")
    df = df.withColumns({"full_jd": F.when(F.col("lang") == "es", F.col("text")), "none": none})
    return D.resolve_targets(df, "full_jd", "none", "none", F.col("lang") == "de")


@query("T17 T18", f"""select doc_id, case lang when 'en' then 'jobId' when 'fr' then 'postId' when 'de' then 'id' end as id_field,
 case lang when 'en' then 'https://' || source || '.example.net/jobs/detail?jobId=' || doc_id when 'fr' then 'https://' || source || '.example.net/campus/list/pb/posDetail.html?postId=P' || doc_id || '&postType=campus' when 'de' then 'https://' || source || '.example.net/campus/list/pb/posDetail.html?id=' || doc_id || '&postType=campus' end as first_candidate,
 case lang when 'en' then 8 when 'es' then 0 else 6 end::bigint as candidates, case lang when 'en' then 'RENDERED_PAGE' when 'fr' then 'RENDERED_PAGE' when 'de' then 'AUTO_API' else case when {S.credible_body('text')} then 'LIST_SUFFICIENT' else 'LIST_ONLY' end end as method from documents""")
def detail_targets(t):
    """Detail addresses a record allows, and the method that follows."""
    return _targets(t).select("doc_id", F.col("detail_id_field").alias("id_field"), F.get("candidates", F.lit(0)).alias("first_candidate"), F.size("candidates").cast("bigint").alias("candidates"), "method")


@query("G28", f"""with m as (select source as run_id, doc_id, case lang when 'en' then 'RENDERED_PAGE' when 'fr' then 'RENDERED_PAGE' when 'de' then 'AUTO_API' else case when {S.credible_body('text')} then 'LIST_SUFFICIENT' else 'LIST_ONLY' end end as method, lang from documents),
 u as (select run_id, lang as pattern, count(*) as n, min(doc_id) as o from m where method = 'RENDERED_PAGE' group by 1, 2), b as (select *, row_number() over (partition by run_id order by n desc, o) as r from u)
select m.run_id, count(*) filter (method = 'LIST_SUFFICIENT') as list_sufficient, count(*) filter (method = 'AUTO_API') as auto_api, count(*) filter (method = 'RENDERED_PAGE') as rendered_page, count(*) filter (method = 'LIST_ONLY') as list_only, any_value(b.pattern) as detail_url_pattern
 from m left join b on b.run_id = m.run_id and b.r = 1 group by 1""")
def detail_methods(t):
    """Method mix per run and the most common detail pattern."""
    df = _targets(t).select(F.col("source").alias("run_id"), "doc_id", "method", F.col("lang").alias("pattern"))
    return M.detail_resolution(df, "run_id", "method", "pattern", "doc_id")


@query("G29", """select user_id as run_id, count(*) filter (event_type = 'view') as not_requested, count(*) filter (event_type = 'click') as pending, count(*) filter (event_type = 'purchase') as complete, 0::bigint as verification_required,
 count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'signup') as unknown from events group by 1""")
def enrichment_states(t):
    """Jobs per enrichment state."""
    state = F.expr("case event_type when 'view' then 'NOT_REQUESTED' when 'click' then 'PENDING' when 'purchase' then 'COMPLETE' when 'error' then 'FAILED' end")
    return M.enrichment_counts(t.events.select(F.col("user_id").alias("run_id"), state.alias("state")), "run_id", "state")


@query("G31", f"""with {JOBS} select run_id, doc_id::varchar as job_id, title as job_title, issue_type, case issue_type when 'SOURCE_MISSING_JD' then 'No full JD was available from the collected official source.' when 'EXCEL_CELL_TRUNCATED' then 'Excel cell truncated; jobs.json retains the full value.'
  else 'Full JD preserved; structured ' || concat_ws(', ', case when not resp then 'responsibilities' end, case when not req then 'requirements' end) || ' unavailable.' end as description, 'u' as detail_url
 from jobs, unnest([case when coalesce(full_jd, '') = '' then 'SOURCE_MISSING_JD' when not (resp and req) then 'STRUCTURED_FIELDS_UNAVAILABLE' end, case when length(full_jd) > 32767 then 'EXCEL_CELL_TRUNCATED' end]) as u(issue_type) where issue_type is not null
 union all select user_id::varchar, null, null, 'COLLECTION ERROR', 'E ' || event_id, null from events where event_type = 'error'""")
def quality_issues(t):
    """Issue rows per job, and the error lines of every run."""
    jobs = _jobs(t).withColumns({"url": F.lit("u"), "id": F.col("doc_id").cast("string")})
    errors = t.events.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("run_id"), F.concat(F.lit("E "), "event_id").alias("line"))
    return M.quality_issues(jobs, "run_id", "id", "title", "url").unionByName(M.run_issues(errors, "run_id", "line", "COLLECTION ERROR"))


_CELL = "case lang when 'en' then '=' || text when 'fr' then chr(7) || text || chr(13) || chr(10) || 'x' when 'de' then repeat(text || ' ', 40) else text end"


@query("G32", f"""with x as (select source as run_id, {_CELL} as s from documents), b as (select run_id, s, regexp_replace(regexp_replace(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\r\\n?', chr(10), 'g') as body from x)
select run_id, count(*) filter (body <> s or length(body) > 32767 or regexp_matches(body, '^[=+@-]')) as cells_sanitized, sum(len(regexp_extract_all(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')))::bigint as illegal_chars_removed,
 count(*) filter (length(body) > 32767) as cells_truncated, count(*) filter (regexp_matches(body, '^[=+@-]')) as formula_escaped from b group by run_id""")
def sanitation_stats(t):
    """Cells an export has to change, by kind."""
    cell = F.expr("case lang when 'en' then concat('=', text) when 'fr' then concat(chr(7), text, chr(13), chr(10), 'x') when 'de' then repeat(concat(text, ' '), 40) else text end")
    return M.sanitize_stats(I.spread(t.documents, "doc_id").select(F.col("source").alias("run_id"), cell.alias("cell")), "run_id", "cell")


_SITES = """sites as (select event_id as site, value as seconds, case when event_id % 11 = 0 then 'dns down' when event_id % 13 = 0 then 'TargetClosed in browser' when event_id % 17 = 0 then 'page loop' else '' end as reason,
 case event_type when 'view' then 'COMPLETE' when 'click' then 'COMPLETE' when 'error' then 'INCOMPLETE' when 'signup' then 'NOT_STARTED' end as status, event_id % 5 <> 0 as source_found, event_id % 3 <> 0 as executable, event_id % 29 = 0 as false_complete,
 event_id % 90 as unique_jobs, 60::bigint as reported_total, event_id % 90 as jd_complete, case when event_id % 4 = 0 then 0 else 3 end as jd_incomplete, event_id % 2 = 0 as exported, user_id from events)"""
_CLASS = """classed as (select *, case when coalesce(status = 'COMPLETE', false) and false_complete then 'IDENTITY_FAILURE' when reason = 'dns down' then 'ENVIRONMENT_NETWORK' when reason like 'Target%' then 'ENVIRONMENT_BROWSER' when not source_found then 'SOURCE_DISCOVERY_FAILURE' when not executable then 'PLAN_NOT_EXECUTABLE'
 when status is distinct from 'COMPLETE' and reason = 'page loop' then 'PAGINATION_FAILURE' when status is distinct from 'COMPLETE' and unique_jobs < reported_total then 'TOTAL_MISMATCH' when status is distinct from 'COMPLETE' then 'PARTIAL_COLLECTION' when jd_incomplete > 0 then 'JD_COMPLETENESS_FAILURE' when not exported then 'EXPORT_FAILURE' else 'SUCCESS' end as failure_class from sites)"""


def _sites(t):
    df = t.events.selectExpr("event_id as site", "value as seconds", "case when event_id % 11 = 0 then 'dns down' when event_id % 13 = 0 then 'TargetClosed in browser' when event_id % 17 = 0 then 'page loop' else '' end as reason",
                             "case event_type when 'view' then 'COMPLETE' when 'click' then 'COMPLETE' when 'error' then 'INCOMPLETE' when 'signup' then 'NOT_STARTED' else 'UNSET' end as s0", "event_id % 5 <> 0 as source_found", "event_id % 3 <> 0 as executable",
                             "event_id % 29 = 0 as false_complete", "event_id % 90 as unique_jobs", "60L as reported_total", "event_id % 90 as jd_complete", "case when event_id % 4 = 0 then 0 else 3 end as jd_incomplete", "event_id % 2 = 0 as exported", "user_id")
    df = df.withColumn("status", F.nullif("s0", F.lit("UNSET")))
    view = df.withColumn("st", F.coalesce("status", F.lit("")))
    return view.withColumn("failure_class", M.failure_class(lambda k: F.col("st" if k == "status" else k)))


@query("G34", f"with {_SITES}, {_CLASS} select failure_class, count(*) as sites from classed group by 1")
def failure_classes(t):
    """Sites per failure class."""
    return _sites(t).groupBy("failure_class").agg(F.count("*").alias("sites"))


@query("G34", f"""with {_SITES}, {_CLASS}, m as (select round(avg(source_found::int), 4) as source_found_rate, round(avg(executable::int), 4) as executable_plan_rate, round(avg((status is not null and status <> 'NOT_STARTED')::int), 4) as collection_started_rate,
 round(avg((coalesce(status = 'COMPLETE', false) and not false_complete)::int), 4) as full_collection_rate, round(sum(jd_complete) / sum(jd_complete + jd_incomplete), 4) as jd_complete_rate, round(avg(exported::int), 4) as excel_success_rate, round(avg((failure_class = 'SUCCESS')::int), 4) as e2e_success_rate from classed),
 l as (unpivot m on columns(*) into name metric value value) select metric, value, 0.2::double as before, round(value - 0.2, 4) as absolute_change, round((value - 0.2) * 100, 2) as point_change from l""")
def benchmark_scorecard(t):
    """Rates over all sites and their change."""
    rows = _sites(t)
    before = t.region.sparkSession.createDataFrame([(m, 0.2) for m in ("source_found_rate", "executable_plan_rate", "collection_started_rate", "full_collection_rate", "jd_complete_rate", "excel_success_rate", "e2e_success_rate")], "metric string, before double")
    return M.scorecard(rows, before)


@query("G34", f"""with {_SITES} select user_id, round(avg(seconds), 3) as avg_seconds, round(median(seconds), 3) as median_seconds, max(seconds) as max_seconds, arg_max(site, struct_pack(s := seconds, o := -site)) as slowest from sites group by 1""")
def elapsed_statistics(t):
    """Time per group of sites, with the slowest."""
    return M.elapsed_stats(_sites(t), "user_id", "seconds", "site")


@query("G35", """with k as (select user_id, value, event_type, case when event_type in ('view', 'click') then 'list' else 'detail' end as kind from events)
select user_id, count(*) filter (kind = 'list') as list_requests, count(*) filter (kind = 'detail') as detail_requests, round(coalesce(sum(value) filter (kind = 'list'), 0), 3) as list_request_seconds, round(coalesce(sum(value) filter (kind = 'detail'), 0), 3) as detail_request_seconds,
 round(coalesce(avg(value) filter (kind = 'list'), 0), 4) as average_list_request_seconds, round(coalesce(avg(value) filter (kind = 'detail'), 0), 4) as average_detail_request_seconds, count(*) filter (event_type = 'error') as retry_count, round(coalesce(sum(value / 10) filter (event_type = 'error'), 0), 3) as retry_sleep_seconds from k group by 1""")
def latency_metrics(t):
    """Request counts, times and retries per run."""
    df = t.events.select("user_id", "value", F.when(F.col("event_type").isin("view", "click"), "list").otherwise("detail").alias("kind"), (F.col("event_type") == "error").alias("retry"), (F.col("value") / 10).alias("sleep"))
    return M.latency_metrics(df, "user_id", "kind", "value", "retry", "sleep")


@query("G37", """with r as (select o_custkey as run_id, count(*) * 3 as total, o_custkey % 4 as lim, count(*) as succeeded, count(*) filter (o_orderkey % 40 = 0) as failed from orders group by 1)
select run_id, ceil(total / case when lim = 0 then total else lim end)::bigint as expected_pages, failed = 0 and succeeded = ceil(total / case when lim = 0 then total else lim end) as all_steps_succeeded from r""")
def page_coverage(t):
    """Pages a run needed and whether each step succeeded."""
    r = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg((F.count("*") * 3).alias("total"), F.count("*").alias("succeeded"), F.count_if(F.col("o_orderkey") % 40 == 0).alias("failed"))
    r = r.withColumns({"lim": F.col("run_id") % 4, "stagnant": F.lit(0)})
    return M.page_coverage(r, "total", "lim", "succeeded", "failed", "stagnant").select("run_id", "expected_pages", "all_steps_succeeded")


@query("G40", """select user_id as run_id, coalesce(nullif(event_type, 'error'), 'missing') as category, count(*) as n from events group by 1, 2""")
def category_distribution(t):
    """Records per category of a run."""
    return M.category_distribution(t.events.withColumn("cat", F.nullif("event_type", F.lit("error"))).withColumnRenamed("user_id", "run_id"), "run_id", "cat")


@query("G41", f"""with {JOBS}, r as (select run_id, count(*) as total_jobs, count(*) filter (coalesce(full_jd, '') <> '') as jd_complete, count(*) + count(*) filter (lang = 'de') as raw_rows, case when count(*) % 2 = 0 then count(*) end as total from jobs group by run_id)
select run_id, case when total_jobs > 0 then 'COMPLETE' else 'FAILED' end as status, case when total_jobs > 0 and jd_complete = total_jobs then 'LIST_SUFFICIENT' when jd_complete > 0 then 'MIXED' else 'LIST_ONLY' end as jd_strategy,
 case when raw_rows > total_jobs then 'SOURCE_CROSS_PAGE_DUPLICATES raw_total=' || coalesce(total::varchar, 'None') || ' duplicate_records=' || (raw_rows - total_jobs) end as warning from r""")
def run_verdicts(t):
    """Status, description strategy and duplicate warning of each run."""
    r = _jobs(t).groupBy("run_id").agg(F.count("*").alias("total_jobs"), F.count_if(F.coalesce("full_jd", F.lit("")) != "").alias("jd_complete"),
                                       (F.count("*") + F.count_if(F.col("jd_state").isNull())).alias("raw_rows"), F.when(F.count("*") % 2 == 0, F.count("*")).alias("total"))
    return M.run_verdict(r).select("run_id", "status", "jd_strategy", "warning")
