"""Queries that join lists, details, cards, links and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import company as C, export as E, jd as J, urls as U
from ..operators import filters as L, joins as A, planning as P
from . import inputs as I, sql as S
from .registry import query


@query("A-J1", f"""with {I.POSTINGS}, l as (select doc_id, title as description, case lang when 'es' then '' when 'de' then null else lang end as department, source as education from postings),
 d as (select doc_id, case when quality = 1 then text else 'short' end as description, 'Q' || quality as department, '' as education from labels join documents using (doc_id))
select l.doc_id, sha256(case when l.description = '' then coalesce(d.description, '') when d.doc_id is not null and {S.credible_jd('d.description')} and not {S.credible_jd('l.description')} then d.description else l.description end) as jd_hash,
 case when coalesce(l.department, '') = '' then coalesce(d.department, l.department) else l.department end as department, l.education, case when d.doc_id is not null then 'DETAIL_API' end as detail_source from l left join d using (doc_id)""")
def merged_details(t):
    """Details merged into list rows, enrichment only."""
    lst = I.postings(t).select("doc_id", F.col("title").alias("description"), F.expr("case lang when 'es' then '' when 'de' then null else lang end").alias("department"), F.col("source").alias("education"))
    det = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("text")).otherwise("short").alias("description"), F.concat(F.lit("Q"), "quality").alias("department"), F.lit("").alias("education"))
    out = A.merge_detail(lst, det, "doc_id", ["description", "department", "education"])
    return out.select("doc_id", F.sha2(F.coalesce("description", F.lit("")), 256).alias("jd_hash"), "department", "education", "detail_source")


@query("A-J2", """with d as (select l_orderkey, min(l_returnflag) as flag from lineitem where l_linenumber = 1 group by l_orderkey)
select o_orderkey, case when d.l_orderkey is not null then nullif(flag, 'R') else o_orderstatus end as status, o_orderpriority from orders left join d on l_orderkey = o_orderkey""")
def overlaid_details(t):
    """First detail line laid over each order; its nulls win."""
    det = t.lineitem.filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("f"))
    det = det.select("o_orderkey", F.nullif("f", F.lit("R")).alias("status"))
    lst = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return A.overlay_detail(lst, det, "o_orderkey", ["status"])


@query("A-J3", f"""with {I.POSTINGS} select doc_id, case when quality = 0 then 'ID_MISMATCH' when lang = 'de' and {S.no_space('title')} <> '' and not (contains(lower({S.no_space("'other ' || source")}), lower({S.no_space('title')})) or contains(lower({S.no_space('title')}), lower({S.no_space("'other ' || source")}))) then 'TITLE_MISMATCH' end as binding from postings join labels using (doc_id)""")
def detail_bindings(t):
    """Does the joined detail belong to the job?"""
    df = I.postings(t).join(t.labels, "doc_id")
    other = F.when(F.col("lang") == "de", F.concat(F.lit("other "), "source")).otherwise(F.upper("title"))
    return df.select("doc_id", A.binding("doc_id", "title", F.when(F.col("quality") == 0, -1).otherwise(F.col("doc_id")), other).alias("binding"))


_JOBS = f"""{I.POSTINGS}, j as (select source as run_id, doc_id, case when lang in ('en', 'fr') then body when lang = 'de' then null else 'teaser' end as full_jd, quality, toxic, text from postings left join labels using (doc_id)),
 s as (select *, coalesce({S.credible_body('full_jd')}, false) as done, case when quality = 1 and toxic = 0 then 'SUCCESS' when quality = 0 then 'FAILED' when toxic = 1 then 'SKIPPED' end as outcome from j),
 p as (select *, case when done then 'PREEXISTING' when outcome = 'SUCCESS' then 'SUCCESS' when outcome = 'SKIPPED' then 'SKIPPED' when outcome is not null then 'FAILED' else 'PENDING' end as phase from s),
 q as (select *, not coalesce({S.credible_body("case when phase = 'SUCCESS' then 'Responsibilities Requirements ' || text else full_jd end")}, false) as missing from p)"""


def _resumed(t):
    jobs = I.postings(t).select(F.col("source").alias("run_id"), "doc_id", F.expr("case when lang in ('en', 'fr') then body when lang = 'de' then null else 'teaser' end").alias("full_jd"))
    done = t.labels.join(t.documents.select("doc_id", F.col("source").alias("run_id"), "text"), "doc_id")
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUCCESS").when(F.col("quality") == 0, "FAILED").when(F.col("toxic") == 1, "SKIPPED")
    new = done.select("run_id", "doc_id", F.when(outcome == "SUCCESS", F.concat(F.lit("Responsibilities Requirements "), "text")).alias("new_jd"), outcome.alias("outcome"))
    return A.resume(jobs, new, "run_id", "doc_id")


@query("A-J4", f"with {_JOBS} select run_id, doc_id, phase, case when missing then phase end as state from q")
def resumed_jobs(t):
    """Jobs after a resumed detail pass, with the state of those still open."""
    return _resumed(t).select("run_id", "doc_id", "phase", "state")


@query("A-J4", f"""with {_JOBS} select run_id, count(*) filter (phase = 'PREEXISTING') as preexisting, count(*) filter (phase <> 'PREEXISTING') as requested, count(*) filter (phase = 'SUCCESS') as new_success,
 count(*) filter (phase = 'FAILED') as failed, count(*) filter (phase in ('SKIPPED', 'PENDING')) as skipped, count(*) filter (missing) as still_missing from q group by run_id""")
def resume_statistics(t):
    """Counts of a resumed pass per run."""
    return A.resume_stats(_resumed(t), "run_id")


_REC = f"case when lang in ('en', 'de') then 'J' || doc_id else 'zz' || doc_id end"


@query("A-J5 W10", f"""with {I.POSTINGS}, r as (select doc_id, {_REC} as rid, title, count(*) over (partition by title) as uses from postings), c as (select doc_id as card, text, case when lang = 'en' then '/jobs/J' || doc_id || '?x=1' when lang = 'de' then 'J' || doc_id else '' end as blob from documents),
 i as (select r.doc_id, count(*) as n, min(card) as card from r join c on regexp_matches(blob, '(^|[^A-Za-z0-9])' || rid || '([^A-Za-z0-9]|$)') group by r.doc_id),
 o as (select r.doc_id, r.title from r left join i using (doc_id) where i.n is null and title <> '' and uses = 1), b as (select o.doc_id, count(*) as n, min(card) as card from o join c on contains(c.text, o.title) group by o.doc_id)
select r.doc_id, coalesce(i.n, b.n, 0) as candidates, case when coalesce(i.n, b.n) = 1 then coalesce(i.card, b.card) end as card, case when coalesce(i.n, b.n, 0) = 1 then 'SUCCESS' when coalesce(i.n, b.n, 0) > 1 then 'AMBIGUOUS' else 'FAILED' end as outcome
 from r left join i using (doc_id) left join b using (doc_id)""")
def bound_cards(t):
    """Records bound to rendered cards by id token, else by unique title."""
    p = I.postings(t)
    records = p.select("doc_id", F.expr("case when lang in ('en', 'de') then concat('J', doc_id) else concat('zz', doc_id) end").alias("rid"), "title")
    cards = I.spread(t.documents, "doc_id").select(F.col("doc_id").alias("card_key"), "text", F.expr("case when lang = 'en' then concat('/jobs/J', doc_id, '?x=1') when lang = 'de' then concat('J', doc_id) else '' end").alias("blob"))
    return A.bind_cards(records, cards, "rid", "title", "card_key", "text", F.col("blob")).select("doc_id", "candidates", "card", "outcome")


@query("A-J6", f"""with {I.PAGES} select page_id, case when page_id % 2 = 0 then {S.scheme('url')} || '://' || split_part(url, '/', 3) || '/jobs/' || page_id || '001' end as detail_url from captured""")
def bound_links(t):
    """Records bound to the one visible link that carries their id and title."""
    from .link_queries import links

    records = t.pages.select("page_id", F.concat("page_id", F.lit("001")).alias("rid"),
                             F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" engineer & lead "), "page_id")).otherwise("elsewhere").alias("title"))
    ls = links(t).select(F.col("resolved").alias("url"), "label")
    return A.bind_links(records, ls, "rid", "title", "url", "label").select("page_id", "detail_url")


@query("A-J7", f"""with {I.EXCHANGES} select entry_index, case lang when 'en' then 'code' when 'es' then 'positionId' end as id_field, case lang when 'en' then 'result.list' when 'es' then '$' end as list_path from exchanges where lang in ('en', 'es')""")
def aligned_exchanges(t):
    """Exchanges given the field contract of their source."""
    df = I.exchanges(t).select("entry_index", U.path("url").alias("path"), F.lit("GET").alias("method"))
    specs = df.select("path", "method").distinct().filter(F.col("path").contains("api/job") | F.col("path").contains("api/search")).select(
        "path", "method", F.when(F.col("path").contains("job"), "code").otherwise("positionId").alias("id_field"), F.when(F.col("path").contains("job"), "result.list").otherwise("$").alias("list_path"))
    return P.apply_spec(df, specs, ["path", "method"]).select("entry_index", "id_field", "list_path")


@query("A-J8", """select n_nationkey, n_name, r_name as label from nation left join region on r_regionkey = n_regionkey and r_name <> 'REGION_0'""")
def looked_up_labels(t):
    """Codes to labels through a lookup table."""
    table = t.region.filter("r_name <> 'REGION_0'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("label"))
    return A.lookup(t.nation, table, "n_regionkey").select("n_nationkey", "n_name", "label")


_ERR = "case event_type when 'view' then 'HTTP_' || (400 + event_id % 5) || ' url=x' when 'click' then 'READ_TIMEOUT: slow' when 'error' then 'HTTP_50' || (event_id % 5) when 'signup' then 'X_NOT_FOUND reason=a' else 'WEIRD thing' end"


@query("A-J8", f"""with e as (select event_id, {_ERR} as err from events), c as (select event_id, err, upper(split_part(split_part(err, ' ', 1), ':', 1)) as code from e)
select event_id, case {' '.join(f"when code = {S.q(k)} then {S.q(v)}" for k, v in V.ERROR_REASONS.items())} when contains(code, 'TIMEOUT') then '{V.ERROR_REASONS['TIMEOUT']}'
 when contains(code, 'HTTP_5') then '{V.ERROR_REASONS['HTTP_5XX']}' when starts_with(code, 'HTTP_') then err when contains(code, 'NOT_FOUND') then '{V.ERROR_REASONS['DETAIL_NOT_FOUND']}' else err end as reason from c""")
def translated_errors(t):
    """Error codes in readable words; unknown codes show themselves."""
    err = F.expr("case event_type when 'view' then concat('HTTP_', 400 + event_id % 5, ' url=x') when 'click' then 'READ_TIMEOUT: slow' when 'error' then concat('HTTP_50', event_id % 5) when 'signup' then 'X_NOT_FOUND reason=a' else 'WEIRD thing' end")
    return t.events.select("event_id", E.translate_reason(err).alias("reason"))


@query("A-J9", f"""with {I.URLS} select page_id, v, case when contains(lower(n), 'byd') or contains(h, 'byd') then '比亚迪' when contains(lower(n), 'zte') then '中兴' when n <> '' and not contains(n, '.') then replace(n, '/', '_') else '_unknown' end as folder
 from (select *, {S.host('url')} as h, case v % 4 when 0 then 'My ZTE' when 1 then 'a/b' when 2 then 'x.com' else '' end as n from urls)""")
def formal_companies(t):
    """Folder name of a run by verified brand token, else by its own plain name."""
    name = F.expr("case v % 4 when 0 then 'My ZTE' when 1 then 'a/b' when 2 then 'x.com' else '' end")
    return I.urls(t).select("page_id", "v", C.formal_company(name, "url").alias("folder"))


@query("A-J10", """with d as (select distinct o_custkey as contract, o_orderpriority as identity from orders where o_orderstatus <> 'P'), f as (select o_custkey as contract, o_orderpriority as identity, min(o_orderkey) as first_seen from orders where o_orderstatus <> 'P' group by all),
 n as (select contract, count(*) as scopes from d group by contract having count(*) > 1) select contract, identity, first_seen, scopes from f join n using (contract)""")
def scope_siblings(t):
    """Scopes that share one collection contract, one row per identity."""
    df = t.orders.select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("first_seen"),
                         F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("").alias("identity"))
    return P.compatible_scopes(df, "contract", "identity", "first_seen")


@query("F17 G40", """with c as (select o_orderpriority as run_id, coalesce(nullif(o_orderstatus, 'P'), 'missing') as category, count(*) as n from orders group by all)
select run_id, category, n from c where not (category = 'F' or (category = 'O' and run_id >= '3'))""")
def scope_leaks(t):
    """Categories a run collected outside its requested scope."""
    df = t.orders.select(F.col("o_orderpriority").alias("run_id"), F.nullif("o_orderstatus", F.lit("P")).alias("category"))
    scopes = t.orders.select(F.col("o_orderpriority").alias("run_id")).distinct().select(
        "run_id", F.explode(F.when(F.col("run_id") >= "3", F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F")))).alias("category"))
    return L.scope_leaks(df, scopes, "run_id", "category")


@query("U4", """with a as (select o_custkey as k, count(*) as n from orders group by 1), b as (select c_custkey as k, 1 as n from customer where c_acctbal > 0)
select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as left_rows, coalesce(b.n, 0)::bigint as right_rows, case when a.k is null then 'EXTRA' when b.k is null then 'MISSING' else 'PARITY' end as state from a full join b on a.k = b.k""")
def list_link_parity(t):
    """Keys found on one side only, with counts."""
    return A.parity(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("U1", """select 'orders' as origin, o_orderstatus as scope, count(*) as records, count(p) as priced from (select o_orderstatus, o_totalprice as p from orders union all select l_linestatus, null from lineitem) group by 2
 union all select 'all', 'all', (select count(*) from orders) + (select count(*) from lineitem), (select count(*) from orders)""")
def united_records(t):
    """Record sets of several scopes united, copies kept, missing columns null."""
    a = t.orders.select(F.col("o_orderstatus").alias("scope"), F.col("o_totalprice").alias("price"))
    b = t.lineitem.select(F.col("l_linestatus").alias("scope"))
    rows = A.union_records(a, b)
    per = rows.groupBy("scope").agg(F.count("*").alias("records"), F.count("price").alias("priced")).select(F.lit("orders").alias("origin"), "scope", "records", "priced")
    return per.unionAll(rows.agg(F.count("*").alias("records"), F.count("price").alias("priced")).select(F.lit("all").alias("origin"), F.lit("all").alias("scope"), "records", "priced"))


@query("U2", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def unseen_keys(t):
    """Keys of one snapshot the other has not seen."""
    return A.new_keys(t.customer, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")
