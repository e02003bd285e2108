"""End-to-end queries: captured pages to audited jobs, captured responses to job rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import company as C, jd as J, records as R, urls as U
from ..operators import discovery as D, identity as ID, pages as P, windows as W
from . import inputs as I, sql as S
from .link_queries import LINKS, _REASON, links
from .registry import query


@query("T4 F14 T14 T11 T9 W2 G6", f"""with {LINKS}, r as (select *, {_REASON} as reason from links), a as (select page_id, pos, label, resolved, page_id * 1000 + pos as row_id from r where reason is null),
 i as (select *, {S.scheme('resolved')} || '://' || {S.host('resolved')} as site, case when regexp_matches({S.path('resolved')}, '(?i)/(jobs|position)/[A-Za-z0-9-]*\\d[A-Za-z0-9-]*') then regexp_extract({S.path('resolved')}, '(?i)/(?:jobs|position)/([A-Za-z0-9-]+)', 1) end as idv from a),
 k as (select coalesce(case when {S.host('resolved')} like '%.example.%' or {S.host('resolved')} like 'example.%' then null end, 'unknown') as company, coalesce(idv, 'none') as identity_value, resolved, label, row_id from i),
 g as (select company, identity_value, count(*) as n, count(distinct label) as titles, count(distinct resolved || label) as prints from k group by 1, 2)
select company, sum(n)::bigint as links, count(*) as jobs, count(*) filter (n > 1) as duplicate_ids, sum(case when n > 1 and (prints = 1 or titles = 1) then n - 1 else 0 end)::bigint as collapsed, sum(case when n > 1 and not (prints = 1 or titles = 1) then n - 1 else 0 end)::bigint as unexplained from g group by 1""")
def page_job_audit(t):
    """Pages to links to job identities to a duplicate audit, per employer.

    Links are cut and judged where the page lies; one shuffle by identity follows, of narrow rows that each
    task has already reduced."""
    kept = P.filter_detail_links(links(t), "page_id", "source_url").filter("reason is null")
    jobs = ID.job_identity(kept, url="resolved", title="label").select(
        F.coalesce(C.infer_site_company("resolved"), F.lit("unknown")).alias("company"), "identity_source", "identity_value",
        "resolved", F.col("label").alias("title"), F.xxhash64("resolved", "label").alias("fp"))
    one = lambda x: F.min(x) == F.max(x)
    groups = jobs.groupBy("company", "identity_value").agg(F.count("*").alias("n"), (one("fp") | one("title")).alias("explained"))
    extra = F.col("n") - 1
    return groups.groupBy("company").agg(
        F.sum("n").alias("links"), F.count("*").alias("jobs"), F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.sum(F.when(F.col("explained"), extra).otherwise(0)).alias("collapsed"), F.sum(F.when(F.col("explained"), 0).otherwise(extra)).alias("unexplained"))


@query("G15 W1 W2 P8 J1 J2 G3", f"""with {I.EXCHANGES}, s as (select * from exchanges where lang in ('en', 'es')), l as (select run_id, entry_index, lang, i - 1 as pos, {I.LINES}[i] as line from s, unnest(range(1, n + 1)) as r(i)),
 j as (select *, case when lang = 'en' then entry_index || '-' || pos else pos::varchar end as job_id, case lang when 'en' then line[1:40] else line[1:20] end as title from l), d as (select *, row_number() over (partition by run_id, job_id order by entry_index, pos) as r from j where title <> '')
select run_id, count(*) as raw_rows, count(*) filter (r = 1) as jobs, count(*) filter (r = 1 and lang = 'es' and {S.credible_body('line')}) as full_texts from d group by 1""")
def captured_jobs(t):
    """Captured responses to jobs per run: score, keep credible sources, explode, first id wins, read the text."""
    df = D.score_exchanges(I.exchanges(t), "url", "payload", items="records").filter("confidence = 'HIGH' and size(reasons) = 0")
    rows = df.select("run_id", "entry_index", "id_field", "title_field", F.posexplode("records").alias("pos", "raw")).withColumn("rec", R.as_record("raw"))
    jobs = rows.select("run_id", "entry_index", "pos", R.as_text(F.try_element_at("rec", F.col("id_field"))).alias("job_id"),
                       R.as_text(F.try_element_at("rec", F.col("title_field"))).alias("title"), J.pick_jd("rec").alias("jd"))
    jobs = jobs.filter("job_id is not null and title <> ''").select("run_id", "entry_index", "pos", "job_id", (F.col("jd.state") == "FULL_TEXT").alias("full"))
    counts = jobs.groupBy("run_id", "job_id").agg(F.count("*").alias("n"), F.min_by("full", F.struct("entry_index", "pos")).alias("full"))
    return counts.groupBy("run_id").agg(F.sum("n").alias("raw_rows"), F.count("*").alias("jobs"), F.count_if("full").alias("full_texts"))
