"""Queries over links of captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import jd as J, score as K, text as T, urls as U
from ..operators import filters as L, navigation as N, pages as P
from ..operators.grouping import top_k
from . import inputs as I, sql as S
from .registry import query


def links(t):
    """Anchors of the captured pages."""
    return P.extract_links(I.pages(t).withColumnRenamed("url", "source_url"), "html", "source_url")


_A = r"(?is)<a\b([^>]*?\bhref\s*=\s*\"([^\"]*)\"[^>]*)>(.*?)</a>"
_UN = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
LINKS = f"""{I.PAGES}, raw as (select page_id, url as source_url, regexp_extract_all(html, '{_A}', 1) as a1, regexp_extract_all(html, '{_A}', 2) as a2,
 regexp_extract_all(html, '{_A}', 3) as a3 from captured),
 links as (select page_id, source_url, i - 1 as pos, {_UN('a2[i]')} as href, {S.squeeze(_UN("regexp_replace(a3[i], '<[^>]+>', '', 'g')"))} as label, a1[i] as attributes,
  case when a2[i] = '' then source_url when regexp_matches(a2[i], '^[A-Za-z][A-Za-z0-9+.-]*:') then {_UN('a2[i]')} when starts_with(a2[i], '/') then {S.scheme('source_url')} || '://' || {S.netloc('source_url')} || {_UN('a2[i]')}
   when starts_with(a2[i], '#') then regexp_replace(source_url, '#.*$', '') || a2[i]
   else {S.scheme('source_url')} || '://' || {S.netloc('source_url')} || regexp_replace({S.path('source_url')}, '[^/]*$', '') || {_UN('a2[i]')} end as resolved from raw, unnest(range(1, len(a1) + 1)) as r(i))"""


@query("T4", f"with {LINKS} select page_id, pos::integer as pos, href, label, resolved from links")
def page_links(t):
    """Every anchor of every page with its resolved address."""
    return links(t).select("page_id", "pos", "href", "label", "resolved")


_PAGE = lambda x: f"({S.scheme(x)} || '://' || {S.netloc(x)} || regexp_replace({S.path(x)}, '/+$', ''))"
_REASON = f"""case when {S.strip('href')} = '' or (starts_with({S.strip('href')}, '#') and not regexp_matches(href, '{V.LINK_JOB_FRAGMENT}')) or ({_PAGE('resolved')} = {_PAGE('source_url')} and not regexp_matches(href, '{V.LINK_JOB_FRAGMENT}')) then 'SAME_PAGE_OR_FRAGMENT'
 when {S.scheme('resolved')} <> 'https' then 'NON_HTTPS_LINK' when {S.any_of(f"lower({S.path('resolved')} || ' ' || label)", V.LINK_NON_JOB)} then 'NON_JOB_CONTENT'
 when regexp_matches({S.path('resolved')}, '{V.LINK_SEARCH_PATH}') or (contains(lower({S.path('resolved')}), 'search') and not regexp_matches({S.path('resolved')}, '\\d{{3,}}')) then 'SEARCH_OR_LIST_PAGE'
 when not regexp_matches(href, '{V.LINK_JOB_FRAGMENT}') and regexp_matches({S.path('resolved')}, '{V.LINK_LANDING_PATH}') then 'LANDING_OR_LOCALE_PAGE'
 when not regexp_matches({S.path('resolved')}, '{V.LINK_IDENTITY_PATH}') and not regexp_matches(href, '{V.LINK_JOB_FRAGMENT}') then 'LOW_DETAIL_LINK_EVIDENCE' end"""


@query("F14 F22 K5", f"""with {LINKS}, r as (select *, {_REASON} as reason from links), d as (select *, row_number() over (partition by page_id, resolved, reason order by pos) as rn from r)
select page_id, pos::integer as pos, resolved, reason, regexp_matches(label, '{V.PAGINATION_CONTROL}') as is_control from d where rn = 1""")
def detail_links(t):
    """Links split into job details and six kinds of rejects, each address once per page."""
    df = P.filter_detail_links(links(t), "page_id", "source_url")
    first = P.distinct_links(df, ["page_id", "resolved", "reason"])
    return first.select("page_id", "pos", "resolved", "reason", L.is_pagination_control("label").alias("is_control"))


@query("G24", f"""with {LINKS} select page_id, {S.host('resolved')} as host, count(*) as n from links where {S.scheme('resolved')} = 'https' and {S.host('resolved')} not in ('', {S.host('source_url')}) group by 1, 2 having count(*) >= 2""")
def related_hosts(t):
    """Foreign hosts a page points to repeatedly."""
    return P.related_hosts(links(t).withColumn("source_host", U.host("source_url")), "page_id", "source_host")


@query("G25", f"""with {LINKS}, u as (select page_id, coalesce(nullif(regexp_extract(attributes, 'class="([^"]*)"', 1), ''), '-') as signature, resolved, min(pos) as first_pos from links
 where {S.scheme('resolved')} in ('http', 'https') and {S.netloc('resolved')} <> '' and length(label) between 2 and 240 and not {S.any_of(f"lower({S.path('resolved')} || ' ' || label)", V.CARD_CONTROL_WORDS)} group by 1, 2, 3),
 s as (select page_id, signature, count(*) as cards, count(*) filter (regexp_matches(resolved, '{V.CARD_JOB_PATH}')) as job_paths, min(first_pos) as fp from u group by 1, 2),
 b as (select *, row_number() over (partition by page_id order by job_paths desc, cards desc, fp) as r from s where cards >= 2 and job_paths * 5 >= cards * 3)
select page_id, signature, cards, job_paths from b where r = 1""")
def repeated_cards(t):
    """The link group of a page that looks most like a job list."""
    df = links(t).withColumn("signature", F.coalesce(F.nullif(F.regexp_extract("attributes", 'class="([^"]*)"', 1), F.lit("")), F.lit("-")))
    return P.card_groups(df, "page_id", "signature").select("page_id", "signature", "cards", "job_paths")


_KIND = lambda x: "case " + " ".join(f"when {S.any_of(x, [w.lower() for w in terms])} then {S.q(k)}" for k, terms in V.ENTRY_TERMS.items()) + " end"


@query("T28 T21", f"""with {LINKS}, e as (select *, lower(label || ' ' || resolved) as low from links), k as (select *, {_KIND('low')} as entry_type from e where label <> ''),
 d as (select *, row_number() over (partition by page_id, resolved order by pos) as rn from k where entry_type is not null and not {S.any_of('low', V.ENTRY_NEGATIVE)} and {S.scheme('resolved')} = 'https')
select page_id, pos::integer as pos, entry_type, resolved, split_part(resolved, '/', 3) as destination_host from d where rn = 1""")
def recruitment_entries(t):
    """Visible recruitment entries of a page."""
    return P.recruitment_entries(links(t), "page_id").select("page_id", "pos", "entry_type", "resolved", U.host("resolved").alias("destination_host"))


@query("T20 T21 K1", f"""with {LINKS}, s as (select page_id, pos, label, resolved, source_url, lower(label || ' ' || resolved) as low, lower(label) as ll,
  lower({S.path('resolved')}) as route from links),
 w as (select *, {S.hits('low', [x.lower() for x in V.ENTRY_SCORE_POSITIVE])} * 3 - {S.hits('low', [x.lower() for x in V.ENTRY_SCORE_NEGATIVE])} * 4 as entry_score,
  {S.hits('low', [x.lower() for x in V.ACTION_POSITIVE])} * 6 - {S.hits('low', [x.lower() for x in V.ACTION_NEGATIVE])} * 8 + case when {S.any_of('low', ['校园', 'campus'])} then 8 else 0 end as action_score,
  {S.hits('low', V.JOB_SEARCH_POSITIVE)} * 4 as search_score,
  case when {S.any_of('ll', V.ROUTE_STRONG)} then 6 when {S.any_of('ll', V.ROUTE_SCOPE)} then 4 when {S.any_of('ll', V.ROUTE_BARE)} then 2 else 0 end
  + case when regexp_matches(route, '\\bjobs?\\b|\\bpositions?\\b') then 6 when regexp_matches(route, 'recruit|campus|social|intern|hiring') then 4 else 0 end
  - {S.hits('ll', [x.lower() for x in V.ROUTE_NEGATIVE])} * 6 - case when {S.host('resolved')} <> {S.host('source_url')} then 100 else 0 end as route_score from s),
 r as (select *, row_number() over (partition by page_id order by route_score desc, pos) as rank from w)
select page_id, pos::integer as pos, entry_score::integer as entry_score, action_score::integer as action_score, search_score::integer as search_score, route_score::integer as route_score, rank::integer as rank from r where rank <= 12""")
def scored_links(t):
    """Four keyword-weighted scores; the twelve best route candidates per page."""
    df = links(t).select("page_id", "pos", K.entry_score("label", "resolved").alias("entry_score"),
                         K.action_score("label", "resolved", F.lit("CAMPUS")).alias("action_score"),
                         K.job_search_score("label", "resolved").alias("search_score"), K.route_score("label", "resolved", "source_url").alias("route_score"))
    return top_k(df, "page_id", [F.desc("route_score"), F.asc("pos")], 12)


@query("K1", f"""with {LINKS}, s as (select page_id, pos, {S.hits("lower(label || ' ' || resolved)", [x.lower() for x in V.ACTION_POSITIVE])} * 6 - {S.hits("lower(label || ' ' || resolved)", [x.lower() for x in V.ACTION_NEGATIVE])} * 8 as score from links),
 r as (select *, row_number() over (partition by page_id order by score desc, pos) as rank from s where score >= 18)
select page_id, pos::integer as pos, score::integer as score, rank::integer as rank from r where rank <= 2""")
def terminal_actions(t):
    """The two strongest actions of a page, none below the bar."""
    df = links(t).select("page_id", "pos", K.action_score("label", "resolved", F.lit("UNKNOWN")).alias("score")).filter("score >= 18")
    return top_k(df, "page_id", [F.desc("score"), F.asc("pos")], 2)


@query("T27", f"""select page_id, 0 as pos, 'IFRAME' as source_type, 'https://frames.' || split_part(url, '/', 3) || '/w' as source_url from pages union all
select page_id, 1, 'EMBEDDED_WIDGET', {S.scheme('url')} || '://' || split_part(url, '/', 3) || '/static/job-widget.js' from pages""")
def embedded_sources(t):
    """Frames and job widgets embedded in a page."""
    return P.embedded_sources(I.pages(t).withColumnRenamed("url", "base"), "html", "base").select("page_id", "pos", "source_type", "source_url")


@query("T21", f"""with {I.URLS}, i as (select page_id, v, case when {S.any_of('lower(url)', V.SOURCE_INTENT[0][1])} then 'CAMPUS' when {S.any_of('lower(url)', V.SOURCE_INTENT[1][1])} then 'SOCIAL' when {S.any_of('lower(url)', V.SOURCE_INTENT[2][1])} then 'INTERN' else 'UNKNOWN' end as intent,
 case v % 3 when 0 then 'ALL_JOBS' when 1 then 'CAMPUS' else 'SOCIAL' end as scope, url from urls), b as (select page_id, url as base from pages)
select i.page_id, v, intent, (case when intent = 'UNKNOWN' then case when scope = 'ALL_JOBS' then 3 else 0 end when scope = intent then 12 when scope = 'ALL_JOBS' then 6 else -20 end)::integer as compatibility,
 contains(replace({S.host('url')} || {S.path('url')}, '-', ''), split_part({S.host('base')}, '.', -2)) as continuous from i join b on i.page_id = b.page_id""")
def source_intents(t):
    """Intent of a source, how a scope fits it, and whether the company carries over."""
    df = I.urls(t).join(t.pages.select("page_id", F.col("url").alias("base")), "page_id").withColumn("intent", K.source_intent("url"))
    scope = F.expr("case v % 3 when 0 then 'ALL_JOBS' when 1 then 'CAMPUS' else 'SOCIAL' end")
    return df.select("page_id", "v", "intent", K.scope_compatibility("intent", scope).alias("compatibility"),
                     K.company_continuity("base", "url", F.lit(None).cast("string")).alias("continuous"))


_SCORED = f"""c as (select source_url, page_id, pos, resolved, {S.hits("lower(label || ' ' || resolved)", V.ENTRY_SCORE_POSITIVE)} * 3 - {S.hits("lower(label || ' ' || resolved)", V.ENTRY_SCORE_NEGATIVE)} * 4 as score,
  contains(replace({S.host('resolved')} || {S.path('resolved')}, '-', ''), split_part({S.host('source_url')}, '.', -2)) as ok, coalesce({_KIND("lower(label || ' ' || resolved)")}, 'UNKNOWN') as kind from links)"""


@query("N1", f"""with recursive {LINKS.replace(I.PAGES, I.SITES)}, {_SCORED}, e as (select {_PAGE('source_url')} as src, {_PAGE('resolved')} as dst, max(score) as score from c where score > 0 and ok group by 1, 2),
 walk as (select distinct {_PAGE('url')} as node, 0 as depth from pages where contains(url, '#') union select e.dst, w.depth + 1 from walk w join e on e.src = w.node where w.depth < 3),
 m as (select node, min(depth) as depth from walk group by node) select m.node, m.depth::integer as depth, coalesce((select max(e.score) from e join m p on p.node = e.src and p.depth = m.depth - 1 where e.dst = m.node), 0)::bigint as score from m""")
def bounded_reach(t):
    """Pages within three hops, over scored links of their own site, of the pages captured by fragment, with the best score of the last hop."""
    edges = N.page_edges(P.extract_links(I.sites(t).withColumnRenamed("url", "source_url"), "html", "source_url"))
    seeds = t.pages.filter(F.col("url").contains("#")).select(U.page_of("url").alias("node"))
    return N.bounded_reach(edges, seeds, "source", "target").select("node", "depth", "score")


@query("N1", f"""with {LINKS}, {_SCORED},
 b as (select *, row_number() over (partition by page_id order by score desc, kind <> 'CAMPUS', resolved) as r from c where score > 0 and ok)
select page_id, resolved as node, score::integer as score, kind from b where r = 1""")
def best_terminals(t):
    """Best trusted entry of each page."""
    edges = N.scored_edges(links(t)).select("page_id", F.col("resolved").alias("node"), "score", "kind", F.lit(1).alias("depth"), (F.col("kind") == "CAMPUS").alias("matches_intent"))
    return N.best_terminal(edges, "page_id").select("page_id", "node", "score", "kind")



@query("W14", f"""with b as (select doc_id, i::integer as ord, string_split(text, chr(10))[i + 1] as block, source from documents, unnest(range(len(string_split(text, chr(10))))) as r(i)),
 s as (select *, least(length(block), 6000) + {S.hits('lower(block)', V.JD_SIGNALS)} * 500 - {S.hits('lower(block)', V.JD_PENALTIES)} * 700 + case when contains(lower(block), source) then 300 else 0 end - ord as score from b where {S.credible_jd('block')}),
 r as (select *, row_number() over (partition by doc_id order by score desc, ord) as rn from s) select doc_id, ord, score::integer as score from r where rn = 1""")
def best_blocks(t):
    """Block of a page most like the job description."""
    df = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "block"))
    return P.best_jd_block(df, "doc_id", "source", "block", "ord").select("doc_id", "ord", "score")
