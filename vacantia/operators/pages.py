"""Captured-page operators: detail semantics, links, cards, embedded sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import jd as J, markup as M, records as R, score as K, urls as U
from ..functions.text import c, contains_any, heading, let, squeeze, strip, unescape, without_space
from .grouping import fence, first_by


def html_detail(df: DataFrame, lines: str, title: str, job_id: Column, url: str, blank: bool = False) -> DataFrame:
    """Adds failure, full_jd, responsibilities, requirements, bound_id of a detail page given as text lines.

    With ``blank`` responsibilities without lines are an empty line of full_jd."""
    none = F.expr(R.NO_STRINGS)
    at = lambda vocab, after: F.array_min(F.filter(F.transform("_norm", lambda h, i: F.when(
        h.isin(vocab) & (i > after), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_norm", F.transform(lines, heading))
    df = df.withColumn("resp_at", at(V.PAGE_RESPONSIBILITY, F.lit(-1)))
    df = df.withColumn("req_at", at(V.PAGE_REQUIREMENT, F.coalesce("resp_at", F.lit(-1))))
    df = df.withColumn("_end", F.coalesce(at(V.PAGE_END, F.coalesce("req_at", "resp_at")), F.size(lines)))
    resp, req, end = F.col("resp_at"), F.col("req_at"), F.col("_end")
    df = df.withColumns({
        "responsibilities": F.slice(lines, resp + 2, F.greatest(F.coalesce(req, end) - resp - 1, F.lit(0))),
        "requirements": F.when(req.isNotNull(), F.slice(lines, req + 2, F.greatest(end - req - 1, F.lit(0)))).otherwise(none),
        "_ids": U.path_bound_ids(url), "_title": F.lower(strip(title)),
    })
    duties = F.when(F.size("responsibilities") > 0, F.col("responsibilities")).otherwise(F.array(F.lit("")) if blank else none)
    text = F.array_join(F.concat(
        F.slice(lines, resp + 1, F.lit(1)), duties,
        F.when(req.isNotNull(), F.slice(lines, req + 1, F.lit(1))).otherwise(none), F.col("requirements")), "\n")
    df = df.withColumn("full_jd", text if blank else strip(text))
    title_ok = (F.coalesce("_title", F.lit("")) == "") | F.exists(F.slice("_norm", F.lit(1), resp), lambda h: h.contains(F.col("_title")))
    id_ok = job_id.isNull() | (F.size("_ids") == 0) | F.exists("_ids", lambda s: s["value"] == job_id.cast("string"))
    failure = (F.when(resp.isNull(), "JD_CONTAINER_NOT_FOUND").when(~title_ok, "TITLE_MISMATCH").when(~id_ok, "TITLE_MISMATCH")
               .when(F.length(without_space("full_jd")) < 100, "JD_TOO_SHORT"))
    df = df.withColumns({"failure": failure, "bound_id": F.get("_ids", F.lit(0))["value"]}).drop("_norm", "_end", "_ids", "_title")
    return fence(df, ["failure", "full_jd", "responsibilities", "requirements", "bound_id"])


def outcome_label(route_changed, dom_changed, job_source) -> Column:
    return (F.when(c(job_source) & c(route_changed), "JOB_SOURCE_FOUND")
            .when(c(route_changed) | c(dom_changed), "USEFUL_ROUTE_CHANGE").otherwise("NO_PROGRESS"))


def extract_links(df: DataFrame, html: str, base: str) -> DataFrame:
    """One row per anchor with an address: pos, href, label, resolved address, tag attributes."""
    rest = [n for n in df.columns if n != html]
    found = F.filter(F.transform(M.anchors(html), lambda a: F.struct(M.attribute(a, "href").alias("href"), a.alias("anchor"))),
                     lambda a: a["href"].isNotNull())
    out = df.select(*rest, F.posexplode(found).alias("pos", "_a"))
    out = out.select(*rest, "pos", unescape("_a.href").alias("href"), F.col("_a.anchor").alias("_anchor"))
    label = squeeze(unescape(M.without_tags(M.without_raw_text(M.anchor_body("_anchor")))))
    return out.select(*rest, "pos", "href", label.alias("label"), U.resolve(base, "href").alias("resolved"), M.anchor_head("_anchor").alias("attributes"))


def link_rejection(href, label, resolved, source_url, structural: Column | None = None) -> Column:
    """Why a link is not a job detail; null when it is one."""
    value, path = strip(href), U.path(resolved)
    low = F.lower(F.concat(path, F.lit(" "), c(label)))
    fragment_job = value.rlike(V.LINK_JOB_FRAGMENT)
    label_ok = F.length(strip(label)).between(3, 200) & ~F.lower(strip(label)).isin(V.LINK_GENERIC_LABELS)
    seen = structural & label_ok if structural is not None else F.lit(False)
    return (F.when((value == "") | (value.startswith("#") & ~fragment_job)
                   | ((U.page_of(resolved) == U.page_of(source_url)) & ~fragment_job), "SAME_PAGE_OR_FRAGMENT")
            .when(U.scheme(resolved) != "https", "NON_HTTPS_LINK")
            .when(contains_any(low, V.LINK_NON_JOB), "NON_JOB_CONTENT")
            .when(path.rlike(V.LINK_SEARCH_PATH) | (F.lower(path).contains("search") & ~path.rlike(r"\d{3,}")), "SEARCH_OR_LIST_PAGE")
            .when(~fragment_job & path.rlike(V.LINK_LANDING_PATH), "LANDING_OR_LOCALE_PAGE")
            .when(~path.rlike(V.LINK_IDENTITY_PATH) & ~fragment_job & ~seen, "LOW_DETAIL_LINK_EVIDENCE"))


def filter_detail_links(links: DataFrame, page: str, source_url: str) -> DataFrame:
    """Adds reason; accepted links have none."""
    return fence(links.withColumn("reason", link_rejection("href", "label", "resolved", source_url)), ["reason"])


def distinct_links(links: DataFrame, keys, order: str = "pos") -> DataFrame:
    """First appearance of each address, order kept."""
    return first_by(links, keys, order)


def related_hosts(links: DataFrame, page: str, source_host: str, resolved: str = "resolved", least: int = 2) -> DataFrame:
    """Foreign https hosts a page links to at least twice."""
    h = U.host(resolved)
    foreign = links.filter((U.scheme(resolved) == "https") & (h != "") & (h != F.col(source_host)))
    return foreign.groupBy(page, h.alias("host")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def card_groups(links: DataFrame, page: str, signature: str) -> DataFrame:
    """Best repeated-card group per page: two or more addresses, three in five of them job-like."""
    low = F.lower(F.concat(U.path("resolved"), F.lit(" "), F.col("label")))
    usable = links.filter(U.scheme("resolved").isin("http", "https") & (U.netloc("resolved") != "")
                          & F.length("label").between(2, 240) & ~contains_any(low, V.CARD_CONTROL_WORDS))
    unique = usable.groupBy(page, signature, "resolved").agg(F.min("pos").alias("first_pos"))
    scored = unique.groupBy(page, signature).agg(
        F.count("*").alias("cards"), F.count_if(F.col("resolved").rlike(V.CARD_JOB_PATH)).alias("job_paths"), F.min("first_pos").alias("first_pos"))
    good = scored.filter((F.col("cards") >= 2) & (F.col("job_paths") * 5 >= F.col("cards") * 3))
    return first_by(good, page, [(-F.col("job_paths")).alias("a"), (-F.col("cards")).alias("b"), F.col("first_pos")])


def recruitment_entries(links: DataFrame, page: str) -> DataFrame:
    """Labelled recruitment links without negative wording, https only, first per address."""
    kind = K.entry_type("label", "resolved")
    low = F.lower(F.concat_ws(" ", "label", "resolved"))
    good = fence(links.withColumn("entry_type", kind), ["entry_type"]).filter(
        F.col("entry_type").isNotNull() & ~contains_any(low, V.ENTRY_NEGATIVE) & (U.scheme("resolved") == "https"))
    return first_by(good, [page, "resolved"], "pos")


def embedded_sources(df: DataFrame, html: str, base: str) -> DataFrame:
    """Public https frames and job widgets a page embeds."""
    sources = lambda tag: F.filter(F.transform(M.heads(html, tag), lambda x: unescape(M.attribute(x, "src"))), lambda x: x.isNotNull())
    frames = F.transform(sources("iframe"), lambda s: F.struct(F.lit("IFRAME").alias("kind"), s.alias("src")))
    widgets = F.transform(F.filter(sources("script"), lambda s: contains_any(s, ["job", "career", "recruit"])),
                          lambda s: F.struct(F.lit("EMBEDDED_WIDGET").alias("kind"), s.alias("src")))
    rest = [n for n in df.columns if n != html]
    out = df.select(*rest, F.posexplode(F.concat(frames, widgets)).alias("pos", "_s"))
    out = out.select(*rest, "pos", F.col("_s.kind").alias("source_type"), U.resolve(base, F.col("_s.src")).alias("source_url"))
    return out.filter((F.col("source_type") != "IFRAME") | (
        (U.scheme("source_url") == "https") & ~contains_any(F.lower("source_url"), V.FRAME_EXCLUDED)))


def best_jd_block(blocks: DataFrame, page, title: str, text: str, order: str) -> DataFrame:
    """Block of a page that most looks like the description; the earlier one on ties."""
    scored = blocks.filter(J.credible_jd(text)).withColumn("score", J.block_score(text, title, order))
    return first_by(scored, page, [(-F.col("score")).alias("s"), F.col(order)])
