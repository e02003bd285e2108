"""Provider mappings: known applicant-tracking payload shapes to the jobs schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import markup as M, records as R, urls as U
from ..functions.text import c, lines, plain, strip, unescape
from .grouping import fence


def address_scope(df: DataFrame, url: str) -> DataFrame:
    """Adds org_id, site_id, mode (envelope provider) and business_type, category (alias provider)."""
    parts = U.segments(U.path(url))
    first = F.lower(F.get(parts, F.lit(0)))
    enveloped = (F.size(parts) >= 3) & F.get(parts, F.lit(0)).isin(V.ENVELOPE_ROUTES)
    business = F.when(first.isin(list(V.BUSINESS_TYPES)), first)
    return df.withColumns({
        "org_id": F.when(enveloped, F.get(parts, F.lit(1))),
        "site_id": F.when(enveloped, F.get(parts, F.lit(2)).try_cast("bigint")),
        "mode": F.when(enveloped, F.when(first.startswith("campus"), "campus").otherwise("social")),
        "business_type": business,
        "category": F.coalesce(*[F.when(business == k, F.lit(v)) for k, v in V.BUSINESS_TYPES.items()]),
    })


def page_state_scope(df: DataFrame, html: str) -> DataFrame:
    """Scope stated by a page's start-up data: IV, tenant name, process type."""
    text = F.replace(c(html), F.lit("&quot;"), F.lit('"'))
    member = lambda k: F.nullif(F.regexp_extract(text, rf'"{k}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    process = F.regexp_extract(text, r'"process_type"\s*:\s*(\d+)', 1).try_cast("int")
    return df.withColumns({
        "aes_iv": member("aesIv"), "tenant_name": member("tenant_name"), "process_type": process,
        "recruitment_type": F.when(process == 1, "social").when(process == 2, "campus"),
    })


def list_payload(payload, provider: str) -> Column:
    """struct(records array<variant>, total, error) of a provider's list response."""
    v, none = c(payload), F.expr("cast(null as array<variant>)")
    big = lambda p: F.try_variant_get(v, p, "bigint")
    arr = lambda p: F.try_variant_get(v, p, "array<variant>")
    if provider == "moka":
        records, total = arr("$.data.jobs"), big("$.data.jobStats.total")
        failed = F.coalesce(~F.try_variant_get(v, "$.success", "boolean"), F.lit(False)) | F.coalesce(big("$.code") != 0, F.lit(False))
        error = (F.when(failed, "API_ERROR").when(records.isNull(), "UNSUPPORTED_RESPONSE")
                 .when(total.isNull() | (total < 0), "INVALID_RESPONSE"))
    elif provider == "feishu":
        records, total = arr("$.data.job_post_list"), big("$.data.count")
        error = (F.when(F.coalesce(big("$.code") != 0, F.lit(False)), "LIST_API_ERROR")
                 .when(records.isNull() | total.isNull(), "LIST_SCHEMA_INVALID"))
    else:
        flat = [arr(f"$.{k}") for k in V.ALIAS_LIST_KEYS]
        deep = [arr(f"$.{o}.{k}") for o in V.ALIAS_LIST_KEYS for k in V.ALIAS_NESTED_LIST_KEYS]
        records = F.coalesce(*flat, *deep)
        total = F.coalesce(*[big(f"$.{k}") for k in V.ALIAS_TOTAL_KEYS],
                           *[big(f"$.{o}.{k}") for o in V.ALIAS_LIST_KEYS for k in V.ALIAS_TOTAL_KEYS])
        error = F.when(records.isNull(), "UNSUPPORTED_LIST_STRUCTURE").when(total < 0, "INVALID_TOTAL")
    return F.struct(F.when(error.isNull(), records).otherwise(none).alias("records"),
                    F.when(error.isNull(), total).alias("total"), error.alias("error"))


def map_moka(df: DataFrame, raw: str, detail: str, url: str, company: str) -> DataFrame:
    """Envelope provider: places by city, province, country; the text is cut where requirements start."""
    d = lambda p, t="string": F.try_variant_get(c(detail), f"$.{p}", t)
    r = lambda p, t="string": F.try_variant_get(c(raw), f"$.{p}", t)
    jid = F.coalesce(d("id"), r("id"))
    place = lambda x: F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in ("cityName", "provinceName", "country")])
    df = df.withColumn("_parts", F.filter(F.transform(F.split(F.regexp_replace(d("jobDescription"), "<[^>]*>", "\x01"), "\x01"), strip), lambda x: x != ""))
    df = df.withColumn("_cut", F.coalesce(F.array_min(F.filter(F.transform(
        "_parts", lambda x, i: F.when(x.contains("岗位要求") | x.contains("任职要求"), i)), lambda i: i.isNotNull())),
        F.size("_parts")))
    parts, cut = F.coalesce(F.col("_parts"), F.expr(R.NO_STRINGS)), F.coalesce(F.col("_cut"), F.lit(0))
    link = F.concat(F.regexp_replace(c(url), "/+$", ""), F.lit("#/job/"), jid)
    df = df.withColumns({
        "company": c(company), "job_id": jid, "job_title": F.coalesce(d("title"), r("title")),
        "job_category": d("zhineng.name"), "department": d("department.name"),
        "locations": F.coalesce(F.array_distinct(F.filter(F.transform(d("locations", "array<variant>"), place), lambda x: x.isNotNull())), F.expr(R.NO_STRINGS)),
        "recruitment_type": F.when(d("hireMode", "int") == 2, "校园招聘").otherwise("社会招聘"),
        "education": d("education"), "headcount": d("number", "int"),
        "responsibilities": F.slice(parts, F.lit(1), cut),
        "requirements": F.slice(parts, cut + 1, F.size(parts)),
        "full_jd": F.nullif(F.array_join(parts, "\n"), F.lit("")), "detail_url": link, "apply_url": link,
        "publish_date": d("publishedAt"),
    }).drop("_parts", "_cut")
    return fence(df, ["job_id", "job_title"]).filter("job_id is not null and job_title is not null")


def map_feishu(df: DataFrame, raw: str, url: str, site_path: str, company: str) -> DataFrame:
    """Translated-label provider: millisecond times, description and requirement make the text."""
    v = lambda p, t="variant": F.try_variant_get(c(raw), f"$.{p}", t)
    text = lambda p: F.coalesce(v(p, "string"), F.lit(""))
    cities = F.array_distinct(F.filter(F.transform(v("city_list", "array<variant>"), R.i18n), lambda x: x.isNotNull()))
    link = F.concat(U.scheme(url), F.lit("://"), U.netloc(url), F.lit("/"), c(site_path), F.lit("/position/detail/"), v("id", "string"))
    full = F.concat_ws("\n\n", F.nullif(text("description"), F.lit("")), F.nullif(text("requirement"), F.lit("")))
    out = df.withColumns({
        "company": c(company), "job_id": v("id", "string"), "job_title": F.when(R.is_text(v("title")), v("title", "string")),
        "job_category": F.coalesce(R.i18n(v("job_function")), R.i18n(v("job_category"))),
        "department": F.coalesce(R.i18n(v("department_info")), R.i18n(v("job_post_info.department"))),
        "locations": F.coalesce(cities, F.expr(R.NO_STRINGS)),
        "recruitment_type": F.coalesce(R.i18n(v("recruit_type.parent")), R.i18n(v("recruit_type"))),
        "education": F.coalesce(R.i18n(v("job_post_info.required_degree")), R.i18n(v("job_post_info.education"))),
        "headcount": F.when(R.is_integer(v("vacancies")), v("vacancies", "int")),
        "responsibilities": lines(text("description")), "requirements": lines(text("requirement")),
        "full_jd": F.nullif(full, F.lit("")), "detail_url": link, "apply_url": link,
        "publish_date": R.epoch_millis_to_iso(v("publish_time", "bigint")),
    })
    return fence(out, ["job_id", "job_title"]).filter("job_id is not null and job_title is not null")


def map_zhiye(df: DataFrame, raw: str, detail: str, url: str, company: str) -> DataFrame:
    """Alias provider: thirteen alias groups over the detail laid over the list record."""
    df = df.withColumn("_m", R.overlay(R.as_record(raw), R.as_record(detail))).withColumn("_l", R.as_record(raw))
    field = lambda name: R.alias_field("_m", name)
    text = lambda name: R.as_text(field(name))
    string = lambda name: F.when(R.is_text(field(name)), text(name))
    category = text("category_id")
    label = F.coalesce(*[F.when(category == k, F.lit(x)) for k, x in V.CATEGORY_LABELS.items()])
    segment = F.coalesce(*[F.when(category == k, F.lit(x)) for k, x in V.CATEGORY_SEGMENTS.items()])
    jid = R.as_text(R.alias_field("_l", "job_id"))
    origin = F.concat(U.scheme(url), F.lit("://"), U.netloc(url))
    link = F.concat(origin, F.when(segment.isNotNull(), F.concat(F.lit("/"), segment, F.lit("/detail")))
                    .otherwise(F.replace(U.path(url), F.lit("/jobs"), F.lit("/detail"))), F.lit("?jobAdId="), U.quote(jid))
    labelled = lambda head, x: F.concat(F.lit(head + "\n"), strip(x))
    places = F.filter(F.coalesce(F.try_variant_get(field("locations"), "$", "array<string>"),
                                 F.when(string("locations").isNotNull(), F.array(string("locations"))),
                                 F.expr(R.NO_STRINGS)), lambda x: x != "")
    none = F.expr(R.NO_STRINGS)
    out = df.withColumns({
        "company": F.coalesce(text("company"), c(company)), "job_id": jid, "job_title": strip(string("job_title")),
        "job_category": text("category"), "department": text("department"), "locations": places,
        "recruitment_type": label, "education": text("education"), "major": text("major"),
        "headcount": F.when(R.is_integer(field("headcount")), text("headcount").try_cast("int")),
        "responsibilities": F.coalesce(lines(string("duty")), none), "requirements": F.coalesce(lines(string("requirement")), none),
        "full_jd": F.nullif(F.concat_ws("\n\n", labelled("岗位职责", string("duty")), labelled("任职要求", string("requirement"))), F.lit("")),
        "detail_url": F.when(jid.isNotNull(), link), "publish_date": R.publish_date(string("publish_date")),
    }).drop("_m", "_l")
    return fence(out, ["job_title"]).filter("job_title is not null")


def _first(html, pattern) -> Column:
    return F.nullif(plain(F.regexp_extract(c(html), "(?is)" + pattern, 1)), F.lit(""))


def cms_list(df: DataFrame, html: str) -> DataFrame:
    """Server-rendered list of either template: one row per posting link (pos, position_id, title), with the page's stated
    ``total`` (first template) or count of ``pages`` (second), and ``error`` where the page is no usable list.

    A page without a link keeps one row; a link without a title is none."""
    page = c(html)
    second = F.lit(True)
    for mark in V.CMS_SECOND_MARKS:
        second = second & page.contains(mark)
    total = F.regexp_extract(plain(page), V.CMS_TOTAL, 1).try_cast("bigint")
    pages = F.array_max(F.transform(F.regexp_extract_all(page, F.lit(V.CMS_SECOND_PAGE), F.lit(1)), lambda x: x.try_cast("bigint")))

    def posting(a):
        href = unescape(M.attribute(a, "href"))
        found = F.when(second, F.regexp_extract(href, V.CMS_SECOND_LINK, 1)).otherwise(F.regexp_extract(href, V.CMS_LINK, 1))
        heading = F.regexp_extract(M.anchor_body(a), r"(?is)^\s*<h3>(.*?)</h3>", 1)
        shown = F.when(second, heading).otherwise(F.coalesce(F.nullif(M.attribute(a, "title"), F.lit("")), M.anchor_body(a)))
        return F.struct(F.nullif(found, F.lit("")).alias("position_id"), plain(shown).alias("title"))

    rows = F.filter(F.transform(M.anchors(page), posting), lambda r: r["position_id"].isNotNull() & (r["title"] != ""))
    out = df.withColumns({"_second": F.coalesce(second, F.lit(False)), "_rows": rows})
    out = out.withColumns({"total": F.when(~F.col("_second"), total), "pages": F.when(F.col("_second"), pages)})
    none = F.coalesce(F.size("_rows"), F.lit(0)) <= 0
    error = (F.when(F.col("_second") & F.col("pages").isNull(), V.CMS_ERRORS["second_pages"]).when(F.col("_second") & none, V.CMS_ERRORS["second_links"])
             .when(~F.col("_second") & F.col("total").isNull(), V.CMS_ERRORS["total"]).when(none & (F.col("total") > 0), V.CMS_ERRORS["links"]))
    out = out.withColumn("error", error)
    out = out.select("*", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_rows"))).alias("pos", "_r"))
    return out.withColumns({"position_id": F.col("_r.position_id"), "title": F.col("_r.title")}).drop("_r", "_rows", "_second")


def cms_detail(df: DataFrame, html: str) -> DataFrame:
    """Server-rendered detail in either template, with the path of its application form."""
    own = lambda name: F.coalesce(*[_first(html, p) for p in V.CMS_DETAIL[name]])
    tagged = _first(html, V.CMS_TAGS)
    last = F.element_at(F.filter(F.transform(F.split(tagged, r"\|"), strip), lambda x: x != ""), -1)
    apply_ = F.filter(F.transform(M.heads(html, "a"), lambda a: M.attribute(a, V.CMS_APPLY_ATTRIBUTE)), lambda x: x != "")
    return df.withColumns({
        **{n: own(n) for n in ("job_title", "department", "responsibilities", "requirements", "publish_date", "deadline")},
        "location": F.coalesce(own("location"), last), "headcount": own("headcount").try_cast("int"),
        "apply_path": plain(F.get(apply_, F.lit(0))),
    })


def cms_detail_json(df: DataFrame, payload: str) -> DataFrame:
    """JSON detail of the same provider; error tells why it cannot be used."""
    f = lambda k: F.nullif(plain(R.only_text(F.try_variant_get(c(payload), f"$.Data.{k}", "variant"))), F.lit(""))
    df = df.withColumns({"job_title": f("JobAdName"), "location": f("LocName"), "department": f("Department"),
                         "responsibilities": f("DutyStr"), "requirements": f("RequireStr"),
                         "headcount": f("HeadCountStr").try_cast("int"), "publish_date": f("PostDateStr"), "deadline": f("EndTimeStr")})
    code = F.try_variant_get(c(payload), "$.Code", "bigint")
    bad = F.col("job_title").isNull() | (F.col("responsibilities").isNull() & F.col("requirements").isNull())
    return df.withColumn("error", F.when(F.coalesce(code != 200, F.lit(True)), "DETAIL_API_INVALID_RESPONSE")
                         .when(R.as_record(F.try_variant_get(c(payload), "$.Data", "variant")).isNull(), "DETAIL_API_DATA_MISSING")
                         .when(bad, "DETAIL_API_JD_INCOMPLETE"))
