"""Run-level summaries: completeness, statuses, accounting, merges, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import company as C, export as E
from ..functions.text import c, contains_any, strip
from .grouping import first_by, modal, names


def har_metrics(attempts: DataFrame, best: DataFrame, records: DataFrame, run: str) -> DataFrame:
    """Import counters per run.  Every entry counts as matched; a missing body counts as malformed."""
    n = F.count_if
    a = attempts.groupBy(run).agg(F.count("*").alias("har_entries"), n("usable").alias("usable_responses"), n("malformed").alias("malformed_json_responses"))
    b = best.groupBy(run).agg(n("usable").alias("pages_observed"))
    r = records.groupBy(run, "job_id").agg(F.count("*").alias("_n")).groupBy(run).agg(
        F.sum("_n").alias("raw_rows"), F.count("*").alias("unique_jobs"))
    out = a.join(b, run, "left").join(r, run, "left").na.fill(0)
    return out.withColumns({"matched": F.col("har_entries"), "failed_responses": F.col("har_entries") - F.col("usable_responses"),
                            "duplicate_jobs": F.col("raw_rows") - F.col("unique_jobs")})


def agreed_total(df: DataFrame, run: str, total: str) -> DataFrame:
    """The one total all responses of a run state, else null."""
    return df.groupBy(run).agg(F.when(F.min(total) == F.max(total), F.min(total)).alias("agreed_total"))


def completeness(jobs: DataFrame, run: str) -> DataFrame:
    """Quality counters per run over full_jd, jd_state, responsibilities, requirements, requirements_field."""
    n = F.count_if
    has_jd = F.coalesce(F.col("full_jd") != "", F.lit(False))
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    meaningful = (F.when(F.col("jd_state").isin("FULL_TEXT", "SPLIT"), True).when(F.col("jd_state") == "SUMMARY", False)
                  .otherwise((F.length(F.coalesce("full_jd", F.lit(""))) >= 160) | ~none("requirements") | ~none("responsibilities")))
    good = has_jd & meaningful
    out = jobs.groupBy(run).agg(
        F.count("*").alias("total_jobs"), n(has_jd).alias("complete_jobs"), n(~has_jd).alias("missing_jd_jobs"),
        n(none("requirements")).alias("missing_requirements_jobs"), n(none("responsibilities")).alias("missing_responsibilities_jobs"),
        n(good).alias("jd_complete"), n(~good).alias("jd_incomplete"), n(F.col("jd_state").isin("FULL_TEXT", "SPLIT")).alias("list_sufficient"),
        n(good & F.col("requirements_field").isNull()).alias("source_requirements_absent"))
    return out.withColumn("completeness_ratio", F.round(F.col("complete_jobs") / F.col("total_jobs"), 6))


def collection_status(list_started, expected, unique, n_errors, detail_failures, scope_leak, max_pages) -> Column:
    bad = (c(n_errors) > 0) | (c(detail_failures) > 0) | c(scope_leak) | c(max_pages) | (c(unique) != c(expected))
    return F.when(~c(list_started) | c(expected).isNull(), "FAILED").when(bad, "INCOMPLETE").otherwise("COMPLETE")


def completion_contract(pages, expected, fetched, unique, collapsed, unexplained, fatal_errors, detail_active, blocked, failed, pending, teasers) -> Column:
    """COMPLETE only when counts match or copies are explained, nothing fatal happened, and details are all in."""
    explained = (c(collapsed) > 0) & (c(unexplained) == 0)
    counts = (c(expected) == c(fetched)) & ((c(fetched) == c(unique)) | explained)
    clean = ~c(detail_active) | ((c(blocked) == 0) & (c(failed) == 0) & (c(pending) == 0) & (c(teasers) == 0))
    good = F.coalesce(counts & (c(fatal_errors) == 0) & clean & (c(expected) >= 0) & ((c(unique) > 0) | (c(expected) == 0)), F.lit(False))
    return F.when(c(pages) == 0, "FAILED").when(good, "COMPLETE").otherwise("INCOMPLETE")


def detail_accounting(records: DataFrame, errors: DataFrame, run, job_id: str, source: str) -> DataFrame:
    """Each record in exactly one bucket; the buckets add up to the total.

    ``errors`` are error lines with run, job_id, code."""
    keys = names(run) + [job_id]
    facts = errors.groupBy(*keys).agg(F.bool_or(F.col("code").isin(V.DETAIL_BLOCKED)).alias("_b"), F.bool_or(F.col("code").isin(V.DETAIL_FAILED)).alias("_f"))
    bucket = (F.when(F.col(source).startswith("BROWSER"), "browser").when(F.coalesce(F.col(source), F.lit("")) != "", "http")
              .when(F.coalesce("_b", F.lit(False)), "blocked").when(F.coalesce("_f", F.lit(False)), "failed").otherwise("pending"))
    rows = records.join(facts, keys, "left").withColumn("_k", bucket)
    n = lambda k: F.count_if(F.col("_k") == k)
    return rows.groupBy(*names(run)).agg(F.count("*").alias("total"), n("http").alias("http_resolved"), n("browser").alias("browser_resolved"),
                                         n("blocked").alias("blocked"), n("failed").alias("failed"), n("pending").alias("pending"))


def merge_scopes(jobs: DataFrame, run, key: str, scope: str, scope_order: str, order: str, stable: str) -> DataFrame:
    """One row per posting across scopes: first row wins, scopes listed in scope order.

    Rows of one scope collapse first, so a posting seen everywhere costs one row per scope."""
    keys = names(run) + [key]
    per = jobs.groupBy(*keys, scope).agg(F.min(scope_order).alias("_so"), F.min(order).alias("_first"), F.min_by(stable, order).alias("_st"), F.count("*").alias("_n"))
    out = per.groupBy(*keys).agg(
        F.min_by("_first", F.struct("_so", "_first")).alias("first_row"), F.min_by("_st", F.struct("_so", "_first")).alias("_first_stable"),
        F.array_sort(F.collect_list(F.struct("_so", F.col(scope)))).alias("_s"), F.count_if("_st").alias("_stable_scopes"), F.sum("_n").alias("rows"))
    return out.select(*keys, "first_row", F.array_join(F.transform("_s", lambda s: s[scope]), "|").alias("scopes"), "rows",
                      F.when(F.col("_first_stable"), F.col("_stable_scopes") - 1).otherwise(0).alias("merged_rows"))


def scope_progress(jobs: DataFrame, totals: DataFrame, run, scope: str, key: str) -> DataFrame:
    """Fetched, unique and status per scope."""
    ks = names(run) + [scope]
    per = jobs.groupBy(*ks, key).agg(F.count("*").alias("_n")).groupBy(*ks).agg(F.sum("_n").alias("fetched"), F.count("*").alias("unique_jobs"))
    out = per.join(totals, ks, "left")
    return out.withColumn("status", F.when(F.col("official_total") == F.col("fetched"), "SCOPE_COMPLETE").otherwise("SCOPE_INCOMPLETE"))


def site_completion(progress: DataFrame, run) -> DataFrame:
    return progress.groupBy(*names(run)).agg(F.when(F.bool_and(F.col("status") == "SCOPE_COMPLETE"), "SITE_COMPLETE").otherwise("SITE_INCOMPLETE").alias("site_completion"))


def unified_company(jobs: DataFrame, run, company: str) -> DataFrame:
    """The one employer all jobs of a run agree on, else null."""
    name = F.nullif(strip(company), F.lit(""))
    return jobs.groupBy(*names(run)).agg(F.when(F.min(name) == F.max(name), F.min(name)).alias("unified_company"))


def resolve_company(runs: DataFrame, unified: str, explicit: str, url: str) -> DataFrame:
    """Adds company: agreed by the jobs, stated by the site, or read from its host."""
    return runs.withColumn("company", F.coalesce(F.col(unified), F.nullif(F.col(explicit), F.lit("")), C.infer_site_company(url)))


def detail_resolution(jobs: DataFrame, run, method: str, url: str, order: str) -> DataFrame:
    """Method mix of a run and its most common detail address."""
    n = F.count_if
    mix = jobs.groupBy(*names(run)).agg(*[n(F.col(method) == m).alias(m.lower()) for m in ("LIST_SUFFICIENT", "AUTO_API", "RENDERED_PAGE", "LIST_ONLY")])
    rendered = jobs.filter(F.col(method) == "RENDERED_PAGE").select(*names(run), url, order)
    common = modal(rendered, run, url, order).select(*names(run), F.col(url).alias("detail_url_pattern"))
    return mix.join(common, names(run), "left")


def enrichment_counts(jobs: DataFrame, run, state: str) -> DataFrame:
    known = ["not_requested", "pending", "complete", "verification_required", "failed"]
    low = F.lower(F.col(state))
    n = F.count_if
    return jobs.groupBy(*names(run)).agg(*[n(low == k).alias(k) for k in known], n(low.isNull() | ~low.isin(known)).alias("unknown"))


def quality_issues(jobs: DataFrame, run: str, job_id: str, title: str, detail_url: str) -> DataFrame:
    """One row per job issue: missing text, missing structure, over-long cell."""
    label = E.row_completeness("full_jd", "responsibilities", "requirements")
    gaps = F.array_join(F.array_compact(F.array(F.when(F.size("responsibilities") <= 0, "responsibilities"), F.when(F.size("requirements") <= 0, "requirements"))), ", ")
    issue = lambda kind, text: F.struct(F.lit(kind).alias("issue_type"), text.alias("description"))
    found = F.array_compact(F.array(
        F.when(label == "MISSING_JD", issue("SOURCE_MISSING_JD", F.lit("No full JD was available from the collected official source."))),
        F.when(label == "STRUCTURE_PARTIAL", issue("STRUCTURED_FIELDS_UNAVAILABLE", F.concat(F.lit("Full JD preserved; structured "), gaps, F.lit(" unavailable.")))),
        F.when(F.length("full_jd") > V.CELL_LIMIT, issue("EXCEL_CELL_TRUNCATED", F.lit("Excel cell truncated; jobs.json retains the full value.")))))
    return jobs.select(run, F.col(job_id).alias("job_id"), F.col(title).alias("job_title"), F.col(detail_url).alias("detail_url"), F.explode(found).alias("_i")).select(
        run, "job_id", "job_title", "_i.issue_type", "_i.description", "detail_url")


def run_issues(lines: DataFrame, run: str, text: str, kind: str) -> DataFrame:
    """Warning or error lines of a run as quality rows."""
    none = F.lit(None).cast("string")
    return lines.select(run, none.alias("job_id"), none.alias("job_title"), F.lit(kind).alias("issue_type"), F.col(text).alias("description"), none.alias("detail_url"))


def sanitize_stats(df: DataFrame, run, text: str) -> DataFrame:
    """What cell sanitation changes, counted."""
    n, x, body = F.count_if, F.col(text), F.col("_body")
    df = df.withColumn("_clean", E.without_controls(text)).withColumn("_body", E.line_ends("_clean"))
    # a body of at most so many bytes is not long, so its characters need no count
    facts = df.select(*names(run), (body != x).alias("_changed"), ((F.octet_length(body) > V.CELL_LIMIT) & (F.length(body) > V.CELL_LIMIT)).alias("_long"),
                      E.is_formula(body).alias("_formula"), F.when(x == F.col("_clean"), F.lit(0)).otherwise(F.length(x) - F.length("_clean")).cast("bigint").alias("_removed"))
    return facts.groupBy(*names(run)).agg(
        n(F.col("_changed") | F.col("_long") | F.col("_formula")).alias("cells_sanitized"), F.sum("_removed").alias("illegal_chars_removed"),
        n("_long").alias("cells_truncated"), n("_formula").alias("formula_escaped"))


def failure_class(row) -> Column:
    """First thing that went wrong on a site; ``row`` maps a name to a column."""
    reason = F.lower(F.coalesce(row("reason"), F.lit("")))
    env = contains_any(reason, V.ENVIRONMENT_WORDS)
    complete = row("status") == "COMPLETE"
    return (F.when(complete & row("false_complete"), "IDENTITY_FAILURE")
            .when(env & (reason.contains("browser") | reason.contains("targetclosed")), "ENVIRONMENT_BROWSER").when(env, "ENVIRONMENT_NETWORK")
            .when(~row("source_found"), "SOURCE_DISCOVERY_FAILURE").when(~row("executable"), "PLAN_NOT_EXECUTABLE")
            .when(~complete & (reason.contains("page") | reason.contains("pagination")), "PAGINATION_FAILURE")
            .when(~complete & (row("unique_jobs") < row("reported_total")), "TOTAL_MISMATCH").when(~complete, "PARTIAL_COLLECTION")
            .when(row("jd_incomplete") > 0, "JD_COMPLETENESS_FAILURE").when(~row("exported"), "EXPORT_FAILURE").otherwise("SUCCESS"))


def scorecard(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Rates over all sites against earlier values: one row per metric."""
    rate = lambda cond: F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("double")), 4)
    one = rows.agg(
        rate(F.col("source_found")).alias("source_found_rate"), rate(F.col("executable")).alias("executable_plan_rate"),
        rate(F.col("status").isNotNull() & (F.col("status") != "NOT_STARTED")).alias("collection_started_rate"),
        rate((F.col("status") == "COMPLETE") & ~F.col("false_complete")).alias("full_collection_rate"),
        F.round(F.coalesce(F.sum("jd_complete") / F.sum(F.col("jd_complete") + F.col("jd_incomplete")), F.lit(0.0)), 4).alias("jd_complete_rate"),
        rate(F.col("exported")).alias("excel_success_rate"), rate(F.col("failure_class") == "SUCCESS").alias("e2e_success_rate"))
    long = one.unpivot([], one.columns, "metric", "value")
    return long.join(before, "metric").select("metric", "value", "before", F.round(F.col("value") - F.col("before"), 4).alias("absolute_change"),
                                              F.round((F.col("value") - F.col("before")) * 100, 2).alias("point_change"))


def elapsed_stats(rows: DataFrame, group, seconds: str, site: str) -> DataFrame:
    """Average, median, longest and slowest site."""
    g = rows.groupBy(*names(group)) if group else rows.groupBy()
    return g.agg(F.round(F.avg(seconds), 3).alias("avg_seconds"), F.round(F.median(seconds), 3).alias("median_seconds"), F.max(seconds).alias("max_seconds"),
                 F.min_by(site, F.struct((-F.col(seconds)).alias("s"), F.col(site))).alias("slowest"))


def latency_metrics(tasks: DataFrame, run, kind: str, seconds: str, retry: str, sleep: str) -> DataFrame:
    n = F.count_if
    k = F.col(kind)
    out = tasks.groupBy(*names(run)).agg(
        n(k == "list").alias("list_requests"), n(k == "detail").alias("detail_requests"),
        F.sum(F.when(k == "list", F.greatest(F.col(seconds), F.lit(0.0))).otherwise(0.0)).alias("_l"),
        F.sum(F.when(k == "detail", F.greatest(F.col(seconds), F.lit(0.0))).otherwise(0.0)).alias("_d"),
        n(retry).alias("retry_count"), F.sum(F.when(F.col(retry), F.greatest(F.col(sleep), F.lit(0.0))).otherwise(0.0)).alias("_s"))
    avg = lambda total, count: F.round(F.coalesce(F.try_divide(total, count), F.lit(0.0)), 4)
    return out.select(*names(run), "list_requests", "detail_requests", F.round("_l", 3).alias("list_request_seconds"), F.round("_d", 3).alias("detail_request_seconds"),
                      avg(F.col("_l"), F.col("list_requests")).alias("average_list_request_seconds"), avg(F.col("_d"), F.col("detail_requests")).alias("average_detail_request_seconds"),
                      "retry_count", F.round("_s", 3).alias("retry_sleep_seconds"))


def page_coverage(runs: DataFrame, total: str, limit: str, succeeded: str, failed: str, stagnant: str) -> DataFrame:
    """Expected pages and whether every step of a paginated run succeeded."""
    expected = F.when(F.col(total) > 0, F.ceil(F.col(total) / F.coalesce(F.nullif(F.col(limit), F.lit(0)), F.col(total))))
    ok = (F.col(failed) == 0) & (F.col(stagnant) == 0) & F.coalesce(F.col(succeeded) == expected, F.lit(True))
    return runs.withColumns({"expected_pages": expected, "all_steps_succeeded": ok})


def category_distribution(df: DataFrame, run, category: str) -> DataFrame:
    return df.groupBy(*names(run), F.coalesce(F.col(category).cast("string"), F.lit("missing")).alias("category")).agg(F.count("*").alias("n"))


def run_verdict(runs: DataFrame) -> DataFrame:
    """Adds status, jd_strategy and the duplicate warning from total_jobs, jd_complete, raw_rows, total."""
    dup = F.greatest(F.col("raw_rows") - F.col("total_jobs"), F.lit(0))
    return runs.withColumns({
        "status": F.when(F.col("total_jobs") > 0, "COMPLETE").otherwise("FAILED"),
        "jd_strategy": F.when((F.col("total_jobs") > 0) & (F.col("jd_complete") == F.col("total_jobs")), "LIST_SUFFICIENT").when(F.col("jd_complete") > 0, "MIXED").otherwise("LIST_ONLY"),
        "warning": F.when(dup > 0, F.format_string("SOURCE_CROSS_PAGE_DUPLICATES raw_total=%s duplicate_records=%d", F.coalesce(F.col("total").cast("string"), F.lit("None")), dup)),
    })
