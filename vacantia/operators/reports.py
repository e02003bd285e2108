"""Report tables: export rows, summaries, error reports, report lines, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V, __version__
from ..functions import company as C, export as E, redact as X
from ..functions.text import c
from .grouping import running_total
from .windows import collision_ordinal

# jobs of a run up to which its report tells the descriptions
WHOLE_REPORT = 50


def csv_rows(jobs: DataFrame) -> DataFrame:
    """The thirteen export columns, every cell one safe line."""
    text = {"id": "job_id", "title": "job_title", "company": "company", "department": "department", "education": "education", "job_type": "recruitment_type",
            "publish_date": "publish_date", "detail_url": "detail_url", "apply_url": "apply_url", "jd_enrichment_status": "jd_enrichment_status"}
    lists = {"location": "locations", "responsibilities": "responsibilities", "requirements": "requirements"}
    return jobs.select(*[(E.csv_cell(F.col(text[h]).cast("string")) if h in text else E.csv_list(lists[h])).alias(h) for h in V.CSV_HEADERS])


def collection_summary(runs: DataFrame, counts: DataFrame, run: str) -> DataFrame:
    """One summary row per run: header, rounded times, enrichment counts, allow-listed detail facts."""
    allowed = ["detail_method", "rendered_page_attempted", "user_curl_attempted", "list_only_used", "jd_success", "jd_failed", "jd_missing"]
    joined = runs.join(counts, run, "left")
    return joined.withColumns({
        "elapsed_seconds": F.round("elapsed_seconds", 3),
        "total_elapsed_seconds": F.round(F.coalesce(F.nullif(F.col("total_elapsed_seconds"), F.lit(0.0)), F.col("elapsed_seconds")), 3),
        "detail_resolution": F.map_filter("detail_resolution", lambda k, _: k.isin(allowed)),
    })


def error_report(errors: DataFrame, runs: DataFrame, run: str, text: str) -> DataFrame:
    """One structured row per error line; runs without errors have none."""
    parsed = errors.withColumn("_p", X.parse_error(text)).join(runs, run)
    return parsed.select(run, "company", "source_url", "collection_mode", "status", F.col("collection_mode").alias("stage"), F.col("_p.code").alias("error_type"),
                         F.col("_p.reason").alias("reason"), F.col(text).alias("message"), "retry_count", F.col("_p.context").alias("context"))


def numbered_jobs(jobs: DataFrame, run: str, order: str) -> DataFrame:
    """Adds job_no, the position of a job in its run, counted in two levels."""
    return running_total(jobs.withColumn("_one", F.lit(1).cast("bigint")), run, order, {"job_no": "_one"}).drop("_one")


def workbook_jobs(jobs: DataFrame, run: str, order: str, limit: int | None = None) -> DataFrame:
    """Sheet of jobs: twenty columns, every text cell safe and whole, and ``over_limit`` where a cell is too long for a workbook file.

    Only with a ``limit`` cells are cut to it, with a marker."""
    long = lambda x: E.long_cell(x, limit)
    safe = lambda x: E.sanitize_cell(F.coalesce(F.col(x).cast("string"), F.lit("")), limit)
    link = lambda x, label: F.when(F.coalesce(F.col(x), F.lit("")) != "", label).otherwise("")
    rows = numbered_jobs(jobs, run, order)
    cells = [F.col("job_no"), safe("company"), safe("job_title"), safe("job_id"), safe("recruitment_type"), safe("job_category"), safe("department"),
             E.sanitize_cell(E.locations_text("locations"), limit), safe("education"), E.sanitize_cell(F.array_join("major", "、"), limit), F.col("headcount"), safe("publish_date"),
             long(E.numbered("responsibilities")), long(E.numbered("requirements")), long(F.col("full_jd")), link("detail_url", "查看岗位"), link("apply_url", "前往投递"),
             link("source_url", "来源网页"), E.row_completeness("full_jd", "responsibilities", "requirements"), safe("jd_enrichment_status")]
    over = E.over_limit(E.numbered("responsibilities"), E.numbered("requirements"), "full_jd", "job_title", "company", "department")
    return rows.select(run, *[x.alias(h) for x, h in zip(cells, V.SHEET_HEADERS)], over.alias("over_limit"))


def workbook_summary(runs: DataFrame, run: str) -> DataFrame:
    """Sheet of sections: run, section, metric, value."""
    sections = {
        "COLLECTION": {"Company": "company", "Platform": "platform", "Source URL": "source_url", "Recruitment scope": "scope_text", "Collection status": "status"},
        "JOB COUNTS": {"Expected": "total_expected", "Fetched": "total_fetched", "Unique": "total_unique"},
        "DATA QUALITY": {"Complete jobs": "complete_jobs", "Missing JD": "missing_jd_jobs", "Missing responsibilities": "missing_responsibilities_jobs",
                         "Missing requirements": "missing_requirements_jobs", "Completeness ratio": "completeness_ratio"},
        "PERFORMANCE": {"Elapsed": "elapsed_seconds", "Pages": "list_pages", "List requests": "list_requests", "Detail requests": "detail_requests", "JD strategy": "jd_strategy"},
        "WARNINGS": {"Warnings count": "warnings", "Errors count": "errors"},
    }
    cells = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), E.sanitize_cell(F.coalesce(F.col(x).cast("string"), F.lit(""))).alias("value"))
             for s, items in sections.items() for m, x in items.items() if x in runs.columns]
    return runs.select(run, F.posexplode(F.array(*cells)).alias("row_no", "_c")).select(run, "row_no", "_c.section", "_c.metric", "_c.value")


def human_reason(status, expected, fatal_code, capped, blocked, failed, skipped) -> Column:
    """Why a run is not complete, in one sentence."""
    some = lambda n, text: F.when(c(n) > 0, text)
    plural = lambda n: F.when(c(n) != 1, "s").otherwise("")
    parts = F.concat_ws(
        "; ", F.when(c(capped), "stopped at the user-configured page cap (controlled limit, not a provider failure)"),
        some(blocked, F.concat(c(blocked).cast("string"), F.lit(" job detail"), plural(blocked), F.lit(" could not be resolved (blocked by the source; nothing was fabricated)"))),
        some(failed, F.concat(c(failed).cast("string"), F.lit(" job detail request"), plural(failed), F.lit(" failed"))),
        some(skipped, F.concat(F.lit("the browser detail budget was exhausted with "), c(skipped).cast("string"), F.lit(" job(s) unattempted"))))
    return (F.when(c(status) == "FAILED", F.when(c(expected).isNull(), "the job list itself could not be acquired, so nothing can be trusted.")
                   .otherwise(F.concat(F.lit("fatal error: "), F.coalesce(c(fatal_code), F.lit("list acquisition failed")), F.lit("."))))
            .when(c(status) == "INCOMPLETE", F.when(parts != "", parts).otherwise("the fetched list did not match the source's expected total.")))


def human_summary(status, expected, fetched, unique, detail_total, http, browser, blocked, failed, pending, reason) -> Column:
    """A few plain lines about a run."""
    s = lambda x: c(x).cast("string")
    phrase = F.when(c(status) == "COMPLETE", "Collection complete.").when(c(status) == "FAILED", "Collection failed.").when(c(status) == "INCOMPLETE", "Collection incomplete.").otherwise(c(status))
    listed = F.concat(F.lit("List: "), F.coalesce(s(expected), F.lit("?")), F.lit(" expected, "), s(fetched), F.lit(" fetched, "), s(unique), F.lit(" unique"))
    detail = F.when(c(detail_total) > 0, F.concat(
        F.lit("Detail: "), (c(http) + c(browser)).cast("string"), F.lit(" resolved ("), s(browser), F.lit(" browser-resolved), "), s(blocked), F.lit(" blocked, "), s(failed), F.lit(" failed"),
        F.when(c(pending) > 0, F.concat(F.lit(", "), s(pending), F.lit(" pending"))).otherwise("")))
    return F.concat_ws("\n", phrase, F.lit(""), listed, detail, F.when(c(reason).isNotNull(), F.concat(F.lit("\nReason: "), c(reason))))


def report_lines(runs: DataFrame, jobs: DataFrame, run: str, order: str, compact: bool | None = False) -> DataFrame:
    """Markdown report as rows (run, job_no, line_no, line): an overview, then a section per job.

    A compact report leaves the descriptions out; with None a run decides by its size: up to 50 jobs are told whole."""
    md = E.md_inline
    label = lambda text, x, default="Unknown": F.concat(F.lit(f"- {text}: "), md(F.coalesce(F.nullif(F.col(x).cast("string"), F.lit("")), F.lit(default))))
    head = F.array(F.lit("# Job Collection Report"), F.lit(""), F.lit(f"Generated by vacantia {__version__}"), F.lit(""), F.lit("## Overview"), F.lit(""),
                   label("Company", "company"), label("Platform", "platform"), label("Source", "source_url", ""), F.lit(""), F.lit("## Collection Result"), F.lit(""),
                   label("Expected", "total_expected", "None"), label("Fetched", "total_fetched"), label("Unique", "total_unique"), label("Status", "status"), F.lit(""),
                   F.lit("## Jobs"), F.lit(""))
    overview = runs.select(run, F.lit(0).cast("bigint").alias("job_no"), F.posexplode(head).alias("line_no", "line"))
    rows = numbered_jobs(jobs, run, order)
    body = F.array(F.concat(F.lit("### "), F.col("job_no").cast("string"), F.lit(". "), md("job_title")), F.lit(""),
                   F.concat(F.lit("- Location: "), md(F.coalesce(F.nullif(E.locations_text("locations"), F.lit("")), F.lit("Unknown")))),
                   label("Category", "job_category"), label("Department", "department"), label("Recruitment Type", "recruitment_type"), label("Detail", "detail_url", ""))
    text = F.replace(F.coalesce(F.nullif(F.col("full_jd"), F.lit("")), F.lit("No full JD available.")), F.lit("```"), F.lit("` ` `"))
    told = F.array(F.lit(""), F.lit("#### Full JD"), F.lit(""), F.lit("```text"), text, F.lit("```"))
    whole = [] if compact else [told]
    if compact is None:
        sizes = jobs.groupBy(F.col(run).alias("_run")).agg((F.count("*") <= WHOLE_REPORT).alias("_whole"))
        rows = rows.join(sizes, F.col(run).eqNullSafe(F.col("_run"))).drop("_run")
        whole = [F.when(F.col("_whole"), told).otherwise(F.array().cast("array<string>"))]
    sections = rows.select(run, "job_no", F.posexplode(F.concat(body, *whole, F.array(F.lit("")))).alias("line_no", "line"))
    return overview.unionByName(sections)


def run_partition(df: DataFrame, company: str, url: str, failed: str, at: str, order: str) -> DataFrame:
    """Adds outcome, company_dir, stamp: where a run's files go; a second run of the same second gets ``_2``."""
    folder = C.formal_company(company, url)
    df = df.withColumns({"outcome": F.when(F.col(failed), "_failed").otherwise("ok"), "company_dir": folder, "_stamp": C.run_stamp(at)})
    out = collision_ordinal(df, ["outcome", "company_dir", "_stamp"], order)
    return out.withColumn("stamp", F.when(F.col("ordinal") > 1, F.concat("_stamp", F.lit("_"), F.col("ordinal").cast("string"))).otherwise(F.col("_stamp"))).drop("_stamp", "ordinal")
