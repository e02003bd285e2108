"""Generic job builder: one dynamic record in, one job row (or a rejection) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab as V
from ..functions import jd as J, records as R
from ..functions.text import c, lines
from .grouping import fence
from .identity import job_identity


JOB_COLUMNS = ["job_id", "job_title", "reject_reason", "company", "locations", "department", "job_category", "recruitment_type", "education",
               "major", "recruitment_scopes", "headcount", "responsibilities", "requirements", "full_jd", "jd_state", "detail_url", "apply_url",
               "identity_source", "identity_value", "identity_field"]


def build_jobs(df: DataFrame, v: str, company=None, id_field: str | None = None, title_field: str | None = None,
               url_field: str | None = None, detail_template: str | None = None, scope_type=None) -> DataFrame:
    """Adds the job columns; reject_reason says why a record is not a job."""
    ids = ([id_field] if id_field else []) + V.RECORD_ID_FIELDS
    titles = ([title_field] if title_field else []) + V.RECORD_TITLE_FIELDS
    df = df.withColumn("_r", R.as_record(v))
    get = lambda k: R.get("_r", k)
    some = lambda keys: F.coalesce(*[F.when(~R.is_blank_value(get(k)), get(k)) for k in keys])
    df = df.withColumns({
        "job_id": R.resolve(v, ids), "_title": R.resolve(v, titles), "_place": some(V.RECORD_LOCATION_FIELDS),
        "_jd": J.pick_jd("_r"),
        "detail_url": R.first_text("_r", ([url_field] if url_field else []) + V.RECORD_URL_FIELDS),
    })
    if detail_template:
        df = df.withColumn("detail_url", F.coalesce("detail_url", F.replace(F.lit(detail_template), F.lit("{id}"), F.col("job_id"))))
    flat_title = R.first_text("_r", [n for n in titles if "." not in n])
    listed = F.filter(F.transform(R.as_array("_place"), R.text_of), lambda x: x.isNotNull())
    single = R.text_of("_place")
    places = F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), F.expr(R.NO_STRINGS))
    named = lambda *paths: F.coalesce(*[R.only_text(R.path_get(v, p)) for p in paths])
    split = J.split_jd("full_jd")
    jd = F.col("_jd")
    df = df.withColumns({
        "job_title": F.when(F.coalesce(flat_title, F.col("_title")) != "", F.coalesce(flat_title, F.col("_title"))),
        "locations": F.when(F.size(places) > 0, places).otherwise(R.district_locations("_r")),
        "department": R.text_of(some(["_generic_department", "department", "team"])),
        "job_category": F.coalesce(named("job_function.name", "function.name"), R.text_of(some(["category", "function", "recruitCategoryName"]))),
        "recruitment_type": F.coalesce(named("recruit_type.parent.name", "recruit_type.name"),
                                       c(scope_type) if scope_type is not None else F.lit(None).cast("string"),
                                       R.only_text(get("recruitment_type_cn")), R.only_text(get("nature_cn"))),
        "education": F.coalesce(R.only_text(get("education_cn")), R.only_text(get("education"))),
        "major": F.coalesce(*[F.when(F.size(R.readable_list(get(k))) > 0, R.readable_list(get(k))) for k in ("major_cn", "major")]),
        "recruitment_scopes": R.readable_list(get("_generic_source_scopes")),
        "headcount": R.positive_headcount(get("amount")),
        "company": F.coalesce(R.raw_company("_r"), c(company) if company is not None else F.lit(None).cast("string")),
        "full_jd": J.canonical_jd("_jd"), "jd_state": jd["state"],
    })
    df = df.withColumn("_split", split)
    df = df.withColumns({
        "responsibilities": F.coalesce(lines(jd["responsibilities"]), lines(jd["description"]), F.expr(R.NO_STRINGS)),
        "requirements": F.coalesce(lines(jd["requirements"]), F.col("_split.requirements"), F.expr(R.NO_STRINGS)),
        "apply_url": F.col("detail_url"),
        "reject_reason": F.when(F.col("job_id").isNull(), "ID_NOT_MAPPED").when(F.col("job_title").isNull(), "TITLE_NOT_MAPPED"),
    })
    df = job_identity(df, raw=v, url="detail_url", title="job_title", location=F.array_join("locations", "|"),
                      department="department", company="company")
    return fence(df.drop("_r", "_title", "_place", "_jd", "_split"), JOB_COLUMNS)


def enrichment_stats(df: DataFrame, before: str, after: str, status: str) -> DataFrame:
    """One row of outcomes of an enrichment pass."""
    s = F.col(status)
    n = F.count_if
    return df.agg(
        F.count("*").alias("attempted"), n(~s.isin("BINDING_MISMATCH", "EXTRACTION_FAILED")).alias("succeeded"),
        n(s.isin("BINDING_MISMATCH", "EXTRACTION_FAILED")).alias("failed"), n(s == "SOURCE_REQUIREMENTS_ABSENT").alias("source_absent"),
        n(s.isin("REQUIREMENTS_FILLED", "ENRICHED")).alias("requirements_filled"),
        n(s.isin("RESPONSIBILITIES_IMPROVED", "ENRICHED")).alias("responsibilities_improved"),
        n(s == "BINDING_MISMATCH").alias("binding_mismatch"), n(F.size(before) > 0).alias("requirements_before"),
        n(F.size(after) > 0).alias("requirements_after"))
