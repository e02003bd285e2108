"""Queries against their SQL on texts that the small tables lack."""

import duckdb
from oracle_check import compare
from pyspark.sql import functions as F

from vacantia.operators import joins as JO, reports as RP
from vacantia.plans import load


def test_titles_bind_whatever_their_capitals(spark):
    """``ß`` has the capitals ``SS``; the same title in capitals is no mismatch."""
    df = spark.createDataFrame([("1", "Große Straße", "1", "GROSSE STRASSE 2"), ("1", "Koch", "1", "Maler")], "j string, jt string, d string, dt string")
    assert [r.b for r in df.select(JO.binding("j", "jt", "d", "dt").alias("b")).collect()] == [None, "TITLE_MISMATCH"]


def test_page_companies_equal_their_sql(spark, tmp_path):
    """Titles with references, and a page without markup."""
    titles = ["a | b | say &quot;x&quot;", "Acme &#39;x", "Acme&nbsp;Co", "A &amp; B", "x &lt; y &amp;quot;", "plain", "cut &quo"]
    rows = [(i, "u", f"<title>{x}</title>") for i, x in enumerate(titles)] + [(99, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(spark, con, load()["page_companies"], str(tmp_path)) is None


def test_reports_choose_by_the_size_of_the_run(spark):
    texts = ("job_title", "job_category", "department", "recruitment_type", "detail_url", "full_jd")
    jobs = spark.range(101).select(F.when(F.col("id") < 51, "big").when(F.col("id") < 100, "small").alias("run"), "id", *[F.lit("x").alias(c) for c in texts], F.array(F.lit("Paris")).alias("locations"))
    heads = ("company", "platform", "source_url", "total_expected", "total_fetched", "total_unique", "status")
    runs = jobs.select("run").distinct().select("run", *[F.lit("1").alias(c) for c in heads])
    told = RP.report_lines(runs, jobs, "run", "id", compact=None).filter("line = '#### Full JD'").groupBy("run").count()
    assert {(r.run, r["count"]) for r in told.collect()} == {("small", 49), (None, 1)}
