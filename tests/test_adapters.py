"""Provider adapters: routing by page, host, priority and recognised provider; both templates of the CMS list."""

from pyspark.sql import functions as F

from vacantia.operators import providers as PR
from vacantia.operators.adapters import Adapter, standard

MARK = "x stc-cms.beisen.com/CmsPortal/ y"


def routes(spark, registry, rows):
    df = spark.createDataFrame(rows, "url string, html string, provider string, confidence string")
    return [r.r for r in df.coalesce(1).select(registry.route("url", "html", "provider", "confidence").alias("r")).collect()]


def test_routes(spark):
    known = standard()
    rows = [("https://zhiye.com/a", None, None, None), ("https://a.b.zhiye.com", MARK, None, None), ("https://notzhiye.com", MARK, None, None),
            ("https://x.mokahr.com", MARK, None, None), ("https://jobs.feishu.cn", None, None, None), ("https://www.feishu.cn", None, None, None),
            ("https://x.mokahr.com", None, "Zhiye", "HIGH"), ("https://x.mokahr.com", None, "zhiye", "MEDIUM"), ("https://h", None, "unknown", "HIGH"), (None, None, None, None)]
    assert routes(spark, known, rows) == ["zhiye", "beisen_cms", "generic", "moka", "feishu", "generic", "zhiye", "moka", "generic", "generic"]
    known.register(Adapter("own", ("mokahr.com",), priority=1))
    known.register(Adapter("late", ("h",), priority=500))
    assert routes(spark, known, rows)[3] == "own" and routes(spark, known, rows)[8] == "late"
    df = spark.createDataFrame([("https://a.zhiye.com",)], "url string")
    assert df.select(known.known("url").alias("k")).first().k == "zhiye"


def test_mapped_records_by_route(spark):
    known = standard()
    for name, adapter in list(known.adapters.items()):
        known.register(Adapter(name, adapter.hosts, adapter.marks, adapter.priority, (lambda df, c: df.select(F.upper(c).alias("u"))) if name == "moka" else None))
    rows = spark.createDataFrame([("moka", "a"), ("zhiye", "b")], "route string, x string")
    assert {n: [r.u for r in d.collect()] for n, d in known.map_records(rows, "route", "x").items()} == {"moka": ["A"]}


def test_cms_lists(spark):
    pages = {"first": "共 3 条记录 <a href='/zpdetail/1' title=''><i>One</i></a><a title='Two &amp; more' href=/zpdetail/2?x=1>t</a><a href='/zpdetail/3#f'>no</a><a href='/zpdetail/4'> </a>",
             "empty": "共 0 条记录", "no links": "共 2 条记录<a href='/x'>y</a>", "no total": "<a href='/zpdetail/1'>x</a>",
             "second": "jobList /Campuslist?PageIndex=12 ?pageindex=9 <a href='/xiangqing?jobId=5' class=k><h3>Lead</h3> text</a><a href='/xiangqing?jobId=6'>bare</a>", "none": None}
    df = spark.createDataFrame(list(pages.items()), "k string, h string")
    got = {}
    for r in PR.cms_list(df, "h").collect():
        got.setdefault(r.k, []).append((r.pos, r.total, r.pages, r.position_id, r.title, r.error))
    assert got == {"first": [(0, 3, None, "1", "One", None), (1, 3, None, "2", "Two & more", None)], "empty": [(None, 0, None, None, None, None)],
                   "no links": [(None, 2, None, None, None, "LIST_JOB_LINKS_MISSING")], "no total": [(None, None, None, None, None, "LIST_TOTAL_MISSING")],
                   "second": [(0, None, 12, "5", "Lead", None)], "none": [(None, None, None, None, None, "LIST_TOTAL_MISSING")]}
