"""Rules at any depth, at any size and in every spelling of markup."""

from pyspark.sql import functions as F

from vacantia.functions import jd as J, records as R, redact as X, text as T, urls as U
from vacantia.operators import grouping as G, identity as I, joins as JO, pages as P, reports as RP
from vacantia.sources import capture as C


def test_secrets_are_found_and_dropped_at_any_depth(spark):
    nine = '{"a":' * 9 + '{"Api-Key":{"x":1},"id":1}' + "}" * 9
    rows = [('{"list":[{"token":"x","k":1}]}', True, '{"list":[{"k":1}]}'), (nine, True, '{"a":' * 9 + '{"id":1}' + "}" * 9),
            (r'{"t":"say \"token\": 1","tokens":2}', False, r'{"t":"say \"token\": 1","tokens":2}'), ('[{"x":1}]', False, '[{"x":1}]'),
            ('"token"', False, '"token"'), (None, False, None), ("{}", False, "{}")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, j string").withColumn("v", R.parse("j"))
    got = df.select("i", R.contains_secret("v").alias("found"), F.to_json(R.safe_business_data("v")).alias("safe")).orderBy("i").collect()
    assert [(r.found, r.safe) for r in got] == [(f, s) for _, f, s in rows]
    record = df.filter("i = 0").withColumn("rec", R.as_record("v"))
    shown = record.select(X.redact_record("rec").alias("r"), F.to_json(F.to_variant_object(X.drop_sensitive("rec"))).alias("d")).first()
    assert shown.r == {"list": '[{"token":"[REDACTED]","k":1}]'} or shown.r == {"list": '[{"k":1,"token":"[REDACTED]"}]'}
    assert shown.d == '{"list":[{"k":1}]}'
    pair = spark.createDataFrame([('{"b":1,"l":[{"token":"x","k":1}]}',), ('{"l":[{"k":1}],"b":1}',)], "j string")
    assert pair.select(R.fingerprint(R.parse("j")).alias("f")).distinct().count() == 1


def test_links_in_every_spelling(spark):
    html = """<a href="/1">One</a><A class='x' HREF='/2'>T&eacute;</A><a href=/3>Three</a><a title="a>b" href="../c/789">&mdash; &#233;</a><a name=q>no</a>
    <iframe src='https://f.example/x?a=1&amp;b=2'></iframe><script src=/jobs.js></script>"""
    page = spark.createDataFrame([(1, html)], "i int, h string")
    base = F.lit("https://h.example/a/b")
    got = [(r.resolved, r.label) for r in P.extract_links(page, "h", base).orderBy("pos").collect()]
    assert got == [("https://h.example/1", "One"), ("https://h.example/2", "Té"), ("https://h.example/3", "Three"), ("https://h.example/c/789", "— é")]
    sources = {(r.source_type, r.source_url) for r in P.embedded_sources(page, "h", base).collect()}
    assert sources == {("IFRAME", "https://f.example/x?a=1&b=2"), ("EMBEDDED_WIDGET", "https://h.example/jobs.js")}


def test_references_and_dot_segments(spark):
    texts = ["a &amp;lt; &hellip; &#x1F600;&#0; &nope; &Uuml;", "plain", None, "&amp;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(T.unescape("t").alias("x")).collect()]
    assert got == ["a &lt; … 😀&#0; &nope; Ü", "plain", None, "&"]
    cases = [("https://h/a/b/x", "../c", "https://h/a/c"), ("https://h/a/b/", "./../../../q?x=../y", "https://h/q?x=../y"), ("https://h", "a/./b/..", "https://h/a/"),
             ("https://h/e", "/x/../y#../z", "https://h/y#../z"), ("https://h/e", "p/x.html", "https://h/p/x.html")]
    rows = spark.createDataFrame(cases, "b string, r string, w string")
    assert rows.filter(U.resolve("b", "r") != F.col("w")).count() == 0


def test_inferred_identity_follows_the_vocabulary(spark):
    rows = spark.createDataFrame([('{"aPostId":"7","demandCode":"D1"}',)], "j string").withColumn("v", R.parse("j"))
    assert I.job_identity(rows, "v").select("identity_value").first()[0] == "D1"


def test_recordings_that_cannot_be_read_give_a_row(spark):
    good = '{"log":{"entries":[{"request":{"method":"GET","url":"u"},"response":{"status":200,"content":{"text":"{}"}}}]}}'
    rows = spark.createDataFrame([(1, good), (2, "nope"), (3, '{"log":{"entries":[]}}'), (4, None), (5, '{"log":{}}')], "id int, h string")
    got = {r.id: (r.url, r.import_error) for r in C.har_entries(rows, "h").collect()}
    assert got == {1: ("u", None), 2: (None, "HAR_FILE_INVALID"), 4: (None, "HAR_FILE_INVALID"), 5: (None, "HAR_FILE_INVALID")}


def test_a_body_of_more_than_twenty_million_characters(spark):
    entry = '{"request":{"url":"u"},"response":{"status":200,"content":{"text":"'
    big = spark.range(1).select(F.concat(F.lit('{"log":{"entries":[' + entry), F.expr("repeat('x', 21000000)"), F.lit('"}}}]}}')).alias("h"))
    assert C.har_entries(big, "h").select(F.length("content_text")).first()[0] == 21_000_000


def test_a_late_work_mode_line_is_read(spark):
    text = "x\n" * 20_000 + "remote\n"
    df = spark.createDataFrame([(text,)], "t string")
    short = spark.createDataFrame([("x\nremote\n",)], "t string")
    assert df.select(J.work_mode("t")).first()[0] == short.select(J.work_mode("t")).first()[0] is not None


def test_running_totals_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 5), ("a", 1, 5), ("a", 2, 7), (None, 5000, 1)], "k string, o int, v int")
    got = sorted((str(r.k), r.o, r.t) for r in G.running_total(rows, "k", "o", {"t": "v"}).collect())
    assert got == [("None", 1, 5), ("None", 5000, 6), ("a", 1, 5), ("a", 2, 12)]


def test_rows_with_null_keys_are_scattered(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = G.attach_group(rows, groups, "k")
    assert out.count() == 3000 and out.filter("k is null and n is not null").count() == 0 and out.filter("k is not null and n is null").count() == 0


def test_ids_with_a_common_prefix_meet_few_holders(spark):
    ids = spark.range(2000).select(F.concat(F.lit("req-"), "id").alias("r"))
    cards = spark.range(2000).select(F.col("id").alias("c"), F.concat(F.lit("/jobs/req-"), "id", F.lit("/x")).alias("t"))
    found = JO.id_matches(ids, cards, "r", "c", F.col("t"))
    assert found.count() == 2000
    joined = [line for line in found._jdf.queryExecution().toString().splitlines() if "CartesianProduct" in line or "NestedLoop" in line]
    assert not joined


def test_reports_are_whole_unless_compact(spark):
    jobs = spark.range(60).select(F.lit("r").alias("run"), "id", *[F.lit("x").alias(c) for c in ("job_title", "job_category", "department", "recruitment_type", "detail_url", "full_jd")],
                                  F.array(F.lit("Paris")).alias("locations"))
    runs = spark.createDataFrame([("r", "Co", "p", "u", 1, 1, 1, "COMPLETE")], "run string, company string, platform string, source_url string, total_expected int, total_fetched int, total_unique int, status string")
    full = RP.report_lines(runs, jobs, "run", "id")
    assert full.filter("line = '#### Full JD'").count() == 60 and full.filter("job_no = 0").count() > 10
    assert RP.report_lines(runs, jobs, "run", "id", compact=True).filter("line = '#### Full JD'").count() == 0
