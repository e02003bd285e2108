"""Recordings, bodies, pages and scoring on small fixtures."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from vacantia.functions import records as R, score as K
from vacantia.operators import discovery as D, identity as ID, providers as PR, windows as W
from vacantia.operators.filters import usable
from vacantia.sources import capture as CAP


def entry(page, body, status=200, encoding=None, url="https://jobs.site.cn/api/position/list"):
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    if encoding == "base64":
        text = base64.b64encode(text.encode()).decode()
    content = {"text": text, **({"encoding": encoding} if encoding else {})}
    return {"request": {"method": "POST", "url": url, "postData": {"text": json.dumps({"page": page, "pageSize": 2})}}, "response": {"status": status, "content": content}}


def page_body(ids, total=4, success=True):
    return {"success": success, "result": {"total": total, "list": [{"code": i, "jobName": f"岗位{i}", "location": "上海", "postType": "x"} for i in ids]}}


def load_har(spark, tmp_path, entries):
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": entries}}, ensure_ascii=False), encoding="utf-8")
    df = CAP.exchange_params(CAP.decode_body(CAP.read_har(spark, str(tmp_path)), "content_text", "content_encoding"), "url", "body_text")
    df = D.score_exchanges(df, "url", "payload")
    good = (F.col("confidence") == "HIGH") & (F.size("reasons") == 0)
    df = df.withColumns({"n": F.when(good, F.col("list_length")).otherwise(0), "success": F.try_variant_get("payload", "$.success", "boolean")})
    df = df.withColumns({"usable": usable("status", "success", "n"), "ok": F.col("status").between(200, 299)})
    best = W.best_per_page(df, "run_id", "page", "entry_index", "usable", "ok", "n").filter("usable")
    rows = best.select("entry_index", F.posexplode(F.try_variant_get("payload", "$.result.list", "array<variant>")).alias("pos", "v"))
    return df, best, rows.select("entry_index", "pos", R.stable_id("v")["value"].alias("id"))


def test_pages_merge_and_first_id_wins(spark, tmp_path):
    _, best, rows = load_har(spark, tmp_path, [entry(1, page_body(["A", "B"])), entry(2, page_body(["B", "C"]), encoding="base64")])
    assert best.count() == 2 and rows.count() == 4
    kept = ID.dedupe_first(rows, "id", ["entry_index", "pos"]).collect()
    assert {(r.id, r.entry_index) for r in kept} == {("A", 0), ("B", 0), ("C", 1)}


def test_a_retry_that_succeeds_replaces_the_refusal(spark, tmp_path):
    _, best, rows = load_har(spark, tmp_path, [entry(1, {"success": False, "errorCode": 7}), entry(1, page_body(["A", "B"])), entry(2, page_body(["C"]), status=500)])
    assert [r.entry_index for r in best.collect()] == [1] and rows.count() == 2


def test_malformed_and_missing_bodies_are_named(spark, tmp_path):
    df, _, _ = load_har(spark, tmp_path, [entry(1, "{oops"), entry(2, ""), entry(3, '{"a":1}}'), entry(4, '{"a":1}')])
    assert [r.decode_error for r in df.orderBy("entry_index").collect()] == [
        "HAR_RESPONSE_JSON_INVALID", "HAR_RESPONSE_BODY_MISSING", "HAR_RESPONSE_JSON_INVALID", None]


STRICT = [('{"a":1}', True), ("[1,2]", True), ("5", True), ("1 2", False), ("1],[2", False), ('1},{"b":2', False), ("[1]]", False), ("", False)]


def test_strict_json(spark):
    df = spark.createDataFrame(STRICT, "t string, ok boolean").select("t", "ok", R.parse_strict("t").isNotNull().alias("got"))
    assert [(r.t, r.got) for r in df.collect()] == STRICT


def reasons(spark, url, payload):
    df = spark.createDataFrame([(url, json.dumps(payload))], "url string, j string").withColumn("payload", R.parse("j"))
    r = D.score_exchanges(df, "url", "payload").first()
    return r.score, list(r.reasons), r


REJECTED = [
    ("https://h/global-header", {"items": [{"label": "a", "url": "b"}] * 3}, "NAVIGATION_PAYLOAD"),
    ("https://h/config", {"items": [{"k": 1}] * 3}, "CONFIG_PAYLOAD"),
    ("https://h/facet/x", {"items": [{"id": 1, "name": "a"}] * 3}, "FACET_PAYLOAD"),
    ("https://h/widget", {"items": [{"id": 1, "name": "a"}] * 3}, "WIDGET_PAYLOAD"),
    ("https://h/news", {"items": [{"id": 1, "title": "a", "tag": 1}] * 3}, "CONTENT_PAYLOAD"),
    ("https://h/x", {"items": [{"id": 1, "title": "a", "banner": 1}] * 3}, "CONTENT_LIST"),
    ("https://h/x", {"items": [{"id": 1, "title": "a", "programType": 1}] * 3}, "PROGRAM_PAYLOAD"),
    ("https://h/story/1", {"items": [{"id": 1, "title": "a"}] * 3}, "NON_JOB_SEMANTIC_SOURCE"),
    ("https://h/x", {"items": [{"regionCode": 1, "regionName": "a"}] * 3}, "REGION_LIST"),
    ("https://h/x", {"items": [{"code": 1, "name": "a", "children": []}] * 3}, "REFERENCE_DATA_PAYLOAD"),
    ("https://h/x", {"items": [{"a": 1, "b": 2}, {"c": 1, "d": 2}, {"e": 1, "f": 2}]}, "MIXED_CONTENT_PAYLOAD"),
    ("https://h/x", {"items": [{"a": 1}] * 3}, "LOW_JOB_ENTITY_DENSITY"),
]


def test_rejections(spark):
    df = spark.createDataFrame([(i, u, json.dumps(p)) for i, (u, p, _) in enumerate(REJECTED)], "i int, url string, j string").withColumn("payload", R.parse("j"))
    rows = {r.i: r for r in D.score_exchanges(df, "url", "payload").select("i", "score", "reasons").collect()}
    for i, (url, _, reason) in enumerate(REJECTED):
        assert reason in rows[i].reasons and rows[i].score <= 9, (url, reason)


def test_the_job_array_wins_among_nested_arrays(spark):
    jobs = [{"id": i, "title": f"t{i}", "location": "x", "description": "d"} for i in range(6)]
    score, found, row = reasons(spark, "https://h/api/jobs/search", {"menu2": [{"a": 1}] * 30, "data": {"wrap": {"jobs": jobs, "total": 6}}})
    assert found == [] and row.list_path == "data.wrap.jobs" and row.total == 6 and row.confidence == "HIGH"


def test_a_stale_total_below_the_list_is_skipped(spark):
    df = spark.createDataFrame([('{"Total":0,"Count":9,"rows":[1,2]}',)], "j string")
    assert tuple(df.select(R.find_total(R.parse("j"), F.lit(2)).alias("t")).first().t) == ("Count", 9)


def test_a_wrong_envelope_key_opens_nothing(spark):
    df = spark.createDataFrame([('{"data":"AAAA","key":"short"}',)], "j string")
    assert df.select(R.decode_envelope(R.parse("j"), F.lit("0" * 16)).isNull().alias("x")).first().x


def test_gb18030_bytes_are_read(spark):
    rows = [(bytearray("岗位职责".encode("gb18030")), "text/html"), (bytearray("岗位".encode()), "text/html; charset=utf-8"), (bytearray("岗位".encode("gbk")), "text/html; charset=gbk")]
    df = spark.createDataFrame(rows, "b binary, ct string")
    assert [r.t for r in df.select(CAP.decode_charset("b", F.col("ct")).alias("t")).collect()] == ["岗位职责", "岗位", "岗位"]


def test_lone_surrogates_are_cut_from_bytes(spark):
    df = spark.createDataFrame([(bytearray("a".encode() + b"\xed\xa0\x80" + "b😀".encode()),)], "b binary")
    assert df.select(CAP.safe_text("b").alias("t")).first().t == "ab😀"


def test_states_come_in_source_order(spark):
    html = ('<script>window.__INITIAL_STATE__ = {"jobs":[{"id":1,"t":"} {"}]};</script><script type="application/json">{"a":1}</script>'
            '<script>window.__NUXT__=(function(){return {}})()</script><script id="__NEXT_DATA__">{"b":2}</script><script type="application/json">{bad}</script>')
    rows = CAP.embedded_states(spark.createDataFrame([(1, html)], "id int, html string"), "html").select("source_index", F.to_json("state").alias("s")).collect()
    assert [(r.source_index, r.s) for r in rows] == [(0, '{"a":1}'), (1, '{"b":2}'), (2, '{"jobs":[{"id":1,"t":"} {"}]}')]


def test_identity_cascade(spark):
    records = [{"x": {"requisitionId": "R1"}, "jobId": "J1"}, {"jobId": "J2", "id": 3}, {"id": 4}, {"wrap": {"positionCode": "z", "demandCode": "D5"}}, {"name": "n"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "j string").withColumn("v", R.parse("j"))
    got = ID.job_identity(df, raw="v", url=F.lit("https://h/about"), title=F.lit("t")).collect()
    assert [(r.identity_source, r.identity_value) for r in got][:4] == [
        ("REQUISITION_ID", "R1"), ("JOB_POSTING_ID", "J2"), ("STABLE_API_ID", "4"), ("STABLE_API_ID", "D5")]
    assert got[4].identity_source == "COMPOSITE_FINGERPRINT" and len(got[4].identity_value) == 24


def test_bare_code_needs_job_context(spark):
    df = spark.createDataFrame([(["code", "name"],), (["code", "name", "city"],), (["demandcode", "jobname"],)], "k array<string>")
    assert [list(r.x) for r in df.select(K.id_keys("k").alias("x")).collect()] == [[], ["code"], ["demandcode"]]


def test_list_payload_errors(spark):
    cases = [("moka", '{"success":false,"data":{}}', "API_ERROR"), ("moka", '{"data":{"jobs":[],"jobStats":{}}}', "INVALID_RESPONSE"), ("feishu", '{"data":{"count":1}}', "LIST_SCHEMA_INVALID"),
             ("feishu", '{"code":3}', "LIST_API_ERROR"), ("zhiye", '{"x":1}', "UNSUPPORTED_LIST_STRUCTURE"), ("zhiye", '{"Data":{"records":[{}]},"Total":1}', None)]
    for provider, text, want in cases:
        df = spark.createDataFrame([(text,)], "j string")
        assert df.select(PR.list_payload(R.parse("j"), provider)["error"].alias("e")).first().e == want, (provider, text)
