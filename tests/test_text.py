"""Job-description, company and redaction rules on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia import vocab as V
from vacantia.functions import company as C, export as E, jd as J, records as R, redact as X, text as T, urls as U


def many(spark, values, expr):
    """Results of one expression over many values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expr.alias("r")).collect()
    return [r.r for r in sorted(rows)]


def one(spark, value, expr, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(expr.alias("r")).first().r


@pytest.mark.parametrize("text,want", [
    ("Responsibilities:\nbuild\nship\nRequirements\nknow", (["build", "ship"], ["know"])),
    ("## 岗位职责：\na\n任职要求 (必读)\nb\n任职条件\nc", (["a"], ["b", "c"])), ("nothing here", ([], [])), ("Requirements\nonly", ([], ["only"])),
])
def test_split_jd(spark, text, want):
    r = one(spark, text, J.split_jd("x"))
    assert (list(r.responsibilities), list(r.requirements)) == want


def test_html_is_flattened_before_splitting(spark):
    r = one(spark, "<h3>岗位职责</h3><p>写<b>代码</b></p><script>x</script><h3>任职要求</h3><ul><li>会 Python</li></ul>", J.jd_sections("x"))
    assert (list(r.responsibilities), list(r.requirements)) == (["写代码"], ["会 Python"])


@pytest.mark.parametrize("text,want", [("1、甲；2、乙。3、丙", ["1、甲；", "2、乙。", "3、丙"]), ("a\n\n b ", ["a", "b"]), ("  ", []), ("just prose；more", ["just prose；more"])])
def test_split_items(spark, text, want):
    assert list(one(spark, text, J.split_items("x"))) == want


def test_recognised_state(spark):
    cases = [({"content": "short"}, "SUMMARY"), ({"content": "x" * 500}, "FULL_TEXT"), ({"duty": "a", "require": "b"}, "SUMMARY"), ({"Duty": "a" * 30, "REQUIRE": "b" * 30}, "SPLIT"),
             ({"requireLogin": "yes", "contentStatus": "1"}, "ABSENT"), ({"description": {"text": "岗位职责 ... 任职要求"}}, "FULL_TEXT"), ({"positionDto": {"duty": "d"}}, "SPLIT"), ({"description": "t", "requirements": "r"}, "FULL_TEXT")]
    assert many(spark, [json.dumps(r) for r, _ in cases], J.pick_jd(R.as_record(R.parse("x")))["state"]) == [w for _, w in cases]


def test_canonical_jd_keeps_halves_not_in_the_description(spark):
    rec = {"description": "All of it: Build Things", "responsibilities": "build  things", "requirements": "know"}
    df = spark.createDataFrame([(json.dumps(rec),)], "x string").withColumn("p", J.pick_jd(R.as_record(R.parse("x"))))
    assert df.select(J.canonical_jd("p").alias("r")).first().r == "All of it: Build Things\n\n任职要求\nknow"


def test_the_two_credibility_rules_differ(spark):
    teaser = "岗位职责 任职要求"
    assert one(spark, teaser, J.credible_body("x")) is True and one(spark, teaser, J.credible_jd("x")) is False
    junk = ("related jobs share this job " * 10)[:200]
    assert one(spark, junk, J.credible_jd("x")) is False and one(spark, "y " * 300, J.credible_jd("x")) is True


def test_site_company(spark):
    cases = [("https://careers.pddglobalhr.com/x", "拼多多集团"), ("https://job.byd.com", "比亚迪"), ("https://coscoshipping.iguopin.com/a", "Coscoshipping"), ("https://www.mokahr.com/", None),
             ("https://example.com", None), ("careers.firm.co.uk", "Firm"), ("https://m.acme.cn/jobs", "Acme"), ("localhost", None), ("https://123.com", None), ("", None)]
    assert many(spark, [u for u, _ in cases], C.infer_site_company("x")) == [n for _, n in cases]


@pytest.mark.parametrize("title,name", [("加入思格新能源", "思格新能源"), ("Jobs at Sigenergy", "Sigenergy"), ("Careers", None), ("A | B", None), ("x" * 31, None)])
def test_company_from_title(spark, title, name):
    assert one(spark, title, C.company_from_title("x")) == name


@pytest.mark.parametrize("key,secret,trace", [("token", True, False), ("api_key", True, False), ("apiKey", False, False), ("Session-Id", True, False), ("monkey", False, False), ("x-trace-id", False, True)])
def test_secret_keys(spark, key, secret, trace):
    assert one(spark, key, X.is_sensitive("x")) is secret and one(spark, key, X.is_ephemeral("x")) is trace


def test_secret_text_is_masked(spark):
    assert one(spark, 'set Token: abc and aesIv=zz done', X.mask_secrets("x")) == "set Token=[REDACTED] and aesIv=[REDACTED] done"


def test_cells_are_safe(spark):
    assert one(spark, "\x07=1+1\r\nx\ty", E.sanitize_cell("x")) == "'=1+1\nx\ty"
    assert one(spark, "-" + "a" * 40000, E.sanitize_cell("x")) == "'-" + "a" * 40000
    long = one(spark, "-" + "a" * 40000, E.sanitize_cell("x", V.CELL_LIMIT))
    assert len(long) == 32768 and long.startswith("'-") and long.endswith("...[TRUNCATED]")
    assert one(spark, "+a\nb", E.csv_cell("x")) == "'+a ⏎ b" and one(spark, "plain\n=b", E.csv_cell("x")) == "plain ⏎ =b"
    assert one(spark, "a|b <i> \\ `c`\nd", E.md_inline("x")) == "a\\|b &lt;i&gt; \\\\ \\`c\\` d"


@pytest.mark.parametrize("base,ref,want", [
    ("https://h/a/b?q=1#f", "c", "https://h/a/c"), ("https://h/a/b", "/c", "https://h/c"), ("https://h/a?x=1", "?y=2", "https://h/a?y=2"), ("https://h/a#z", "#n", "https://h/a#n"),
    ("https://h", "c", "https://h/c"), ("http://h/a", "//o/p", "http://o/p"), ("https://h/a", "mailto:x", "mailto:x"),
])
def test_resolve(spark, base, ref, want):
    row = spark.createDataFrame([(base, ref)], "b string, r string").select(U.resolve("b", "r").alias("u")).first()
    assert row.u == want


def test_field_inference_prefers_exact_then_vocabulary_then_short(spark):
    got = lambda keys, role: one(spark, keys, T.infer_field("x", role), "array<string>")
    assert got(["postName", "name", "x"], "title") == "name" and got(["postId", "jobId"], "id") == "jobId" and got(["myJobId", "aPostId"], "id") == "aPostId"
    assert got(["superLongJobId", "bJobId", "aJobId"], "id") == "aJobId" and got(["foo"], "id") is None
