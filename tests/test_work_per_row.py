"""Row-wise rules evaluate each step once: their plans do not repeat a step inside itself."""

from pyspark.sql import functions as F

from vacantia.functions import records as R
from vacantia.operators import payloads as P


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_a_payload_are_made_once(spark):
    """The plan of a nested detail does not grow with the depth that is looked at, and the answer stays."""
    text = '{"a":{"x":1},"rows":[{"id":0},{"b":{"duty":"clean","require":"water"}},{"content":"later"}]}'
    df = spark.createDataFrame([(text,), ('{"a":[{"id":1}]}',)], "t string").withColumn("v", R.parse("t"))
    found = lambda depth: df.withColumn("d", P.detail_record("v", depth))
    assert [tuple(r) for r in found(6).select("d.path", "d.state", "d.record_json").collect()] == [
        ("rows.01.b", "SUMMARY", '{"duty":"clean","require":"water"}'), (None, None, None)]
    assert len(plan(found(6))) < 1.1 * len(plan(found(3)))


def test_progress_of_a_stream_needs_no_call_per_row(spark, tmp_path, monkeypatch):
    """Seen ids are state of a dedup of the engine; an id that comes back on a smaller page of a later batch is not new."""
    from pyspark.sql import GroupedData

    from vacantia.streaming import streams as Z

    def refused(*_):
        raise AssertionError("a Python call per row")

    monkeypatch.setattr(GroupedData, "transformWithState", refused)
    rows = [[("r", 5, i % 40) for i in range(100)] + [("r", 3, 7), ("s", 3, 7)], [("r", 1, 7), ("r", 1, 99), ("r", 2, 99)]]
    schema = "run string, page int, k int"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    Z.stream_progress(stream, "run", "page", "k", str(tmp_path / "out"))
    got = {(r.batch, r.run, r.page): (r.records, r.new_ids) for r in spark.read.parquet(str(tmp_path / "out" / "pages")).collect()}
    assert got == {(0, "r", 5): (100, 39), (0, "r", 3): (1, 1), (0, "s", 3): (1, 1), (1, "r", 1): (2, 1), (1, "r", 2): (1, 0)}


def test_card_labels_are_looked_for_once(spark):
    """Each label is one search; what stands before it may hold characters of two UTF-16 units."""
    from vacantia.functions import jd as J

    duty, need = "clean \U0001F9F9 the halls " * 3, "a degree \U0001F393 in cleaning " * 2
    texts = [f"\U0001F600\t \rTitle [岗位职责] {duty}\n任职要求：{need}", f"任职要求：{need} 岗位职责：{duty}", f"岗位职责：{duty}", "岗位职责：x 任职要求：y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(J.card_sections("t").alias("s"))
    assert [tuple(r) for r in df.select("s.responsibilities", "s.requirements").collect()] == [
        (duty.strip(), need.strip()), (None, f"{need.strip()}  岗位职责：{duty}".replace("  ", " ").strip()), (None, None), (None, None), (None, None)]
    assert plan(df).count("职位职责") == 1


def test_sanitation_reads_a_text_once_by_pattern(spark):
    """Only the search for control characters goes through a whole text; it also counts them."""
    from vacantia.operators import summaries as M

    texts = ["plain", "=1", "a\x00b\x07\x7f", "x\r\ny\rz\t", "\x01=2", "", None, "é" * 32767, "é" * 32768]
    df = M.sanitize_stats(spark.createDataFrame([("r", t) for t in texts], "run string, t string"), "run", "t")
    assert tuple(df.collect()[0]) == ("r", 5, 4, 1, 2)
    assert plan(df).count("\\x7f") == 1


def test_markdown_and_csv_of_special_texts(spark):
    from vacantia.functions import export as E

    texts = ["&<>\\|#*_`\n", "=a\r\nb\rc", "+", "", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(E.md_inline("t"), E.csv_cell("t"), E.sanitize_cell("t", 100))
    assert [tuple(r) for r in df.collect()] == [
        (r"&amp;&lt;&gt;\\\|\#\*\_\` ", "&<>\\|#*_` ⏎ ", "&<>\\|#*_`\n"), ("=a\r b\rc", "'=a ⏎ b ⏎ c", "'=a\nb\nc"), ("+", "'+", "'+"), ("", "", ""), ("", "", None),
        ("plain", "plain", "plain")]
