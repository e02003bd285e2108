"""Details at any depth."""

import json

from pyspark.sql import functions as F

from vacantia.functions import records as R
from vacantia.operators import payloads as P

TEXT = (4 * "Responsibilities: build and run data pipelines for the team every day.\nRequirements: five years of Python, SQL and Spark in production, and clear writing.\n").strip()


def nested(levels, leaf):
    for i in range(levels):
        leaf = {"a": leaf, "b": {"n": i}} if i % 2 else {"a": [{"n": i}, leaf]}
    return leaf


def test_details_at_depths_beyond_the_expressions(spark):
    rows = [(n, json.dumps(nested(n, {"jobTitle": "Engineer", "description": TEXT}))) for n in (2, 5, 7, 8, 12, 30)] + [(0, '{"x":{"y":1}}')]
    df = spark.createDataFrame(rows, "n int, j string").withColumn("state", R.parse("j"))
    got = {r.n: r.d for r in df.select("n", P.detail_record("state").alias("d")).collect()}
    assert got.pop(0).path is None
    for n, d in got.items():
        want = ".".join(x for i in reversed(range(n)) for x in (["a"] if i % 2 else ["a", "01"]))
        assert d.path == want and json.loads(d.record_json)["description"] == TEXT
    states = df.select("n", "state", F.lit(1).alias("source_index"), F.lit("Engineer").alias("expected"))
    assert {r.n: r.full_jd for r in P.embedded_detail(states, "n", "expected").collect()} == dict.fromkeys((2, 5, 7, 8, 12, 30), TEXT)
