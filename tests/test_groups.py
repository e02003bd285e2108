"""Group building blocks against brute force, with one group holding a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import grouping as G, identity as ID, windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(400)}", i, rng.randrange(50)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v bigint").repartition(8).cache()


def test_first_by_keeps_the_first_row(skewed):
    rows, df = skewed
    want = {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, (pos, v))
    got = {r.k: (r.pos, r.v) for r in G.first_by(df, "k", "pos").collect()}
    assert got == want


def test_attach_group_serves_hot_and_cold_groups(skewed):
    rows, df = skewed
    sizes = {}
    for k, _, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    got = G.attach_group(df, groups, "k").collect()
    assert len(got) == len(rows) and all(r.n == sizes[r.k] for r in got)


def test_attach_group_keeps_rows_without_a_group(spark, skewed):
    _, df = skewed
    groups = df.filter("k <> 'hot'").groupBy("k").agg(F.count("*").alias("n"))
    got = G.attach_group(df, groups, "k")
    assert got.count() == df.count() and got.filter("k = 'hot' and n is not null").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000, 100000])
def test_running_total_equals_a_plain_scan(skewed, block):
    rows, df = skewed
    total, want = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[pos] = total[k]
    got = {r.pos: r.s for r in G.running_total(df, "k", "pos", {"s": "v"}, block=block).collect()}
    assert got == want


def test_modal_takes_the_smallest_value_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", 5), ("c", None)], "k string, v int")
    assert {r.k: (r.v, r.n) for r in G.modal(df, "k", "v").collect()} == {"a": (1, 2), "b": (5, 1)}


def test_dedup_is_idempotent(skewed):
    _, df = skewed
    once = ID.dedupe_first(df, "k", "pos")
    assert sorted(once.collect()) == sorted(ID.dedupe_first(once, "k", "pos").collect())


def test_throughput_looks_twelve_samples_back(spark):
    rows = [("r", i, float(i * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "run string, id bigint, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1000000).cast("bigint")))
    got = {r.id: r.rate for r in W.throughput(df, "run", "at", "id", F.lit(100), block_seconds=50).collect()}
    for i in range(40):
        first = max(0, i - 11)
        span = i * i - first * first
        want = (i - first) / span if i >= 4 and span >= 10 else None
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9), i


def test_peak_concurrency_counts_overlaps(spark):
    df = spark.createDataFrame([("r", 0, 10), ("r", 5, 8), ("r", 8, 12), ("r", 20, 30), ("s", 1, 2)], "run string, a bigint, b bigint")
    df = df.select("run", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    assert {r.run: r.peak for r in W.peak_concurrency(df, "run", "a", "b", block_seconds=3).collect()} == {"r": 2, "s": 1}
