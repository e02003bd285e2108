"""What a task holds, and what a checkpoint writes, does not grow with the table."""

from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from vacantia.sources import sinks
from vacantia.streaming.keyed import Windows


def test_python_gets_bounded_batches(spark):
    """A partition of many rows, and one of few large rows, comes in parts."""
    size = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
    rows = spark.range(0, 5000, 1, 1)
    assert rows.select(size("id").alias("n")).agg(F.max("n")).first()[0] <= 500


def test_a_checkpoint_of_many_runs_has_few_files(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("run"), "id").alias("run_id"), F.col("id").alias("job_id"), F.lit("x").alias("state"))
    sinks.write_checkpoint(rows, str(tmp_path / "c"))
    sinks.write_checkpoint(rows.filter("job_id < 2").withColumn("state", F.lit("y")), str(tmp_path / "c"))
    assert len(list(Path(tmp_path / "c" / "data").rglob("*.json"))) <= 32
    read = sinks.read_checkpoint(spark, str(tmp_path / "c"), "job_id long, state string")
    assert {(r.state, r["count"]) for r in read.groupBy("state").count().collect()} == {("x", 598), ("y", 2)}


def test_observed_seconds_round_half_up():
    assert Windows(7_200_000_000, 28_800_000_000).described((0, 5_234_320_500, 2), 1)[3] == 5234.321
