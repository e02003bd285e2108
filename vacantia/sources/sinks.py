"""File sinks and checkpoints.  Writers hand the work to Spark's committers; nothing passes the driver.

Rows are rebalanced by folder before a partitioned write: few files per folder, and a large folder is still
split over many tasks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab as V
from ..operators.reports import csv_rows

CHECKPOINT_FORMAT = "vacantia-jd-checkpoint-v1"


def write_jobs_json(jobs: DataFrame, path: str) -> None:
    """One JSON document per job."""
    jobs.write.mode("overwrite").json(path)


def write_jobs_csv(jobs: DataFrame, path: str) -> None:
    """The export rows; the byte-order mark is part of the first header so sheets open the file as UTF-8.

    Rows are rebalanced first, so no file holds a header only.  Every file is a whole table with mark and header;
    to join files, keep those of the first."""
    rows = csv_rows(jobs)
    marked = rows.withColumnRenamed(V.CSV_HEADERS[0], "﻿" + V.CSV_HEADERS[0])
    marked.hint("rebalance").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_rows_json(rows: DataFrame, path: str) -> None:
    """Summary or error rows as JSON lines; without rows only the commit marker is written."""
    rows.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, run: str, path: str) -> None:
    """Report lines as text under one folder per run, in order."""
    ordered = lines.repartitionByRange(run, "job_no", "line_no").sortWithinPartitions(run, "job_no", "line_no")
    ordered.select(F.col("line").alias("value"), run).write.mode("overwrite").partitionBy(run).text(path)


def write_layout(rows: DataFrame, path: str, format_: str = "parquet") -> None:
    """Rows that carry outcome, company_dir, stamp into the run folder layout."""
    rows.hint("rebalance", "outcome", "company_dir", "stamp").write.mode("append").partitionBy("outcome", "company_dir", "stamp").format(format_).save(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _commits(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """(version, not whole, folder) of the commits since the last whole one, in order: one empty file each, which says it by its name."""
    files, make = _files(spark, path)
    folder = make(f"{path}/commits")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName().split(".") for f in files.listStatus(folder)]
    found = sorted((int(n[0]), n[2] != "whole", n[1]) for n in names if n[0].isdigit())
    start = max([c for c in found if not c[1]], default=(0,))
    return [c for c in found if c >= start]


def _commit(rows: DataFrame, path: str, whole: bool = False) -> None:
    """Write rows as a new version and commit it.

    The rows go to a folder of their own, in few files however many runs there are; when they are complete, the creation of one empty file, whose name holds the
    version and the folder, lets readers see them all.  Versions of writers at the same time count in order of folders."""
    spark = rows.sparkSession
    files, make = _files(spark, path)
    folder = uuid.uuid4().hex
    rows.hint("rebalance", "run_id").write.json(f"{path}/data/{folder}")
    version = 1 + max((c[0] for c in _commits(spark, path)), default=0)
    files.createNewFile(make(f"{path}/commits/{version:012d}.{folder}.{'whole' if whole else 'part'}"))


def write_checkpoint(states: DataFrame, path: str) -> None:
    """Replace the checkpoint of exactly the runs present.

    The rows become a version of the checkpoint that counts from its commit on; until then, and if the write fails,
    readers see the old state."""
    _commit(states.withColumn("format", F.lit(CHECKPOINT_FORMAT)), path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Checkpoint rows, each run from the last version that holds it; a row of another format fails the read with CHECKPOINT_UNSUPPORTED."""
    kind = f"{schema}, format string, run_id string"
    parts = [spark.read.schema(kind).json(f"{path}/data/{c[2]}").withColumn("_version", F.lit(n)) for n, c in enumerate(_commits(spark, path))]
    if not parts:
        return spark.createDataFrame([], f"{schema}, run_id string")
    rows = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        # a row per run
        last = rows.groupBy("run_id").agg(F.max("_version").alias("_last"))
        rows = rows.join(last.withColumnRenamed("run_id", "_run"), (F.col("run_id").eqNullSafe(F.col("_run"))) & (F.col("_version") == F.col("_last"))).drop("_run", "_last")
    ok = F.col("format").eqNullSafe(CHECKPOINT_FORMAT)
    checked = F.when(ok, F.col("format")).otherwise(F.raise_error(F.lit("CHECKPOINT_UNSUPPORTED")).cast("string"))
    return rows.withColumn("format", checked).filter(F.col("format").isNotNull()).drop("format", "_version")


def merge_checkpoint(spark: SparkSession, path: str, schema: str) -> None:
    """Write the present state as one whole version, from which readers start; older folders are no longer read."""
    _commit(read_checkpoint(spark, path, schema).withColumn("format", F.lit(CHECKPOINT_FORMAT)), path, whole=True)
