"""Streaming forms of the live-capture rules: dedup, quiet periods, progress, throughput, snapshots.

Each ``stream_*`` function takes a streaming DataFrame.  The transformations also run on batch input, so a
stream and a backfill share one definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab as V
from ..session import shared_folder
from .keyed import QuietPeriods, window_scan


def dedupe(df: DataFrame, keys, event_time: str, delay: str) -> DataFrame:
    """First arrival of every stable id; ids are remembered until the watermark passes them."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def quiet_periods(df: DataFrame, run: str, event_time: str, delay: str, gap: float, min_seconds: float, max_seconds: float) -> DataFrame:
    """Observation windows of a run and how they ended; ``gap``, minimum and maximum in seconds.

    A window ends when nothing happens for the gap (QUIET, or BELOW_MINIMUM when it was watched too short), or at the
    maximum, even if activity goes on (MAX_OBSERVATION); what comes then opens the next window.  A stream keeps the open
    window of each run and closes it by an event-time timer; a table is scanned once per run, in order of time.  Rows
    without a time take no part, a null run is a run."""
    shortest, quiet, longest = (round(x * 1_000_000) for x in (min_seconds, gap, max_seconds))
    kind = df.schema[run].dataType.simpleString()
    schema = f"{run} {kind}, first_at timestamp, last_at timestamp, activities long, observed_seconds double, ended_by string"
    time = F.unix_micros(F.col(event_time).cast("timestamp"))
    rows = df.filter(F.col(event_time).isNotNull())
    if not df.isStreaming:
        ordered = rows.select(run, time.alias("time")).repartition(run).sortWithinPartitions(run, "time")
        return ordered.mapInArrow(window_scan(shortest, quiet, longest), schema)
    marked = rows.withWatermark(event_time, delay).select(run, event_time, time.alias("time"))
    return marked.groupBy(run).transformWithState(QuietPeriods(run, shortest, quiet, longest), schema, "append", "EventTime")


def sliding_throughput(df: DataFrame, run: str, event_time: str, delay: str, width: str, slide: str, stalled_below: int) -> DataFrame:
    """Completions per sliding window and whether the run has stalled."""
    marked = df.withWatermark(event_time, delay) if df.isStreaming else df
    counts = marked.groupBy(F.window(event_time, width, slide).alias("w"), run).agg(F.count("*").alias("done"))
    return counts.select(run, F.col("w.start").alias("window_start"), "done", (F.col("done") <= stalled_below).alias("stalled"))


def drain(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over everything available into a table and read the table back."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def stream_progress(df: DataFrame, run: str, page: str, key: str, folder: str) -> None:
    """Pages of a stream with their new ids: a page without new ids ends its run.

    Seen ids are the state of a streaming dedup, keyed by run and id, so a batch looks up the ids it holds and nothing
    else, and one long run is spread over all tasks.  The ids that the dedup lets through are new; the smallest page that
    holds one in its batch gets it.  A batch writes its own partition of ``folder``/pages, so a repeated batch after a
    failure gives the same rows.  A row without a page counts for page -1."""
    rows = df.select(F.col(run).alias("run"), F.col(key).alias("id"), F.coalesce(F.col(page).cast("bigint"), F.lit(-1)).alias("page"))
    fresh = rows.select("run", "id").dropDuplicates(["run", "id"]).select("run", "id", F.lit(None).cast("bigint").alias("page"), F.lit(True).alias("new"))

    def advance(rows: DataFrame, batch: int) -> None:
        # one pass, as a batch may read its state once: a row counts for its id, and for its page
        part = lambda by_id, name, at, first, new, records: F.struct(
            F.lit(by_id).alias("by_id"), name.alias("id"), at.alias("at"), first.alias("first"), new.alias("new"), F.lit(records).alias("records"))
        none = lambda x: F.when(F.lit(False), x)
        of_id = part(True, F.col("id"), none(F.col("page")), F.col("page"), F.col("new"), 0)
        of_page = part(False, none(F.col("id")), F.col("page"), none(F.col("page")), F.lit(False), 1)
        told = rows.select("run", F.inline(F.when(F.col("new"), F.array(of_id)).otherwise(F.array(of_id, of_page))))
        known = told.groupBy("run", "by_id", "id", "at").agg(F.min("first").alias("first"), F.max("new").alias("new"), F.sum("records").alias("records"))
        pages = known.groupBy(F.col("run").alias(run), F.coalesce("at", "first").alias(page)).agg(
            F.sum("records").alias("records"), F.count_if("new").alias("new_ids"))
        pages.withColumn("no_progress", F.col("new_ids") == 0).write.mode("overwrite").parquet(f"{folder}/pages/batch={batch}")

    both = rows.withColumn("new", F.lit(False)).unionByName(fresh)
    query = both.writeStream.foreachBatch(advance).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def snapshot_states(df: DataFrame, run: str, key: str, state: str, order: str, folder: str, merge_every: int = 50) -> None:
    """Latest state per task, kept as keyed state; every batch writes the tasks that it changed.

    A batch replaces its own folder, so a repeated batch writes the same rows again.  After every ``merge_every`` batches
    the changes so far are merged into one table, which counts from its commit marker on; readers start there."""
    latest = df.groupBy(run, key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order), F.count("*").alias("updates"))

    def advance(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
        if (batch + 1) % merge_every == 0:
            latest_snapshot(rows.sparkSession, folder, batch).write.mode("overwrite").parquet(f"{folder}/merged/batch={batch}")

    query = latest.writeStream.foreachBatch(advance).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed batches below a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    found = [f.getPath() for f in files.listStatus(target)]
    whole = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().removeprefix("batch=")) for f in whole)


def latest_snapshot(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """State of every task after the last committed batch, or after the given one: the last merged table and the changes since.

    A task's updates only grow, so its last change is the one with the most."""
    merged = [b for b in _batches(spark, f"{folder}/merged") if batch is None or b < batch]
    changes = [b for b in _batches(spark, f"{folder}/changes") if b > max(merged, default=-1) and (batch is None or b <= batch)]
    parts = [f"{folder}/merged/batch={b}" for b in merged[-1:]] + [f"{folder}/changes/batch={b}" for b in changes]
    rows = spark.read.parquet(*parts)
    keys = rows.columns[:2]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns[2:]), "updates").alias("_s"))
    return last.select(*keys, "_s.*")


def earned_snapshots(states: DataFrame, run: str, every: int = 10) -> DataFrame:
    """How many snapshots each run has earned: one for every so many updates."""
    return states.groupBy(run).agg(F.floor(F.sum("updates") / every).alias("snapshots"))
