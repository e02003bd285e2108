"""Ordered operators: best per page, batch audit, page progress, throughput, concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions.text import c
from .grouping import attach_group, first_by, names, running_total


def best_per_page(df: DataFrame, run: str, page: str, index: str, usable: str, status_ok: str, list_count: str) -> DataFrame:
    """Best attempt of each logical page: usable, 2xx, longest list, latest.  Rows without a page stand alone.

    The key is the page number only, never the address."""
    key = F.coalesce(F.col(page).cast("string"), F.concat(F.lit("index"), F.col(index).cast("string")))
    keyed = df.withColumn("page_key", key)
    return first_by(keyed, names(run) + ["page_key"], [F.col(usable), F.col(status_ok), F.col(list_count), F.col(index)], last=True)


def batch_audit(batches: DataFrame, run: str, batch: str, ids: str) -> DataFrame:
    """Per batch: unique, new and cumulative ids, ids seen in earlier batches, ordered and set digests.

    A batch is one captured response, so its id list is one row's array; everything across batches is
    aggregated by id."""
    distinct = F.array_distinct(ids)
    rows = batches.select(run, batch, F.size(ids).alias("records"), F.size(distinct).alias("unique_ids"),
                          F.sha2(F.array_join(ids, "\x1f"), 256).alias("ordered_ids_hash"),
                          F.sha2(F.array_join(F.array_sort(distinct), "\x1f"), 256).alias("set_ids_hash"))
    first = batches.select(run, batch, F.explode(distinct).alias("_id")).groupBy(run, "_id").agg(F.min(batch).alias(batch))
    new = first.groupBy(run, batch).agg(F.count("*").alias("new_unique_ids"))
    out = rows.join(new, [run, batch], "left").withColumns({
        "new_unique_ids": F.coalesce("new_unique_ids", F.lit(0)), "unique_ids": F.col("unique_ids").cast("bigint"), "records": F.col("records").cast("bigint")})
    out = out.withColumn("cross_batch_duplicates", F.col("unique_ids") - F.col("new_unique_ids"))
    return running_total(out, run, batch, {"cumulative_unique": "new_unique_ids", "cumulative_records": "records"})


def page_progress(audit: DataFrame, run: str, page: str, total, has_more, cursor_seen, page_size, max_pages: int,
                  count_raw: bool = False) -> DataFrame:
    """Adds stop_reason of every page; null while the run should go on."""
    reached = F.col("cumulative_records") if count_raw else F.col("cumulative_unique")
    size, more = c(page_size), c(has_more)
    open_total = c(total).isNotNull() & (F.col("cumulative_unique") < c(total)) & (F.col("new_unique_ids") > 0)
    reason = (F.when(c(total).isNotNull() & (reached >= c(total)), "TOTAL_REACHED").when(F.coalesce(~more, F.lit(False)), "HAS_MORE_FALSE")
              .when(F.col("records") == 0, "EMPTY_PAGE").when(F.coalesce(c(cursor_seen), F.lit(False)), "CURSOR_EXHAUSTED")
              .when(F.col("new_unique_ids") == 0, "NO_NEW_UNIQUE_JOBS").when((size > 0) & (F.col("records") < size) & ~open_total, "SHORT_PAGE")
              .when(F.col(page) + 1 >= max_pages, "MAX_PAGES"))
    return audit.withColumn("stop_reason", reason)


def stop_pages(progress: DataFrame, run: str, page: str) -> DataFrame:
    """First page of each run with a reason to stop."""
    return progress.filter("stop_reason is not null").groupBy(run).agg(
        F.min(page).alias("stop_page"), F.min_by("stop_reason", page).alias("stop_reason"))


def total_drift(pages: DataFrame, run: str, page: str, total: str) -> DataFrame:
    """Pages that state another total than the run's first page."""
    base = pages.groupBy(run).agg(F.min_by(total, page).alias("baseline"), F.count("*").alias("_size"))
    rows = attach_group(pages.select(run, page, total), base, run)
    return rows.filter(F.col(total) != F.col("baseline")).select(run, page, total, "baseline")


def throughput(samples: DataFrame, run: str, at: str, tie: str, total, now=None, block_seconds: int = 3600) -> DataFrame:
    """Rate over the last twelve samples and the remaining time of each sample, null while unknown.

    Samples are numbered by a two-level count, so the sample eleven back is found by an equality join and
    a run of any length is shared by all tasks."""
    micros = samples.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_total(micros, run, "_at", {"done": "_one"}, block=block_seconds * 1_000_000, tie=(tie,))
    back = numbered.select(run, F.col("done").alias("_from"), F.col("_at").alias("_first_at"))
    rows = numbered.withColumn("_from", F.greatest(F.col("done") - (V.ETA_SAMPLES - 1), F.lit(1))).join(back, [run, "_from"])
    span, moved = (F.col("_at") - F.col("_first_at")) / 1e6, F.col("done") - F.col("_from")
    seen = F.least(F.col("done"), F.lit(V.ETA_SAMPLES))
    stalled = (F.unix_micros(c(now).cast("timestamp")) - F.col("_at")) / 1e6 >= V.ETA_STALL if now is not None else F.lit(False)
    known = (seen >= V.ETA_MIN_SAMPLES) & (span >= V.ETA_MIN_SPAN) & (moved > 0) & ~stalled
    rate = F.when(known, moved / span)
    return rows.select(*samples.columns, "done", rate.alias("rate"),
                       F.when(known, F.greatest((c(total) - F.col("done")) / rate, F.lit(0.0))).alias("eta_seconds"))


def peak_concurrency(tasks: DataFrame, run: str, start: str, end: str, block_seconds: int = 3600) -> DataFrame:
    """Most tasks in flight at once; a task ending when another starts does not overlap it."""
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    moves = tasks.select(run, F.explode(F.array(F.struct(micros(start).alias("at"), F.lit(1).alias("delta")),
                                                F.struct(micros(end).alias("at"), F.lit(-1).alias("delta")))).alias("_m"))
    # equal moves are merged first: one row per instant and direction
    merged = moves.groupBy(run, F.col("_m.at").alias("at"), F.col("_m.delta").alias("delta")).agg(F.sum("_m.delta").alias("step"))
    swept = running_total(merged, run, "at", {"in_flight": "step"}, block=block_seconds * 1_000_000, tie=("delta",))
    return swept.groupBy(run).agg(F.max("in_flight").alias("peak"))


def collision_ordinal(df: DataFrame, keys, order: str) -> DataFrame:
    """Adds ordinal: 1 for the first run of a folder and stamp, then 2, 3, ...  ``order`` is integral."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {"ordinal": "_one"}).drop("_one")


def cap_jobs(df: DataFrame, run: str, order: str, max_jobs: int) -> DataFrame:
    """The first jobs of each run up to its limit."""
    from .grouping import top_k

    return top_k(df, run, [F.col(order)], max_jobs)
