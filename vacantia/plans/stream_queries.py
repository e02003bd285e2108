"""Streaming queries over the event table, drained to a table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import streams as Z
from .registry import query


def _stream(t):
    """The event table as a file stream."""
    schema = t.events.schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("Z1", "select distinct user_id, json_extract_string(props, '$.k')::bigint as k from events")
def stream_distinct_ids(t):
    """Every (run, id) once, by streaming dedup with a watermark wider than the data."""
    df = _stream(t).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return Z.drain(Z.dedupe(df, ["user_id", "k"], "ts", "400 days").select("user_id", "k"))


_OPEN = "(select max(ts) - interval 10 minutes from events)"


@query("Z2", f"""with recursive d as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hours as g from (select distinct user_id, ts from events)),
 w as (select user_id, min(ts) as s from events group by 1 union all select w.user_id, min(d.ts) as s from w join d on d.user_id = w.user_id and d.ts > w.s and (d.g or d.ts >= w.s + interval 8 hours) group by w.user_id, w.s),
 n as (select user_id, s, lead(s) over (partition by user_id order by s) as e from w), g as (select n.user_id, n.s as first_at, max(ts) as last_at, count(*) as activities from n join events v on v.user_id = n.user_id and v.ts >= n.s and (n.e is null or v.ts < n.e) group by 1, 2),
 c as (select *, last_at + interval 2 hours > first_at + interval 8 hours as cut, (epoch_us(last_at) - epoch_us(first_at)) / 1e6 as span from g where {_OPEN} >= least(last_at + interval 2 hours, first_at + interval 8 hours))
select user_id, epoch_us(first_at) as first_at, activities, case when cut then 28800.0 else round(span, 3) end::double as observed_seconds, case when cut then 'MAX_OBSERVATION' when span < 600 then 'BELOW_MINIMUM' else 'QUIET' end as ended_by from c""")
def stream_quiet_periods(t):
    """Closed observation windows of each run, cut at the maximum, and how they ended."""
    out = Z.drain(Z.quiet_periods(_stream(t).select("user_id", "ts"), "user_id", "ts", "10 minutes", 7200, 600, 28800))
    return out.select("user_id", F.unix_micros("first_at").alias("first_at"), "activities", "observed_seconds", "ended_by")


@query("Z4", f"""with w as (select user_id, time_bucket(interval 15 minutes, ts) - i * interval 15 minutes as ws from events, range(4) as r(i))
select user_id, epoch_us(ws) as window_start, count(*) as done, count(*) <= 1 as stalled from w where ws + interval 1 hour <= {_OPEN} group by 1, 2""")
def stream_throughput(t):
    """Closed sliding windows with their completions and a stall flag."""
    out = Z.drain(Z.sliding_throughput(_stream(t).select("user_id", "ts"), "user_id", "ts", "10 minutes", "1 hour", "15 minutes", 1))
    return out.select("user_id", F.unix_micros("window_start").alias("window_start"), "done", "stalled")


@query("Z3", """with e as (select user_id, event_id // 100 as page, json_extract_string(props, '$.k')::bigint as k from events), f as (select user_id, k, min(page) as page from e group by 1, 2), n as (select user_id, page, count(*) as new_ids from f group by 1, 2)
select user_id, page, count(*) as records, coalesce(any_value(new_ids), 0) as new_ids, coalesce(any_value(new_ids), 0) = 0 as no_progress from e left join n using (user_id, page) group by 1, 2""")
def stream_page_progress(t):
    """New ids per page of every run, pages without any marked."""
    df = _stream(t).select("user_id", F.expr("event_id div 100").alias("page"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    folder = shared_folder(t.spark)
    Z.stream_progress(df, "user_id", "page", "k", folder)
    return t.spark.read.parquet(f"{folder}/pages").select("user_id", "page", "records", "new_ids", "no_progress")


@query("Z5", """select user_id, json_extract_string(props, '$.k')::bigint as k, arg_max(event_type, event_id) as state, count(*) as updates from events group by 1, 2""")
def stream_task_states(t):
    """Latest state of every task after the stream has drained."""
    df = _stream(t).select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("state"), "event_id")
    folder = shared_folder(t.spark)
    Z.snapshot_states(df, "user_id", "k", "state", "event_id", folder)
    return Z.latest_snapshot(t.spark, folder).select("user_id", "k", "state", "updates")


@query("S8 S9", """select user_id::varchar as run_id, event_id as job_id, case event_type when 'error' then 'FAILED' when 'view' then 'SUCCESS' else 'PENDING' end as state from events""")
def checkpointed_states(t):
    """Task states written as a checkpoint, one run rewritten in place, and read back."""
    from ..sources import sinks

    state = F.expr("case event_type when 'error' then 'FAILED' when 'view' then 'SUCCESS' else 'PENDING' end")
    states = t.events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("job_id"), state.alias("state"))
    folder = shared_folder(t.spark)
    sinks.write_checkpoint(states.withColumn("state", F.lit("PENDING")), folder)
    sinks.write_checkpoint(states, folder)
    return sinks.read_checkpoint(t.spark, folder, "job_id bigint, state string").select("run_id", "job_id", "state")
