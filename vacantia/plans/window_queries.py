"""Ordered queries: batches, pages, throughput, concurrency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from . import inputs as I, sql as S
from .registry import query


def _batches(t):
    """A turn is a batch; its ids are the words of the turn."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    return t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("batch"), words.alias("ids"))


_AUDIT = r"""b as (select conv_id as run_id, turn as batch, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '') as ids from conversations),
 e as (select run_id, batch, unnest(list_distinct(ids)) as id from b), f as (select run_id, id, min(batch) as batch from e group by 1, 2), n as (select run_id, batch, count(*) as new_unique_ids from f group by 1, 2),
 audit as (select run_id, batch, len(ids)::bigint as records, len(list_distinct(ids))::bigint as unique_ids, coalesce(new_unique_ids, 0) as new_unique_ids, sha256(array_to_string(ids, chr(31))) as ordered_ids_hash, sha256(array_to_string(list_sort(list_distinct(ids)), chr(31))) as set_ids_hash,
  sum(coalesce(new_unique_ids, 0)) over w as cumulative_unique, sum(len(ids)) over w as cumulative_records from b left join n using (run_id, batch) window w as (partition by run_id order by batch))"""


@query("W3 U2", f"""with {_AUDIT} select run_id, batch, records, unique_ids, new_unique_ids, unique_ids - new_unique_ids as cross_batch_duplicates, ordered_ids_hash, set_ids_hash, cumulative_unique::bigint as cumulative_unique, cumulative_records::bigint as cumulative_records from audit""")
def batch_audit(t):
    """Unique, new and repeated ids of every batch of a run."""
    return W.batch_audit(_batches(t), "run_id", "batch", "ids")


_PAGES = """prog as (select *, case when run_id % 3 = 0 then null else 60 + run_id % 100 end as total, case when run_id % 5 = 0 then batch < 2 end as has_more, run_id % 7 = 0 and batch = 3 as cursor_seen, 25 as size from audit),
 stops as (select *, case when total is not null and {reached} >= total then 'TOTAL_REACHED' when has_more = false then 'HAS_MORE_FALSE' when records = 0 then 'EMPTY_PAGE' when cursor_seen then 'CURSOR_EXHAUSTED' when new_unique_ids = 0 then 'NO_NEW_UNIQUE_JOBS'
  when records < size and not (total is not null and cumulative_unique < total and new_unique_ids > 0) then 'SHORT_PAGE' when batch + 1 >= 5 then 'MAX_PAGES' end as stop_reason from prog)"""


def _progress(t, raw=False):
    run, batch = F.col("run_id"), F.col("batch")
    audit = W.batch_audit(_batches(t), "run_id", "batch", "ids")
    return W.page_progress(audit, "run_id", "batch", F.when(run % 3 != 0, 60 + run % 100), F.when(run % 5 == 0, batch < 2), (run % 7 == 0) & (batch == 3), F.lit(25), 5, count_raw=raw)


@query("W4", f"with {_AUDIT}, {_PAGES.format(reached='cumulative_unique')} select run_id, batch, stop_reason from stops")
def page_progress(t):
    """Why each page would end its run, judged by unique ids."""
    return _progress(t).select("run_id", "batch", "stop_reason")


@query("W4 Z3", f"with {_AUDIT}, {_PAGES.format(reached='cumulative_records')} select run_id, min(batch) as stop_page, arg_min(stop_reason, batch) as stop_reason from stops where stop_reason is not null group by 1")
def run_stops(t):
    """Where each run ends, judged by rows fetched."""
    return W.stop_pages(_progress(t, raw=True), "run_id", "batch")


@query("W6", """with p as (select l_orderkey as run_id, l_linenumber as page, sum(l_quantity) as total from lineitem group by 1, 2), b as (select run_id, arg_min(total, page) as baseline from p group by 1)
select run_id, page, total, baseline from p join b using (run_id) where total <> baseline""")
def total_drift(t):
    """Pages whose stated total differs from the first page's."""
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page")).agg(F.sum("l_quantity").alias("total"))
    return W.total_drift(pages, "run_id", "page", "total")


@query("W11", """with o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as done from events), w as (select *, first_value(ts) over (partition by user_id order by done rows between 11 preceding and current row) as t0, least(done, 12) as seen from o),
 s as (select *, (epoch_us(ts) - epoch_us(t0)) / 1e6 as span, seen - 1 as moved from w)
select user_id, event_id, done, case when seen >= 5 and span >= 10 then round(span / moved, 3) end as seconds_per_item, case when seen >= 5 and span >= 10 then round(greatest((1000 - done) / (moved / span), 0), 1) end as eta_seconds from s""")
def throughput_eta(t):
    """Recent rate and remaining time after every finished task."""
    df = W.throughput(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", F.lit(1000))
    return df.select("user_id", "event_id", "done", F.round(1 / F.col("rate"), 3).alias("seconds_per_item"), F.round("eta_seconds", 1).alias("eta_seconds"))


@query("W12", """with m as (select user_id, epoch_us(ts) as tm, 1 as d from events union all select user_id, epoch_us(ts) + cast(value * 600 as bigint) * 1000000, -1 from events), g as (select user_id, tm, d, sum(d) as s from m group by 1, 2, 3)
select user_id, max(x)::bigint as peak from (select user_id, sum(s) over (partition by user_id order by tm, d rows unbounded preceding) as x from g) group by 1""")
def peak_concurrency(t):
    """Most tasks of a run in flight at once."""
    seconds = F.round(F.col("value") * 600).cast("bigint")
    tasks = t.events.select("user_id", F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + seconds * 1000000).alias("end"))
    return W.peak_concurrency(tasks, "user_id", "start", "end")


@query("W13", """select event_id, row_number() over (partition by event_type, date_trunc('hour', ts) order by event_id) as ordinal from events""")
def collision_ordinals(t):
    """Ordinal of runs that share a folder and a stamp."""
    df = t.events.select("event_id", "event_type", F.date_trunc("hour", "ts").alias("stamp"))
    return W.collision_ordinal(df, ["event_type", "stamp"], "event_id").select("event_id", "ordinal")


@query("K3", """select user_id, event_id, rank::integer as rank from (select *, row_number() over (partition by user_id order by event_id) as rank from events) where rank <= 20""")
def capped_jobs(t):
    """The first twenty jobs of each run, as a job limit asks for."""
    return W.cap_jobs(t.events.select("user_id", "event_id"), "user_id", "event_id", 20)
