"""Streaming queries over events, run until all input is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.registry import ORACLES, query
from gristmill.sources.tables import table
from gristmill.streaming import stateful as S


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream(spark, f"{sf_dir}/events.parquet")


@query("stream_seen_dedupe", "select distinct user_id, event_type from events")
def stream_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_available(S.first_seen(events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("stream_ttl_claims", ORACLES.get("ttl_dedupe"))
def stream_ttl_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_available(S.claims(events(spark, sf_dir), ["user_id", "event_type"], "ts", 30_000))


@query("stream_progress", "select user_id, max(event_id) as event_id, round(max(value), 2) as value from events group by 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.run_available(S.progress(events(spark, sf_dir).withColumn("value", F.round("value", 2)), ["user_id"], ["event_id", "value"]), "update")
    return rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"))


@query("stream_cancelled", "select event_id, user_id from events where user_id not in (select o_custkey from orders where o_orderstatus = 'P')")
def stream_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancelled = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return S.run_available(S.without_cancelled(events(spark, sf_dir).select("event_id", "user_id"), cancelled, "user_id"))


@query("stream_cached_lookups", """
    with e as (select *, event_type in ('view', 'click') as asks, event_type in ('view', 'error') as is_save from events),
    m as (select event_id, user_id, ts, asks, is_save, max(case when not asks and is_save then ts end) over w as saved, max(case when not asks and not is_save then ts end) over w as studied from e
      window w as (partition by user_id order by ts range between unbounded preceding and current row))
    select user_id, event_id, coalesce(is_save and ts < saved + interval 86400 seconds, false) or coalesce(ts < studied + interval 86400 seconds, false) as cached from m where asks""")
def stream_cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which views and clicks of a user come within a day of what was remembered for him; views are look-ups for the saving stage."""
    rows = events(spark, sf_dir).withColumns({
        "asks": F.col("event_type").isin("view", "click"), "stage": F.when(F.col("event_type").isin("view", "error"), "Save").otherwise("study")})
    return S.run_available(S.cached_lookups(rows, ["user_id"], "ts", "event_id", "stage", "asks", 1_000_000))


@query("stream_batches", """
    with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id::varchar) as r from events),
    w as (select user_id, r, event_id, ts as start, 1 as n, 0 as batch from e where r = 1 union all
      select e.user_id, e.r, e.event_id, case when w.n = 5 or e.ts - w.start >= interval 40 hours then e.ts else w.start end,
        case when w.n = 5 or e.ts - w.start >= interval 40 hours then 1 else w.n + 1 end, case when w.n = 5 or e.ts - w.start >= interval 40 hours then w.batch + 1 else w.batch end
      from w join e on e.user_id = w.user_id and e.r = w.r + 1),
    b as (select user_id, batch, max(n)::int as n, arg_min(event_id, r) as first, arg_max(event_id, r) as last, max(start) as start, max(r) as r from w group by 1, 2)
    select user_id, batch, n, first, last, n = 5 as "full" from b
    where n = 5 or batch < (select max(batch) from b c where c.user_id = b.user_id) or start + interval 40 hours < (select max(ts) from events)""")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user in batches of five, or of forty hours, whichever comes first."""
    return S.run_available(S.batches(events(spark, sf_dir), ["user_id"], "ts", "event_id", 5, 144_000))


@query("stream_job_outcomes", """
    with recursive e as (select user_id, event_id, ts, case event_type when 'signup' then 'enqueue' when 'error' then 'cancel' when 'purchase' then 'done' when 'click' then 'failed' else '-' end as said from events),
    o as (select *, row_number() over (partition by user_id order by ts, said, event_id::varchar) as r from e),
    w as (select user_id, 0::bigint as r, null::bigint as event_id, null::timestamp as until, 0 as failed, null::varchar as outcome, 0 as attempts from (select distinct user_id from o) union all
      select o.user_id, o.r, o.event_id,
        case when said = 'cancel' then ts + interval 50 hours when said = 'enqueue' or said in ('done', 'failed') and ts < until then null else until end,
        case when said = 'enqueue' then 0 when said in ('done', 'failed') and ts < until then failed when said = 'done' then 0
          when said = 'failed' then case when failed + 1 <= 2 then failed + 1 else 0 end else failed end,
        case when said not in ('done', 'failed') then null when ts < until then 'cancelled' when said = 'done' then 'done' when failed + 1 <= 2 then 'retried' else 'discarded' end,
        case when said = 'failed' and (until is null or ts >= until) then failed + 1 else failed end
      from w join o on o.user_id = w.user_id and o.r = w.r + 1)
    select user_id, event_id, outcome, attempts from w where outcome is not null""")
def stream_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each run of a user's job: marks cancel one run within fifty hours, failures are retried twice."""
    said = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in {"signup": "enqueue", "error": "cancel", "purchase": "done", "click": "failed"}.items()], F.lit("-"))
    return S.run_available(S.job_outcomes(events(spark, sf_dir).withColumn("said", said), ["user_id"], "ts", "event_id", "said", 180_000, 2))
