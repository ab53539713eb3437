"""Windows over ordered histories: retention, running state, throttles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_only(rows: DataFrame, keys: list[str], ident: str, time: str, n: int) -> DataFrame:
    """Rows of the ``n`` newest ids of each key; an id is as old as its first row."""
    first = rows.groupBy(*keys, ident).agg(F.min(time).alias("_first"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_first"), F.desc(ident)))
    kept = first.withColumn("_row", number).where(F.col("_row") <= n).select(*keys, ident)
    return rows.join(kept, [*keys, ident], "left_semi")


def stopped_after(rows: DataFrame, keys: list[str], order: list[Column], is_old: Column, k: int) -> DataFrame:
    """Add old_so_far and stopped: whether ``k`` old rows came before a row of its list."""
    running = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(is_old.cast("int")).over(running), F.lit(0))
    return rows.withColumn("old_so_far", so_far).withColumn("stopped", F.col("old_so_far") >= k)


def monotonic(rows: DataFrame, keys: list[str], order: list[Column], counters: list[str]) -> DataFrame:
    """Each counter as the largest so far in its key; nulls take over what was."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.max(c).over(so_far) for c in counters})


def sticky_status(rows: DataFrame, keys: list[str], order: list[Column], status: str, terminal: list[str]) -> DataFrame:
    """A status that stays once it is terminal, against ``running`` rows that come late."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col(status).isin(terminal), F.col(status)), ignorenulls=True).over(so_far)
    return rows.withColumn(status, F.when(last.isNotNull() & ~F.col(status).isin(terminal), last).otherwise(F.col(status)))


def last_of_interval(rows: DataFrame, keys: list[str], time: str, interval: str, order: list[str]) -> DataFrame:
    """One row for each key and time interval, the last."""
    names = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys, F.window(time, interval).alias("_w")).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r"))
    return picked.select(*keys, F.col("_w.start").alias("interval_start"), "r.*")


def outside_ttl(rows: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """(keys, time) of the rows that no accepted row of the same key precedes by less than ``seconds``.

    Times of a key are folded in order, as each choice depends on the last one;
    equal times count once.
    """
    times = F.array_sort(F.collect_set(F.col(time).cast("timestamp")))
    state = "struct<last:timestamp,kept:array<timestamp>>"
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.array().cast("array<timestamp>").alias("kept")).cast(state)
    fold = F.aggregate("_times", start, lambda s, t: F.when(
        s["last"].isNull() | (F.unix_micros(t) - F.unix_micros(s["last"]) >= seconds * 1_000_000),
        F.struct(t.alias("last"), F.array_append(s["kept"], t).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return rows.groupBy(*keys).agg(times.alias("_times")).select(*keys, F.explode(fold).alias(time))
