"""Stateful streams: seen sets, claims and caches that expire, batches by size or time, cancel marks, counters, throttles.

Each function takes a streaming DataFrame and returns one; ``run_available``
drives a query over what is there and returns its rows as a table. State that
has a lifetime is dropped by event-time timers once the watermark has passed it,
so it doesn't grow with the keys that were ever seen.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting takes one below its warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    return f"{top}/stream-{uuid.uuid4()}"


def read_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Parquet files as a stream of ``files`` each micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a streaming query gives for all input there is; in other modes with the number of their batch, _batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    if mode == "append":
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
                 .option("path", f"{folder}/rows").trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0)).write.parquet(f"{folder}/rows/none")  # so that there is a folder without input
    query = (stream.writeStream.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/n{n}"))
             .outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows/n*")


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key; with a time and delay, state is dropped once no repeat can count."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


#: A watermark begins in 1970, and what is not after it is late; so times are moved on by so many microseconds, a hundred
#: years, while they are waited for. Times from 1870 to 2160 fit.
AHEAD = 3_155_760_000_000_000


#: Groups that the keys of a stream are dealt to by a hash; a state and a call of Python for each, not for each key.
GROUPS = 1 << 12
#: Whole numbers travel to Python as texts where a column may hold nulls, as pandas would make them floats.
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def in_order(stream: DataFrame, keys: list[str], time: str, columns: list[str], schema: str,
             step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]],
             deadline: Callable[[tuple], int | None], expire: Callable[[tuple], list[tuple]] = lambda state: [], delay: str = "0 seconds",
             groups: int = GROUPS) -> DataFrame:
    """What ``step`` makes of the rows of each key in the order of their time, with a state that a timer ends.

    ``step`` takes the state of a key (None at first) and a row (microseconds of
    ``time``, then ``columns``) and gives the next state and output rows (without
    the keys). Once the watermark, which lags ``delay`` behind, has passed
    ``deadline`` of a state (microseconds, None for never), ``expire`` gives its
    last rows and it is dropped. Rows behind the watermark are dropped as late; rows
    without a time have no place and are left out.

    Keys are dealt to ``groups`` by their hash, and a group has one state with those
    of its keys; its timer is the first of theirs. A task holds the rows and states that
    a group has in one micro-batch, so ``groups`` must rise with what a micro-batch has.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out_names = [x.strip().split(" ")[0] for x in schema.split(",")]
    whole = [kinds[c] in WHOLE for c in columns]

    def values(column: pd.Series, number: bool) -> list:
        return [None if x is None else int(x) for x in column.tolist()] if number else column.tolist()

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = pickle.loads(state.get[0]) if state.exists else {}  # noqa: S301
        rows: dict[str, list[tuple]] = {}
        for b in [] if state.hasTimedOut else batches:
            for key, *row in zip(b["_key"].tolist(), b["_us"].tolist(), *(values(b[c], n) for c, n in zip(columns, whole, strict=True)), strict=True):
                rows.setdefault(key, []).append(tuple(row))
        out = []
        for key, own in rows.items():
            own.sort(key=lambda r: (r[0], *map(str, r[1:])))
            now = held.pop(key, None)
            for row in own:
                now, made = step(now, row)
                out += [(key, *x) for x in made]
            if now is not None:
                held[key] = now
        passed, ends = state.getCurrentWatermarkMs(), []
        for key, now in list(held.items()):
            end = deadline(now)
            end = None if end is None else -(-(end + AHEAD) // 1000)
            if end is None:
                continue
            if end <= passed:  # nothing that still comes can see it
                out += [(key, *x) for x in expire(now)]
                del held[key]
            else:
                ends.append(end)
        if held:
            state.update((pickle.dumps(held),))
            if ends:
                state.setTimeoutTimestamp(min(ends))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["_key", *out_names], dtype=object)

    # keys stay as one text, so that Python need not know their types
    parts = F.struct(*keys)
    form = {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    sent = [F.col(c).cast("string").alias(c) if n else F.col(c) for c, n in zip(columns, whole, strict=True)]
    timed = stream.select(F.to_json(parts, form).alias("_key"), F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), *sent,
                          F.unix_micros(F.col(time).cast("timestamp")).alias("_us")).where("_us is not null")
    rows = timed.withColumn("_t", F.timestamp_micros(F.col("_us") + AHEAD)).withWatermark("_t", delay)
    found = rows.groupBy("_group").applyInPandasWithState(fold, f"_key string, {schema}", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    back = F.from_json("_key", T.StructType([T.StructField(c, stream.schema[c].dataType) for c in keys]), form)
    return found.withColumn("_key", back).select("_key.*", *out_names)


def claims(stream: DataFrame, keys: list[str], time: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, time) of rows that no granted claim of their key precedes by less than ``seconds``; a claim is forgotten when it has run out."""
    def grant(last: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        if last is not None and row[0] - last[0] < seconds * 1_000_000:
            return last, []
        return (row[0],), [(row[0],)]

    granted = in_order(stream, keys, time, [], "_at long", grant, lambda last: last[0] + seconds * 1_000_000, delay=delay)
    return granted.select(*keys, F.timestamp_micros("_at").alias(time))


#: Bounds of the lifetime of what a cache of finished URLs remembers, in seconds.
LEAST_TTL, MOST_TTL = 60, 86_400


def cached_lookups(stream: DataFrame, keys: list[str], time: str, ident: str, stage: str, lookup: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, ident, cached) of the rows where ``lookup`` holds: whether a row of the key without it was remembered for ``seconds`` at most.

    Stages are ``study`` and ``save`` (anything else counts as study); a look-up
    for save is also served by study. Remembering again starts anew. Of rows at
    one time those that remember come first. ``seconds`` is held within a
    minute and a day.
    """
    ttl = min(max(seconds, LEAST_TTL), MOST_TTL) * 1_000_000

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        at, asks, is_save, row_id = row
        study, save = held or (0, 0)
        if asks:
            return (study, save), [(row_id, at < save or at < study if is_save else at < study)]
        return ((study, at + ttl) if is_save else (at + ttl, save)), []

    rows = stream.withColumns({"_asks": F.col(lookup), "_save": F.lower(F.trim(F.coalesce(stage, F.lit("")))) == "save", "_id": F.col(ident)})
    kind = dict(stream.dtypes)[ident]
    found = in_order(rows, keys, time, ["_asks", "_save", "_id"], f"_found {kind}, cached boolean", step, max, delay=delay)
    return found.withColumnRenamed("_found", ident)


def batches(stream: DataFrame, keys: list[str], time: str, ident: str, size: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, batch, n, first, last, full): the rows of each key in batches that close with ``size`` rows, or ``seconds`` after their first.

    A batch that time closes is given out when a row of its key comes later, or
    when the watermark has passed its end. ``first`` and ``last`` are idents.
    """
    span = seconds * 1_000_000

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        at, row_id = row
        number, n, start, first, last = held or (0, 0, at, row_id, row_id)
        out = []
        if n and at - start >= span:
            out.append((number, n, first, last, False))
            number, n = number + 1, 0
        if not n:
            start, first = at, row_id
        n, last = n + 1, row_id
        if n == size:
            out.append((number, n, first, last, True))
            return (number + 1, 0, at, row_id, row_id), out
        return (number, n, start, first, last), out

    kind = dict(stream.dtypes)[ident]
    return in_order(stream, keys, time, [ident], f"batch int, n int, first {kind}, last {kind}, full boolean", step, lambda s: s[2] + span if s[1] else None,
                    lambda s: [(s[0], s[1], s[3], s[4], False)] if s[1] else [], delay)


def job_outcomes(stream: DataFrame, keys: list[str], time: str, ident: str, action: str, cancel_seconds: int, retries: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, ident, outcome, attempts) of each run of a job, by what was said of its key before.

    ``action`` is enqueue (clears a cancel mark and the attempts), cancel (marks for ``cancel_seconds``),
    done or failed (a run); other rows count for nothing. A run under a mark is cancelled and takes the
    mark with it; a failed one is retried up to ``retries`` times and then discarded; attempts counts
    the failures so far. A key without a mark and attempts has no state.
    """
    ttl = cancel_seconds * 1_000_000

    def step(held: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at, said, row_id = row
        until, failed = held or (0, 0)
        out = []
        if said == "enqueue":
            until = failed = 0
        elif said == "cancel":
            until = at + ttl
        elif said in ("done", "failed") and at < until:
            until, out = 0, [(row_id, "cancelled", failed)]
        elif said == "done":
            failed, out = 0, [(row_id, "done", failed)]
        elif said == "failed":
            failed += 1
            out = [(row_id, "retried" if failed <= retries else "discarded", failed)]
            failed = failed if failed <= retries else 0
        return ((until, failed) if until or failed else None), out

    kind = dict(stream.dtypes)[ident]
    rows = stream.withColumns({"_said": F.col(action), "_id": F.col(ident)})
    # attempts have no end of their own, so only a mark alone runs out
    found = in_order(rows, keys, time, ["_said", "_id"], f"_found {kind}, outcome string, attempts int", step,
                     lambda s: s[0] if not s[1] else None, delay=delay)
    return found.withColumnRenamed("_found", ident)


def progress(stream: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """The largest value so far of each counter by key: late and decreasing reports change nothing."""
    return stream.groupBy(*keys).agg(*[F.max(c).alias(c) for c in counters])


def last_by_interval(stream: DataFrame, keys: list[str], time: str, interval: str, delay: str, order: list[str]) -> DataFrame:
    """The last row of each key and interval, given out when the watermark passes the interval's end."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    names = [c for c in stream.columns if c not in keys]
    rows = timed.groupBy(*keys, F.window("_t", interval).alias("_w")).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r"))
    return rows.select(*keys, F.col("_w.start").alias("interval_start"), "r.*")


def without_cancelled(stream: DataFrame, cancelled: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a table of cancelled ones."""
    return stream.join(cancelled.select(key).distinct(), key, "left_anti")
