"""Mixing sources to target weights by Pfair scheduling (operator 1).

The stream is a sequence of slots of one block each. Block j (from 1) of a
source with weight w, a share of all weights, is released at floor((j-1) / w)
and due at ceil(j / w). In every slot the released block with the earliest
deadline is next, so at any time each source is less than one block away from
its target. Weights are whole numbers, so all of this is exact.

Until a slot T every source has had floor(w T) blocks or one more, so a source's
state is one bit. Runs of slots are scheduled side by side, each from a guess at
its first state, with some slots of lead in which wrong guesses die out. Then
each run's first state is held against the last state of the run before; where
they differ the run is scheduled again, until all fit. So the result is the one
schedule from slot 0 on, without a pass over all slots in one place.

A source that runs out starts its next epoch in the same order. The stream ends
with the deadline of the block that brings the last row of the last unfinished
source, so every row occurs at least once.
"""

from __future__ import annotations

import collections
import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import never_broadcast
from gristmill.llm.ranking import hex_digits, ranked_buckets, shuffle_key

#: Without explicit weights a source of n rows has the target weight n ** TEMPERATURE ...
TEMPERATURE = 0.7
#: ... lowered until no source is repeated more often than this, in thousandths.
MAX_EPOCHS, UNITS = 4, 1000
#: Slots that one task schedules at least.
RUN = 1 << 16
#: Explicit weights that are no whole numbers become whole shares of this.
WHOLE = 1 << 52


def default_weights(counts: Mapping[str, int]) -> dict[str, int]:
    """Target weights of sources for which none are given, as whole numbers."""
    weights = {k: float(n) ** TEMPERATURE for k, n in counts.items()}
    least = min((weights[k] / n for k, n in counts.items()), default=0.0)
    return {k: int(min(weights[k] / n, least * MAX_EPOCHS) * n * UNITS) + 1 for k, n in counts.items()}


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers in the same proportions: as they are where whole, else rounded to 2**-52 of their sum."""
    total = sum(weights.values())
    if all(float(w).is_integer() for w in weights.values()) and total <= WHOLE:
        return {k: int(w) for k, w in weights.items()}
    return {k: max(1, round(w / total * WHOLE)) for k, w in weights.items()}


def shares(c: np.ndarray, total: int, slot: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor, ceil) of the blocks that each source should have had before a slot, exactly."""
    done = np.floor(c / total * slot).astype(np.int64)
    # the estimate is off by one at most, so the remainder is right although the products overflow
    left = np.multiply(c, slot, dtype=np.int64) - np.multiply(done, total, dtype=np.int64)
    done = done + (left >= total) - (left < 0)
    left = np.where(left >= total, left - total, np.where(left < 0, left + total, left))
    return done, done + (left > 0)


def guess(c: np.ndarray, slot: int) -> np.ndarray:
    """Blocks that each source has had before ``slot`` if those nearest to done are done; exact at slot 0 only."""
    done, above = shares(c, int(c.sum()), slot)
    nearest = np.lexsort((np.arange(len(c)), done - c / c.sum() * slot, above == done))
    done[nearest[:slot - int(done.sum())]] += 1
    return done


def scheduled(c: np.ndarray, done: np.ndarray, first: int, after: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block from 0, slot, release, deadline) of the slots from ``first`` to before ``after``; counts on in ``done``."""
    weights = [int(x) for x in c]
    total = sum(weights)
    waiting, ready = [], []

    def add(source: int, j: int, now: int) -> None:
        release, due = (j - 1) * total // weights[source], -(-j * total // weights[source])
        heapq.heappush(*((ready, (due, source, j, release)) if release <= now else (waiting, (release, due, source, j))))

    for source, blocks in enumerate(done.tolist()):
        add(source, blocks + 1, first)
    for slot in range(first, after):
        # after a wrong guess it may be that nothing is released
        while waiting and (waiting[0][0] <= slot or not ready):
            release, due, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, j, release))
        due, source, j, release = heapq.heappop(ready)
        done[source] += 1
        yield source, j - 1, slot, release, due
        add(source, j + 1, slot)


def first_states(spark: SparkSession, c: np.ndarray, length: int, run: int) -> list[list[int]]:
    """The sources that are a block ahead of their floor at the first slot of each run, and after the last."""
    total, n_runs = int(c.sum()), -(-length // run)

    def ahead(done: np.ndarray, slot: int) -> list[int]:
        return np.flatnonzero(done > shares(c, total, slot)[0]).tolist()

    def try_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, known in zip(batch["k"].tolist(), batch["known"], strict=True):
                first, after = k * run, min(length, (k + 1) * run)
                if known is None:
                    lead = max(0, first - run // 8)
                    done = guess(c, lead)
                    collections.deque(scheduled(c, done, lead, first), 0)
                    known = ahead(done, first)
                done = shares(c, total, first)[0]
                done[np.asarray(known, np.int64)] += 1
                collections.deque(scheduled(c, done, first, after), 0)
                yield pd.DataFrame({"k": [k], "first": [list(known)], "last": [ahead(done, after)]})

    firsts, lasts = {}, {}
    wanted = [(k, None if k else []) for k in range(n_runs)]
    while wanted:
        # a run is one row, and a state names few sources, so these lists are small beside the schedule
        asked = spark.createDataFrame(wanted, "k long, known array<int>").repartition(max(1, min(len(wanted), 1000)))
        for r in asked.mapInPandas(try_runs, "k long, first array<int>, last array<int>").collect():
            firsts[r["k"]], lasts[r["k"]] = sorted(r["first"]), sorted(r["last"])
        wanted = [(k, lasts[k - 1]) for k in range(1, n_runs) if firsts[k] != lasts[k - 1]]
    return [firsts[k] for k in range(n_runs)] + [lasts[n_runs - 1] if n_runs else []]


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16, seed: int = 42,
        run: int = RUN) -> DataFrame:
    """The rows of ``docs`` as a stream that follows target weights by source.

    Adds mix_source (the source, null as ''), epoch (0-based), block (0-based in
    its source's stream), slot, release, deadline (in slots) and position
    (0-based, without gaps) to the columns of ``docs``; columns of these names
    are replaced, all others stay. A row is repeated with the next epoch where
    its source has to repeat. ``weights`` maps source to weight and is kept as it
    is; every source that has rows needs a positive one. Without it sources of n
    rows get n ** 0.7, so far lowered that none takes more than about four epochs.

    Sources and their weights are held on the driver and in each task; there may
    be any number of them. A source's rows come in the order of a hash of
    doc_id, then of all columns; a null doc_id takes a random place. Long texts
    are moved like others. An empty table gives no rows.
    """
    added = ["mix_source", "epoch", "block", "slot", "release", "deadline", "position"]
    columns = [c for c in docs.columns if c not in added]
    spark = docs.sparkSession
    # one struct, so that no name of a column can clash with those used here
    hashed = [F.col(f.name) for f in docs.schema.fields if f.name in columns and not isinstance(f.dataType, T.MapType)]
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"),
                       F.when(F.col("doc_id").isNull(), F.md5(F.concat_ws(":", F.lit(str(seed)), F.monotonically_increasing_id().cast("string"))))
                       .otherwise(shuffle_key(seed, "doc_id")).alias("key"),
                       F.col("doc_id").alias("id"), F.xxhash64(*hashed).alias("tie"), F.struct(*columns).alias("row"))
    counts = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if missing := [k for k in counts if weights is not None and not weights.get(k, 0) > 0]:
        raise ValueError(f"sources without a positive target weight: {sorted(missing)[:5]}")
    names = sorted(counts)
    whole = default_weights(counts) if weights is None else whole_weights({k: weights[k] for k in names})
    c, n = [whole[k] for k in names], [counts[k] for k in names]
    total = sum(c)
    # the deadline of the last block that brings new rows
    length = max((-(-(-(-x // block_rows)) * total // w) for x, w in zip(n, c, strict=True)), default=0)
    run, shared = max(run, 16 * len(names)), np.array(c, np.int64)
    states = first_states(spark, shared, length, run)
    taken = shares(shared, total, length)[0] * block_rows if names else []
    for k in states[-1]:
        taken[k] += block_rows

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, ahead in zip(batch["k"].tolist(), batch["ahead"], strict=True):
                done = shares(shared, total, k * run)[0]
                done[np.asarray(ahead, np.int64)] += 1
                yield pd.DataFrame(list(scheduled(shared, done, k * run, min(length, (k + 1) * run))),
                                   columns=["number", "block", "slot", "release", "deadline"])

    runs = spark.createDataFrame(list(enumerate(states[:-1])), "k long, ahead array<int>").repartition(max(1, min(len(states) - 1, 1000)))
    slots = runs.mapInPandas(schedule, "number int, block long, slot long, release long, deadline long")
    sources = spark.createDataFrame([(k, name, n[k], int(taken[k])) for k, name in enumerate(names)],
                                    "number int, mix_source string, n long, taken long")
    # sources are few or, if many, joined by Spark as any table
    rows, starts = ranked_buckets(rows, ["mix_source"], F.substring("key", 1, hex_digits(sum(n))), ["key", "id", "tie"])
    # which blocks hold rows of a bucket, epoch by epoch; their slots come back as one array
    of = starts.join(sources, "mix_source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - start - 1) div n"))))
    of = of.where("taken > start + epoch * n").withColumn("block", F.explode(F.expr(
        f"sequence((start + epoch * n) div {block_rows}, (least(taken, start + size + epoch * n) - 1) div {block_rows})")))
    of = never_broadcast(of).join(slots, ["number", "block"]).groupBy("mix_source", "bucket", "epoch", "start", "n", "taken").agg(
        F.sort_array(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("slots"))
    joined = rows.join(of, ["mix_source", "bucket"]).withColumn("k", F.expr("start + place + epoch * n")).where("k < taken")
    joined = joined.withColumn("at", F.expr(f"slots[cast(k div {block_rows} - slots[0].block as int)]"))
    return joined.select(*[F.col(f"row.{x}").alias(x) for x in columns], "mix_source", "epoch", F.col("at.block").alias("block"),
                         F.col("at.slot").alias("slot"), F.col("at.release").alias("release"), F.col("at.deadline").alias("deadline"),
                         F.expr(f"at.slot * {block_rows} + k % {block_rows}").alias("position"))
