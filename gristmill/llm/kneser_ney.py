"""n-gram models with interpolated modified Kneser-Ney smoothing, fitted by Spark.

Counts of the longest n-grams are a table; all lower orders count distinct left
neighbours of the order above. Each order is joined with its contexts and with
the order below, so a model is never in one task, whatever its size, and there
is one for each language. An n-gram has its head (all but its last unit) and its
tail (all but its first) beside it.

A model is used as logarithms: of the probability of each n-gram that was seen,
and of the weight that a context leaves to the next lower order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, counted
from gristmill.llm.exchange import mixed

#: What stands before a text; no character or word of a text is equal to it.
START = "\t"
#: Rows of a level that a task reads, on average, so that small levels don't part into many small files.
TASK_ROWS = 1 << 18


def gathered(df: DataFrame) -> DataFrame:
    """``df``, worked out, in as many tasks as its rows need and no more than it has."""
    held = checkpointed(df)
    return held.coalesce(counted(held) // TASK_ROWS + 1)


def char_levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """The orders from the first on, as ``fit`` takes them, of n-grams of characters (lang, gram, n) of ``order``."""
    def with_parts(level: DataFrame) -> DataFrame:
        return level.select("lang", "gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("head"), F.expr("substring(gram, 2)").alias("tail"), "n")

    # heads and tails are cut anew where they are needed, so that they take no disk
    levels = [with_parts(gathered(counts))]
    for _ in range(order - 1):
        levels.insert(0, with_parts(gathered(levels[0].groupBy("lang", F.col("tail").alias("gram")).agg(F.count(F.lit(1)).alias("n")))))
    return levels


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what counts of 1, 2 and more of one order give up; bounded where counts of counts are missing."""
    n1, n2, n3, n4 = (F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4))
    found = level.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def discount(k: int, a: str, b: str) -> Column:
        raw = F.when(F.col(a) > 0, k - (k + 1) * y * F.col(b) / F.col(a)).otherwise(k * y)
        return F.least(F.greatest(raw, F.lit(0.1)), F.lit(float(k)))

    return found.select("lang", discount(1, "n1", "n2").alias("d1"), discount(2, "n2", "n3").alias("d2"), discount(3, "n3", "n4").alias("d3"))


def fit(levels: list[DataFrame]) -> DataFrame:
    """(lang, size, gram, p, left): the model of counts (lang, gram, head, tail, n) of each order, from the first on.

    size is the number of units, p the logarithm (base 2) of the n-gram's
    probability, left that of the weight which it leaves, as a context, to lower
    orders. p is null for what is only a context, left for what is none or leaves
    all. The empty n-gram is the context of the first order, and its p the share
    of each unit and of one unknown.
    """
    known = levels[0].groupBy("lang").agg((-F.log2(F.count(F.lit(1)) + 1.0)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    out = None
    for size, level in enumerate(levels, 1):
        d = discounts(level)
        contexts = level.groupBy("lang", "head").agg(F.sum("n").alias("total"), *[
            F.sum(x.cast("long")).alias(f"n{k}") for k, x in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))])
        given_up = F.least(F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3"), "total")
        contexts = contexts.join(d, "lang").select("lang", "head", "total", F.log2(given_up / F.col("total")).alias("left"))
        given = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        below = known.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_below"))
        seen = level.join(d, "lang").join(contexts, ["lang", "head"]).join(below, ["lang", "tail"])
        own = (F.col("n") - F.least(given, "n")) / F.col("total")
        p = gathered(seen.select("lang", "gram", F.log2(own + F.pow(F.lit(2.0), F.col("left") + F.col("p_below"))).alias("p")))
        weights = contexts.select("lang", F.col("head").alias("gram"), "left").where("left < 0")
        part = known.join(weights, ["lang", "gram"], "full").select("lang", F.lit(size - 1).alias("size"), "gram", "p", "left")
        out, known = part if out is None else out.union(part), p
    return out.union(known.select("lang", F.lit(len(levels)).alias("size"), "gram", "p", F.lit(None).cast("double").alias("left")))


# -- keys of n-grams

BASE = np.uint64(0x9E3779B97F4A7C15)
#: What tells the keys of contexts from those of n-grams.
CONTEXT = np.uint64(0xA0761D6478BD642F)


def rolled(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n units that end at each place from the n-th on; ``units`` are 64-bit hashes."""
    out = units[:max(0, len(units) - n + 1)].copy()
    for k in range(1, n):
        out *= BASE
        out += units[k:len(units) - n + 1 + k]
    return mixed(out + np.uint64(n))


def text_hash(text: str) -> np.uint64:
    """A 64-bit hash of a short text, by its code points."""
    out = np.zeros(1, np.uint64)
    for point in text:
        out = mixed(out + BASE) + np.uint64(ord(point) + 1)
    return mixed(out)[0]


#: Runs whose beginnings are looked for at once.
RUNS = 1 << 16


class HashArray:
    """Sorted 64-bit keys with values; the leading bits of a key say where its run begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = np.append(values.astype(np.float32, copy=False), np.float32(np.nan))
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.empty(1 << bits, np.int32)
        for k in range(0, 1 << bits, RUNS):  # a part at a time, as whole arrays for it take several times the memory of the keys
            part = self.begins[k:k + RUNS]
            part[:] = np.searchsorted(keys, np.arange(k, k + len(part), dtype=np.uint64) << self.shift)
        self.keys = np.append(keys, ~np.uint64(0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys; nan where there is none."""
        at = self.begins[(wanted >> self.shift).astype(np.int64)]
        here = self.keys[at]
        behind = np.flatnonzero(here < wanted)
        while len(behind):
            at[behind] += 1
            here[behind] = self.keys[at[behind]]
            behind = behind[here[behind] < wanted[behind]]
        at[here != wanted] = len(self.keys) - 1
        return self.values[at]


class SortedArray:
    """Sorted 64-bit keys with values, as they were sent: no copy and no table, so that any number of them may be asked in turn."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys; nan where there is none."""
        out = np.full(len(wanted), np.float32(np.nan), np.float32)
        if len(self.keys):
            order = np.argsort(wanted)  # neighbours are sought in neighbouring places
            at = np.minimum(np.searchsorted(self.keys, wanted[order]), len(self.keys) - 1)
            hit = self.keys[at] == wanted[order]
            out[order[hit]] = self.values[at[hit]]
        return out
