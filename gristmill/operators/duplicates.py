"""Duplicate groups and first- or last-row choices by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, n, keep, rest) of keys that two or more rows have; the smallest id stays, the others are listed in order.

    Rows with a blank or null key belong to no group. The list of a group holds
    ids only; use ``duplicate_rows`` where groups may be too large for one row.
    """
    ids = F.array_sort(F.collect_list(ident))
    groups = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(ids.alias("ids"))
    return groups.where(F.size("ids") > 1).select(
        key, F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("keep"),
        F.slice("ids", F.lit(2), F.size("ids")).alias("rest"))


def duplicate_rows(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, id, keep) of every row that is not its key's smallest id; groups of any size."""
    least = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.min(ident).alias("keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(least, key).where(F.col(ident) != F.col("keep")).select(key, ident, "keep")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``; by a reduction, not by a sort of whole groups.

    ``order`` are columns that sort ascending; use negated columns to descend.
    """
    names = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*names), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def last_rows(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_row", number).where(F.col("_row") <= n).drop("_row")


def unknown_starts(starts: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``starts`` whose key is not known, each key once, the first in order; blank keys all pass.

    Both tables have ``key`` without its scheme, so http and https are the same.
    The joins sort: no table of keys, which grow with the rows, passes the driver.
    """
    keyed = starts.where(F.col(key) != "")
    first = keyed.groupBy(key).agg(F.min(order).alias("_first"))
    fresh = keyed.join(first.hint("merge"), key).where(F.col(order) == F.col("_first")).drop("_first")
    passed = fresh.join(known.select(key).where(F.col(key) != "").distinct().hint("merge"), key, "left_anti")
    return passed.select(*starts.columns).union(starts.where(F.coalesce(F.col(key), F.lit("")) == ""))


def start_reasons(starts: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """``starts`` with reason: blank (passes), known, repeated (not the first of its key in ``order``) or new; see ``unknown_starts``."""
    least = starts.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(order).alias("_first"))
    seen = known.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct().withColumn("_known", F.lit(True))
    both = starts.join(least, key, "left").join(seen, key, "left")
    reason = (F.when(F.coalesce(F.col(key), F.lit("")) == "", "blank").when(F.col("_known"), "known")
              .when(F.col(order) > F.col("_first"), "repeated").otherwise("new"))
    return both.select(*[c for c in starts.columns], reason.alias("reason"))


def contained_blocks_dropped(blocks: Column, least: int = 5) -> Column:
    """Text blocks in order without those that a kept block contains; a longer block replaces the shorter ones it contains."""
    def step(done: Column, block: Column) -> Column:
        inside = F.exists(done, lambda other: other.contains(block))
        others = F.filter(done, lambda other: ~block.contains(other))
        return F.when((F.length(block) <= least) | inside, done).otherwise(F.array_append(others, block))
    return F.aggregate(blocks, F.array().cast("array<string>"), step)
