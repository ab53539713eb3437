"""Exact ranks over all rows without one task per group.

A rank inside a group (or over a whole table) is the number of rows in the
smaller buckets of the order plus the row's number inside its own bucket.
Buckets are cut so that each holds about ``ROWS_PER_BUCKET`` rows, so no window
sees a whole group, and only one row for each bucket takes part in prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one window partition holds on average.
ROWS_PER_BUCKET = 20_000


def shuffle_key(seed: int, *columns: str) -> Column:
    """A seeded pseudo-random hex string for a row; null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_digits(n_rows: int) -> int:
    """Leading hex digits of a shuffle key that cut ``n_rows`` rows into small buckets."""
    digits = 1
    while digits < 7 and n_rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits


def ranked_buckets(df: DataFrame, group: list[str], bucket: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, buckets) of a table that is ranked in its groups; groups may be of any size.

    The rows get bucket and place (0-based, inside the bucket); a bucket's row
    has its start, the rank of its first row in the group, and its size.
    ``bucket`` must not decrease along ``order`` inside a group. Rows that are
    equal in ``order`` get consecutive places in any order.
    """
    held = df.withColumn("bucket", bucket)
    keys = [*group, "bucket"]
    before = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).withColumn(
        "start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return held.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1), starts


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str) -> DataFrame:
    """Add the long column ``rank``: 0-based place of each row in its group; see ``ranked_buckets``."""
    rows, starts = ranked_buckets(df, group, bucket, order)
    return (rows.join(starts.drop("size"), [*group, "bucket"])
            .withColumn("place", F.col("start") + F.col("place")).drop("bucket", "start").withColumnRenamed("place", rank))
