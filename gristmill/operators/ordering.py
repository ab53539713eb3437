"""Places in one order over all rows, without one task for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.operators.components import cut_lineage

#: Bits of a row's number inside its partition, as Spark's own row ids have them.
INSIDE = (1 << 33) - 1


def with_place(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with the long column ``name``: the place from 0 of each in ``order``.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's
    place is its number inside its partition after the rows of all before, of which
    one count each takes part in a sum. Rows that are equal in ``order`` get
    consecutive places in any order.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    held = cut_lineage(sorted_rows).withColumn("_part", F.shiftrightunsigned("_row", 33).cast("int"))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return held.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(INSIDE)).drop("_part", "_row", "_before")
