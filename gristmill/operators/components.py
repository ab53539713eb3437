"""Connected components of rows that share keys, by stars that shrink."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which a graph counts as broken; they grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as written to ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def edges_by_keys(rows: DataFrame, ident: str, keys: str) -> DataFrame:
    """(u, v) from each row to the smallest row that has the same key; ``keys`` is an array column.

    A key of n rows makes n - 1 edges, not n * n / 2. The smallest row of a key
    comes from a partial aggregate, and has one row in the join, so Spark may
    split a key that half of the rows have.
    """
    held = cut_lineage(rows.select(F.col(ident).alias("u"), F.explode(keys).alias("key")))  # keys may be dear, and are read twice
    least = held.groupBy("key").agg(F.min("u").alias("v"), F.max("u").alias("_most")).where("v < _most").drop("_most")
    return held.join(least, "key").where("u != v").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) of every vertex of ``edges`` (u, v) but the components' own smallest; component is the smallest vertex reachable.

    In turns each vertex hangs its larger neighbours, then its smaller ones and
    itself, on the smallest that it knows, until nothing changes; then every edge
    leads to the smallest vertex. What is left shrinks to a star, one edge for a vertex.
    """
    def hung(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            found = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            found = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return found.where("u != v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = mark(edges)
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(hung(hung(edges, True), False))
        after = mark(edges)
        if after == before:
            return edges.select("u", F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"edges still change after {MAX_ROUNDS} rounds")


def connected_rows(rows: DataFrame, ident: str, keys: str) -> DataFrame:
    """``rows`` with component: the smallest ``ident`` that keys in common reach, the row's own included.

    Null and empty key arrays connect with nothing; rows with a null ident have a
    null component. ``ident`` tells rows apart; rows that repeat it are one.
    """
    known = rows.where(F.col(ident).isNotNull())
    found = components(edges_by_keys(known, ident, keys)).select(F.col("u").alias(ident), "component")
    return rows.join(found, ident, "left").withColumn("component", F.coalesce("component", F.col(ident)))
