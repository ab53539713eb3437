"""Sharding by proportional stratified interleaving (operator 10, native).

Rows are shuffled by a seeded hash inside their source and ranked there; row r
of a source of n rows sits at fraction (2r + 1) / 2n. All rows in the order of
their fractions, cut into runs whose sizes differ by one at most, give shards
that each hold the mixture of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed
from gristmill.llm.ranking import ROWS_PER_BUCKET, hex_digits, ranked, shuffle_key


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, source) into a shard; one row each.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 16), text_crc32,
    law (always ``rows``: shard counts differ by one at most), shard, slot
    (0-based place in the shard) and grown_shard (null: the law is not ``key``).

    A null text counts as empty, a null source as the source '', and a null
    doc_id as an empty id in the shuffle. Repeated rows keep a slot each. With
    fewer rows than shards some shards are empty; an empty table gives no rows.
    Texts of any length count whole; other columns of ``docs`` are ignored.
    """
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # the texts are read once; all further passes are over these few bytes a row
    rows = checkpointed(rows.withColumn("key", shuffle_key(seed, "doc_id", "text_crc32")))
    total = rows.count()
    rows = ranked(rows, ["source"], F.substring("key", 1, hex_digits(total)), ["key", "doc_id", "size"], "rank")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    placed = rows.join(sizes, "source").withColumn(
        "fraction", (2 * F.col("rank") + 1) / (2 * F.col("n_source")))
    n_buckets = max(1, total // ROWS_PER_BUCKET)
    order = ["fraction", "source", "rank"]
    placed = ranked(placed, [], F.floor(F.col("fraction") * n_buckets), order, "place")
    # whole-number division: shard s takes the places from ceil(s * rows / shards) on
    number = F.expr(f"cast((place * {n_shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"((shard * {total}L) + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("shard", number)
            .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
