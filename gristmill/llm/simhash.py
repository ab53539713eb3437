"""SimHash near-duplicates by multi-index hashing (operator 6).

A fingerprint of 64 bits has two segments of 32, and there is a table of
fingerprints for each segment, keyed by its value. Two fingerprints that differ
in at most two bits differ in at most one bit of some segment. So each distinct
fingerprint asks each table for the values in the Hamming ball of radius one
around its own segment, and complete distances are verified on what it fetches.

Of two values that differ in a bit only the one that has it asks for the other.
Where more than ``LARGE`` fingerprints share a segment, as in a very large group
of near copies, all that ask for it are matched by the points around them
instead: two fingerprints within two bits always share a point that is one flip
or none away from both, and a point has 65 fingerprints around it at most. So no
key makes more pairs than its fingerprints times a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, fields, never_broadcast, unique_name
from gristmill.llm.components import components

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2
#: Bits of a segment, and fingerprints that share a segment's value before they are matched by points.
SEGMENT, LARGE = 32, 256
#: Shingles that are hashed before their bits are added up.
PIECE = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both for ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        spans = zip(starts[at:min(n, at + PIECE)].tolist(), last[at:at + PIECE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > n).astype(object)).sum()) if (2 * ones > n).any() else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (fingerprint as a signed long) and text_hash of each row of ``docs`` (doc_id, text); null texts have no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py() or "") for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(hashed, fields(doc_id=kind, fp="long", text_hash="long"))


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def near_points(distinct: DataFrame) -> DataFrame:
    """(a, b) pairs of fingerprints (column fp) that connect all within ``MAX_DISTANCE`` bits, by points that are a flip away.

    At each point the smallest fingerprint is linked with the others there: each
    pair around a point is within distance, so the links join what pairs would.
    """
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << bit))) for bit in range(64)])
    points = distinct.select("fp", F.explode(ball).alias("point"))
    met = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")).distinct()


def candidates(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) pairs of fingerprints (column fp) that may be within ``MAX_DISTANCE`` bits; those that are are joined by such pairs.

    A key is a segment's value, with the number of the segment above it.
    """
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    second = F.lit(1 << SEGMENT)
    # spread before each row becomes many, in as many partitions as the join has
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    tables = spread.select("fp", F.explode(F.array(low, high.bitwiseOR(second))).alias("key"))
    sizes = tables.groupBy("key").agg(F.count(F.lit(1)).alias("size"))

    def ball(value: Column, mark: Column | None) -> list[Column]:
        flipped = [F.when(value.bitwiseAND(F.lit(1 << k)) != 0, value.bitwiseXOR(F.lit(1 << k))) for k in range(SEGMENT)]
        return [x if mark is None else x.bitwiseOR(mark) for x in [value, *flipped]]

    asked = spread.select("fp", F.explode(F.filter(F.array(*ball(low, None), *ball(high, second)), lambda k: k.isNotNull())).alias("key"))
    known = never_broadcast(tables).join(sizes, "key").select("key", F.col("fp").alias("b"), "size")
    fetched = never_broadcast(asked.select("key", F.col("fp").alias("a"))).join(known.where(F.col("size") <= large), "key").where("a != b")
    pairs = fetched.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = never_broadcast(asked).join(sizes.where(F.col("size") > large).select("key"), "key", "left_semi").select("fp").distinct()
    return pairs.union(near_points(crowded))


def links(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column fp) that connect all within ``MAX_DISTANCE`` bits, each pair verified."""
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return candidates(distinct, large).where(distance <= MAX_DISTANCE).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, component and text_hash of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of at most two bits reach,
    the row's own included; component (the smallest fingerprint, as a long)
    tells groups apart where doc_ids repeat. Texts without words share the fingerprint 0 and link
    like others. A null doc_id is never a component's smallest unless there is
    no other, and then component_id is null. Texts of any length are read whole.
    Repeated rows each get their row; an empty table gives none.
    """
    marked = checkpointed(fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp")))
    least = distinct.join(found, F.col("fp") == F.col("vertex"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    # pre-aggregated by fingerprint; the hot component has one row for each of its tasks in the shuffle
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    known = least.join(smallest, "component").select("fp", "component_id", "component")
    # one row for each fingerprint on the right, so Spark may split a fingerprint with many copies on the left
    return marked.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "text_hash")


def first_of_each(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of each component of ``assigned`` (doc_id, text_hash, component), all columns of ``docs``: the one with the smallest doc_id.

    Of equal doc_ids the smallest hash of the text stays, and of rows equal in
    both any one; a null doc_id stays only where a group has no other.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("text_hash"))
    key = [f"_{name}_{unique_name()}" for name in ("id", "null", "hash")]  # no column of docs has such a name
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    kept = assigned.groupBy("component").agg(F.min(rank).alias("first")).select(
        F.coalesce("first.doc_id", none).alias(key[0]), F.col("first.last").alias(key[1]), F.col("first.text_hash").alias(key[2]))
    keyed = docs.withColumns(dict(zip(key, (F.coalesce("doc_id", none), F.col("doc_id").isNull(), F.xxhash64("text")), strict=True)))
    return keyed.join(kept.distinct(), key, "left_semi").dropDuplicates(key).drop(*key)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates; see ``first_of_each``."""
    return first_of_each(docs, near_duplicates(docs))
