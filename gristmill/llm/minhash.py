"""Near-duplicates by MinHash with sequential Bayesian verification.

Each distinct text has ``BANDS`` points of ``ROWS`` minima each; texts that share
a point are candidates. A candidate pair is held against each other in batches
of ``BATCH`` further minima: after each batch the posterior of its similarity,
from a uniform prior, tells whether it may still reach the threshold; a pair
whose chance of that falls below ``MISS`` is dropped. What survives is verified
on the full shingle sets.

Groups of n near copies do not make n * n pairs. At each point one text, the one
that shares most points with others, is held against the rest. Points at
which several components are left are compared in blocks: a task sees the
sets of two blocks of a point, of bounded bytes on average, and returns at most
a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.blocks import in_blocks
from gristmill.llm.common import checkpointed, fields, small
from gristmill.llm.components import components
from gristmill.llm.exchange import mixed
from gristmill.llm.lm_scoring import STEP
from gristmill.llm.near_copies import shingle_sets

SHINGLE, LEAST_PERCENT = 5, 85
#: A pair at 0.85 shares no point with a chance of 1.3e-7, one at 0.9 with 5e-13.
BANDS, ROWS = 50, 8
#: Minima that verify, apart from those of the points; 16 bits of each are kept.
SIGNATURE, BATCH = 128, 16
#: A pair is dropped once its similarity reaches the threshold with a chance below this.
MISS = 1e-7
#: Shingles whose minima are taken at once.
PIECE = 128
#: Shingles of the sets of one block of a point, on average.
BLOCK_SHINGLES = 1 << 18
FACTORS = mixed(np.arange(1, BANDS * ROWS + SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
TERMS = mixed(FACTORS)


def least_matches(percent: int = LEAST_PERCENT, miss: float = MISS) -> list[int]:
    """For each batch of minima the matches so far that a pair needs to stay.

    With m of h minima equal and a uniform prior the similarity is at least t
    with the chance that a binomial of h + 1 trials at t is at most m.
    """
    t, out = percent / 100, []
    for h in range(BATCH, SIGNATURE + 1, BATCH):
        chance, m = 0.0, 0
        while m <= h:
            chance += math.comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append(m)
    return out


def minima(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, signature) of a set of shingles; none without shingles."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(keys), PIECE):
        least = np.minimum(least, (FACTORS[:, None] * keys[at:at + PIECE] + TERMS[:, None]).min(1))
    least = mixed(least)  # minima are small numbers, so their leading bits say little
    points = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        points = mixed(points + STEP) + row
    return mixed(points), least[BANDS * ROWS:].astype(np.uint16)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (hash of the words), n (shingles), points and signature of each row of ``docs``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            sets = shingle_sets(texts, SHINGLE)
            found = [minima(x) for x in sets]
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join(x.lower().split())) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([p.view(np.int64) for p, _ in found], pa.list_(pa.int64())), pa.array([s.tobytes() for _, s in found], pa.binary())],
                ["doc_id", "text_hash", "node", "n", "points", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        mark, fields(doc_id=kind, text_hash="long", node="long", n="long", points="array<long>", signature="binary"))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, keys): the hashes of the shingles of each row of ``texts`` (node, text), sorted."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(1).cast(pa.binary())], SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "keys"])

    return texts.mapInArrow(collect, "node long, keys binary")


def possible(one: np.ndarray, others: np.ndarray, needed: list[int]) -> np.ndarray:
    """Places of the rows of ``others`` (signatures) that stay when held against ``one`` batch by batch."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for k, least in enumerate(needed):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (others[left, at] == one[at]).sum(1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def _survivors(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, and their signatures) that no batch drops."""
    needed = least_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for k in (2, 3))
            equal = np.cumsum((one == other).reshape(-1, SIGNATURE // BATCH, BATCH).sum(2), 1)
            yield batch.select(["a", "b"]).filter(pa.array((equal >= np.array(needed)).all(1)))

    return pairs.select("a", "b", "_a", "_b").mapInArrow(prune, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, and their sets) that are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.select("a", "b", "_a", "_b").mapInArrow(verify, "a long, b long")


def forest(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray],
           percent: int, needed: list[int]) -> list[tuple[int, int]]:
    """Links that join what is similar enough among the rows: of different labels, and of one row of each side if there are two sides."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, keys = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    held = np.zeros(keys.max() + 1 if len(keys) else 0, bool)
    _, label = np.unique(labels, return_inverse=True)
    two = len(np.unique(sides)) > 1
    out = []
    for k in range(len(sets)):
        fit = (label != label[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
        fit &= (sides > sides[k]) if two else (np.arange(len(sets)) > k)
        at = np.flatnonzero(fit)
        at = at[possible(signatures[k], signatures[at], needed)]
        if not len(at):
            continue
        own = keys[starts[k]:starts[k] + sizes[k]]
        held[own] = True
        common = np.array([np.count_nonzero(held[keys[starts[x]:starts[x] + sizes[x]]]) for x in at], np.int64)
        held[own] = False
        for other in at[100 * common >= percent * (sizes[at] + sizes[k] - common)].tolist():
            if label[other] != label[k]:
                out.append((int(nodes[k]), int(nodes[other])))
                label[label == label[other]] = label[k]
    return out


def _in_blocks(met: DataFrame, known: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet at points of ``met`` (point, node, n), by blocks of each point.

    ``known`` has the component of nodes that have one already, ``wide`` the set and signature of each node.
    """
    keyed = in_blocks(met, known, BLOCK_SHINGLES).join(wide, "node")
    needed = least_matches(percent)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        signatures = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SIGNATURE)
        return pd.DataFrame(forest(rows["node"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy(), signatures,
                                   [np.frombuffer(x, np.uint64) for x in rows["keys"]], percent, needed), columns=["a", "b"])

    return keyed.groupBy("point", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def minhash_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text); other columns are not read.

    Texts are linked where 100 times the common shingles of five words (A-Z
    lower-cased) is ``percent`` times all of both or more; a text of fewer words
    is one shingle. component_id is the smallest doc_id that links reach, the
    row's own included; kept says whether it is the row's own. Null texts, and
    texts without words, have no shingles and are linked with nothing. A null
    doc_id is a component's smallest only if there is no other, and then
    component_id is null and the rows are kept. Repeated rows each get their row,
    rows that repeat a doc_id are told apart by text. Texts of any length are
    read whole; an empty table gives no rows. Words are compared by 64-bit hashes.

    A link at the threshold is missed with a chance of 1.3e-7 for want of a common
    point, and of some 1e-6 by the batches; see ``BANDS`` and ``MISS``.
    """
    marked = checkpointed(_marked(docs))
    rank = F.struct("n", "text_hash", "points", "signature")
    nodes = checkpointed(marked.where("n > 0").groupBy("node").agg(F.first(rank).alias("_r"), F.min("doc_id").alias("least")).select(
        "node", "least", "_r.*"))
    at = nodes.select("node", "n", F.explode("points").alias("point"))
    shared = at.groupBy("point").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = checkpointed(at.join(shared, "point"))
    # what shares most is held against the rest of a point
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    first = met.join(weight, "node").groupBy("point").agg(F.max(F.struct("weight", "node", "n")).alias("first"))
    few = F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent
    pairs = met.join(first, "point").where((F.col("node") != F.col("first.node")) & few).select(
        F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    signs = nodes.join(weight, "node", "left_semi").select("node", "signature")

    def with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
        # b is joined first: then the hot a of a large group has large rows, which Spark may split
        return pairs.join(rows.select(F.col("node").alias("b"), F.col(column).alias("_b")), "b").join(
            rows.select(F.col("node").alias("a"), F.col(column).alias("_a")), "a")

    wanted = small(nodes.join(weight, "node", "left_semi").select("node", "text_hash"))
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash")
    sets = checkpointed(_sets(texts.select("node", "text")).dropDuplicates(["node"]))
    left = checkpointed(_survivors(with_both(pairs, signs, "signature"), percent))
    links = checkpointed(_verified(with_both(left, sets, "keys"), percent))
    found = components(links)
    more = checkpointed(_in_blocks(met, found.select(F.col("vertex").alias("node"), "component"), sets.join(signs, "node"), percent))
    if more.limit(1).count():
        found = components(links.union(more))
    of_node = nodes.join(found, F.col("node") == F.col("vertex"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of_node.join(smallest, "component").select("node", "component_id")
    alone = F.col("n") == 0
    out = marked.select("doc_id", "node", "n").join(known, "node", "left")
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
