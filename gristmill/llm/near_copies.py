"""Near-duplicates by the Jaccard similarity of word shingles (the pipeline's near-dedup).

Each text has a SimHash fingerprint of its shingles. Fingerprints within two
bits are found by the tables of segments of operator 6, and texts that have them
meet at a point. A similarity of 0.8 may differ in up to about 17 of 64 bits,
which no table of segments finds without also matching unrelated texts. So each
text has ``BANDS`` points of ``ROWS`` minima besides: two texts of similarity s
share one with a chance of 1 - (1 - s**ROWS)**BANDS. Each candidate pair, of
fingerprints or minima, is verified on its complete shingle sets before it is
linked.

Groups of n near copies do not make n * n pairs. At each point the smallest
text is held against the others; then, at points that still have several
components, a task counts what the sets of two blocks of the point share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.blocks import in_blocks
from gristmill.llm.common import checkpointed, counted, fields, never_broadcast
from gristmill.llm.components import components
from gristmill.llm.exchange import hash_words, mixed, packed_keys, unpacked_keys
from gristmill.llm.lm_scoring import STEP, ngrams
from gristmill.llm.simhash import fingerprint, first_of_each, links

SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 is missed with a chance of 6e-6, one of 0.85 with 4e-9.
BANDS, ROWS = 40, 6
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
TERMS = mixed(FACTORS)
#: Shingles whose minima are taken at once.
PIECE = 512
#: Leading bits of a shingle's hash that are kept where sets are compared.
KEPT_BITS = 40
#: Shingles of the sets of one block of a point, on average.
BLOCK_SHINGLES = 1 << 18


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z lower-cased; shorter texts are one shingle."""
    words, sizes = hash_words(x.lower() for x in texts)
    parts = np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else []
    return [np.unique(ngrams(h, min(size, len(h)))) if len(h) else h for h in parts]


def points(keys: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band; none without shingles."""
    if not len(keys):
        return keys
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(keys), PIECE):
        least = np.minimum(least, (FACTORS[:, None] * keys[at:at + PIECE] + TERMS[:, None]).min(1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out + STEP) + row
    return mixed(out)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (hash of the words), n (shingles), points and fp (fingerprint as a signed long) of each row of ``docs``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py() or "", SHINGLE) for x in batch.column(1)], np.uint64)
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            sets = shingle_sets(texts)
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join(x.lower().split())) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([points(x).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(marks.view(np.int64))],
                ["doc_id", "text_hash", "node", "n", "points", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        mark, fields(doc_id=kind, text_hash="long", node="long", n="long", points="array<long>", fp="long"))


def fingerprint_points(marked: DataFrame) -> DataFrame:
    """(node, n, text_hash, point): what has fingerprints within two bits meets at a point; texts without words are left out.

    ``links`` connects two such fingerprints, or both with a third; so a
    fingerprint stands at its own point and at that of the smaller one of each link.
    """
    nodes = marked.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"))
    distinct = checkpointed(nodes.select("fp").distinct())
    # written, so that what the search has shuffled is gone before the points are joined
    near = checkpointed(links(distinct).select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("at")))
    around = distinct.select("fp", F.col("fp").alias("at")).union(near)
    return checkpointed(nodes.join(around, "fp").select("node", "n", "text_hash", F.xxhash64(F.lit("fingerprint"), "at").alias("point")))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, keys): the shingles of each row of ``texts`` (node, text), as packed differences of the leading bits of their hashes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(1).cast(pa.binary())])
            packed = [packed_keys(np.unique(x >> np.uint64(64 - KEPT_BITS))) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "keys"])

    return texts.mapInArrow(collect, "node long, keys binary")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, and their sets) that are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike, held = [], (None, None)
            for a, set_a, set_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if held[0] != a:
                    held = a, unpacked_keys(set_a)
                other = unpacked_keys(set_b)
                common = len(np.intersect1d(held[1], other, assume_unique=True))
                alike.append(common >= least * (len(held[1]) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.select("a", "b", "_a", "_b").mapInArrow(verify, "a long, b long")


def similar_pairs(nodes: list[int], components: list[int], sets: list[np.ndarray], least: float, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of nodes of different components whose sets have a similarity of ``least`` or more; one that joins each two components will do.

    With ``sides`` that differ only pairs across them count.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, key = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(key, kind="stable")
    ends = np.cumsum(np.bincount(key))
    starts, holders = ends - np.bincount(key), owner[order]
    edges = np.cumsum(sizes)
    _, label = np.unique(np.array(components, np.int64), return_inverse=True)
    side = np.array(sides if sides is not None else [0] * len(sets))
    two = len(np.unique(side)) > 1
    out = []
    for k in range(len(sets)):
        own = key[edges[k] - sizes[k]:edges[k]]
        common = np.bincount(np.concatenate([holders[starts[x]:ends[x]] for x in own]), minlength=len(sets))
        across = side > side[k] if two else np.arange(len(sets)) > k
        near = np.flatnonzero((common >= least * (sizes + sizes[k] - common)) & (label != label[k]) & across)
        for other in near.tolist():
            if label[other] != label[k]:
                out.append((nodes[k], nodes[other]))
                label[label == label[other]] = label[k]
    return out


def near_copies(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """doc_id, text_hash and component of each row of ``docs`` (doc_id, text).

    Texts are linked where the Jaccard similarity of their sets of five-word
    shingles is ``least`` or more; a component (a long) is what links join. Pairs
    whose fingerprints are within two bits are all held against each other.
    Texts with the same words are in one component, texts without words too.
    Repeated rows each get their row; an empty table gives none. Texts of any length are
    read whole, other columns are ignored. A pair at 0.8 is
    missed with a chance of 6e-6 (see ``BANDS``). Different shingles share what
    is kept of their hashes with a chance of 2**-40, so sets of 1000 shingles look
    one shingle more alike than they are with a chance of 1e-6.
    """
    marked = checkpointed(_marked(docs))
    nodes = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("points").alias("points"), F.min("text_hash").alias("text_hash"))
    at = nodes.select("node", "n", "text_hash", F.explode("points").alias("point")).union(fingerprint_points(marked))
    shared = at.groupBy("point").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = checkpointed(never_broadcast(at).join(shared.select("point", "first"), "point"))
    wanted = met.select("node", "text_hash").distinct()
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash")
    sets = checkpointed(_sets(texts.select("node", "text")).dropDuplicates(["node"]))

    def fits(a: str, b: str) -> F.Column:
        return F.least(a, b) >= F.lit(least) * F.greatest(a, b)

    def verified(pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` that are similar enough."""
        # b is joined first: then the hot a of a large group has large rows, which Spark may split
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("keys").alias("_b")), "b").join(
            sets.select(F.col("node").alias("a"), F.col("keys").alias("_a")), "a")
        return checkpointed(_verified(both, least))

    first = met.where((F.col("node") != F.col("first.node")) & fits("n", "first.n")).select(
        F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(first)
    found = components(links)
    # what is at one point in different components, in blocks of a bounded number of shingles
    known = found.select(F.col("vertex").alias("node"), "component")
    at_once = never_broadcast(in_blocks(met.select("point", "node", "n"), known, BLOCK_SHINGLES)).join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(similar_pairs(rows["node"].tolist(), rows["component"].tolist(), [unpacked_keys(x) for x in rows["keys"]], least, rows["side"].tolist()),
                            columns=["a", "b"])

    # each set travels once for each block that it meets, not once for each pair
    more = checkpointed(at_once.groupBy("point", "i", "j").applyInPandas(compare, "a long, b long").distinct())
    if counted(more.limit(1)):
        found = components(links.union(more))
    assigned = marked.select("doc_id", "text_hash", "node").join(found.select(F.col("vertex").alias("node"), "component"), "node", "left")
    return assigned.select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def without_near_copies(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """One row of each group of near copies, all columns of ``docs``; see ``near_copies`` and ``first_of_each``."""
    return first_of_each(docs, near_copies(docs, least))
