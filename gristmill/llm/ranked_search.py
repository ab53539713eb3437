"""Ranked lexical search: the best documents of a corpus for each of a set of items.

One pass over the documents writes their postings for the items' terms, and
the corpus counts come from these. Scoring takes the postings in shards of
documents: in a shard the short lists of an item are summed into accumulators
(term at a time), which then are one more list with a bound of its own; the
long lists and this one are read document at a time, in blocks of documents,
and lists that together can't lift a document into the best so far are only
probed for documents that others brought up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, fields

TOP = 10
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Characters of items that one pass over the documents seeks, on average.
BLOCK_CHARS = 8 << 20
#: Documents and postings of a shard at most (a document more than that is a shard of its own).
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Documents that are looked at together, and the share of a shard's documents that short lists have together.
SPAN, SHORT_SHARE = 4096, 8
#: Parts in which the best of tasks meet before they meet for an item.
PARTS = 64


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, A-Z lower-cased, piece by piece; a piece ends where no term is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            over = TERM.match(text, end)
            end = over.end() if over else end
        yield TERM.findall(text[at:end].lower())
        at = end


def counted(text: bytes | None) -> tuple[int, Counter]:
    """(number of terms, occurrences of each) of a text."""
    n, found = 0, Counter()
    for piece in terms(text or b""):
        n += len(piece)
        found.update(piece)
    return n, found


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the documents with a term at all; terms are those in ``numbers``, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one block of items, bounded by BLOCK_CHARS

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            sizes, own, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                n, found = counted(text.as_py())
                held = {of[t]: tf for t, tf in found.items() if t in of}
                sizes.append(n)
                own.append(list(held))
                tfs.append(list(held.values()))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(post, fields(doc_id=kind, n="long", terms="array<int>", tfs="array<long>"))


class Shard:
    """The lists of some documents in ascending order, by term: places of documents and what an occurrence is worth there."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> None:
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n)), sizes)
        worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.worth = doc[order], worth[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.ends = np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.worth, starts) if len(starts) else starts
        self.size = len(n)
        self.edges = np.append(np.arange(0, self.size, SPAN), self.size)

    def lists(self, own: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, scores, bound) of each term of an item that occurs here."""
        at = np.searchsorted(self.terms, own)
        here = np.flatnonzero((at < len(self.terms)) & (weight > 0))
        here = here[self.terms[at[here]] == own[here]]
        return [(self.doc[a:b], w * self.worth[a:b], int(w * most)) for a, b, w, most in zip(
            self.ends[at[here]], self.ends[at[here] + 1], weight[here], self.most[at[here]], strict=True)]

    def best(self, own: np.ndarray, weight: np.ndarray, top: int, floor: int) -> list[tuple[int, int]]:
        """(score, place) of the ``top`` documents of an item that score ``floor`` at least, and over 0; places ascend among equals."""
        found = sorted(self.lists(own, weight), key=lambda x: len(x[0]))
        # term at a time: the short lists become accumulators
        short = total = 0
        while short < len(found) and total + len(found[short][0]) <= self.size // SHORT_SHARE:
            total += len(found[short][0])
            short += 1
        iterators = found[short:]
        if short:
            doc, score = (np.concatenate([x[k] for x in found[:short]]) for k in (0, 1))
            order = np.argsort(doc, kind="stable")
            doc, starts = np.unique(doc[order], return_index=True)
            summed = np.add.reduceat(score[order], starts)
            iterators.append((doc, summed, int(summed.max())))
        if not iterators:
            return []
        # document at a time, by spans of documents
        iterators.sort(key=lambda x: x[2])
        reach = np.cumsum([x[2] for x in iterators])
        cuts = [np.searchsorted(x[0], self.edges) for x in iterators]
        held: list[tuple[int, int]] = []
        floor = max(floor, 1)
        for k, low in enumerate(self.edges[:-1].tolist()):
            # the first iterators can't reach the floor together: they bring up no documents
            needed = int(np.searchsorted(reach, floor))
            if needed == len(iterators):
                break
            score = np.zeros(self.edges[k + 1] - low, np.int64)
            for (doc, worth, _), cut in zip(iterators[needed:], cuts[needed:], strict=True):
                score[doc[cut[k]:cut[k + 1]] - low] += worth[cut[k]:cut[k + 1]]
            at = np.flatnonzero(score)
            score = score[at]
            for j in range(needed - 1, -1, -1):
                stay = score + reach[j] >= floor
                at, score = at[stay], score[stay]
                if not len(at):
                    break
                doc, worth = (x[cuts[j][k]:cuts[j][k + 1]] for x in iterators[j][:2])
                if len(doc):
                    place = np.minimum(np.searchsorted(doc, at + low), len(doc) - 1)
                    score = score + np.where(doc[place] == at + low, worth[place], 0)
            stay = np.flatnonzero(score >= floor)
            if len(stay) > top:
                stay = stay[np.argsort(-score[stay], kind="stable")[:top]]
            if len(stay):
                held = sorted([*held, *((-int(score[x]), int(at[x]) + low) for x in stay)])[:top]
                if len(held) == top:
                    floor = max(floor, -held[-1][0])
        return [(-score, place) for score, place in held]


def _rank_of(doc_id: object) -> tuple[bool, object]:
    """Null ids come last."""
    return (doc_id is None, 0 if doc_id is None else doc_id)


def _scored(posted: DataFrame, items: list[tuple], own: list[np.ndarray], weights: list[np.ndarray], n_docs: int, n_terms: int, top: int,
            item_kind: str) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each task for each item."""
    shared = posted.sparkSession.sparkContext.broadcast((items, own, weights))  # one block of items, bounded by BLOCK_CHARS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own, weights = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def score() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = rows.column("doc_id").to_pylist()
            rows = rows.take(pa.array(order := sorted(range(len(ids)), key=lambda k: _rank_of(ids[k])), pa.int64()))
            ids = [ids[k] for k in order]
            of, tf = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
            shard = Shard(rows.column("n").to_numpy(), of.value_lengths().to_numpy(), of.flatten().to_numpy(), tf.flatten().to_numpy(),
                          n_docs, n_terms)
            for k in range(len(items)):
                floor = best[k][-1][0] if len(best[k]) == top else 0
                if found := shard.best(own[k], weights[k], top, floor):
                    best[k] = sorted([*best[k], *((s, ids[place]) for s, place in found)], key=lambda x: (-x[0], _rank_of(x[1])))[:top]

        docs = posts = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs, posts = docs + part.num_rows, posts + len(part.column("terms").flatten())
                if docs >= SHARD_DOCS or posts >= SHARD_POSTINGS:
                    score()
                    docs = posts = 0
        if held:
            score()
        said = [(k, items[k][0], doc_id, s) for k, found in enumerate(best) for s, doc_id in found]
        columns = list(zip(*said, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, columns), strict=True)), schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = fields(item="long", item_id=item_kind, doc_id=posted.schema["doc_id"].dataType.simpleString(), score="long")
    schema = to_arrow_schema(kind)
    return posted.mapInArrow(search, kind)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The distinct items with a text, in blocks of about ``BLOCK_CHARS`` characters."""
    rows = items.where("text is not null").select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // BLOCK_CHARS + 1
    for block in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are maximal runs of ASCII letters and digits and other than ASCII
    characters, A-Z lower-cased; a null text has none. Scores are whole numbers: a term's weight, by
    the documents that have it, times its occurrences held against the length of
    the document, summed over the item's terms with repeats. Ranks start at 1 for
    each item; of equal scores the smaller doc_id comes first, null last. Only scores
    above 0 count, so items without terms have no rows.

    Repeated documents each count and rank. An item that is repeated whole counts
    once, items that share an id but not the text are each answered. Texts of any
    length are read whole, other columns are not read; empty tables give no rows.
    Each 8 million characters of items take one pass over the documents.
    """
    spark: SparkSession = docs.sparkSession
    item_kind, out = items.schema["item_id"].dataType.simpleString(), None
    for number, block in enumerate(_blocks(items)):
        found = [counted(text.encode())[1] for _, text in block]
        names = sorted(set().union(*found))
        numbers = {t: k for k, t in enumerate(names)}
        posted = checkpointed(postings(docs, numbers))
        n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for k, n in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[k] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        own = [np.array(sorted(numbers[t] for t in x), np.int64) for x in found]
        weights = [np.array([x[names[k]] for k in o.tolist()], np.int64) * weight[o] for x, o in zip(found, own, strict=True)]
        part = _scored(posted, [(i, None) for i, _ in block], own, weights, n_docs, max(n_terms, 1), top, item_kind).withColumn("block", F.lit(number))
        out = part if out is None else out.union(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # what tasks found meets in parts first, so that an item's rows in one task are few
    some = W.partitionBy("block", "item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    few = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
