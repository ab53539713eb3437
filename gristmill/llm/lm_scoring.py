"""Language-model scores by stupid backoff (operator 4).

Counts are leave-one-out: an n-gram counts as often as it occurs in all other
documents, so a document's own words don't vouch for themselves. n-grams are
hashed and dealt to buckets by hash; a bucket adds up the counts that groups of
documents send and joins the totals back to the n-grams of each group. Each
document sums the logarithms of its words' scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed
from gristmill.llm.exchange import answered, asked, by_bucket, dealt, hash_words, mixed, packed_counts, parts_for, runs, unpacked, unpacked_counts, unsqueezed

#: The longest n-gram and the factor for each step back.
ORDER, ALPHA = 3, 0.4
STEP = np.uint64(0xD6E8FEB86659FD93)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each word from the n-th on; of different n differ."""
    rolled = hashes[:max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        rolled = mixed(rolled + STEP) + hashes[k:len(hashes) - n + 1 + k]
    return mixed(rolled + np.uint64(n))


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Stupid-backoff scores of each row of ``docs`` (doc_id, text) under counts of all other rows.

    A word's score is the count of the n-gram that ends at it over the count of
    the n-gram's words before it, for the longest n up to ``order`` that occurs
    elsewhere, times ``alpha`` for each step back; a single word's is its count
    over all other words. A word that no other document has counts as half a
    word after one more step. The first words of a text have shorter contexts.

    Returns doc_id, n_words, log_score (natural logarithm, summed), mean_score
    (a word's, null without words) and n_backoff (words not scored at the
    longest order that their place allows). A null text has no words; a null
    doc_id is kept; repeated rows are documents of their own; an empty table
    gives no rows. Texts of any length are read whole, other columns are ignored.
    Different n-grams share a hash with a chance of 2**-64.
    """
    n = parts_for(docs)
    grouped = dealt(docs, n)

    def hashed(texts: list[bytes]) -> list[np.ndarray]:
        words, sizes = hash_words(texts)
        return np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def counted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of all orders of a group with their counts."""
        keys = np.concatenate([np.zeros(0, np.uint64), *(ngrams(h, k) for h in hashed(unpacked(rows)[-1]) for k in range(1, order + 1))])
        keys.sort()
        at = runs(keys)
        return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint32)

    def totals(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each question the counts of its keys over all groups."""
        by_key = np.argsort(keys)
        at = runs(keys[by_key])
        sums = np.add.reduceat(counts[by_key].astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
        total = np.zeros(len(keys), np.uint64)
        total[by_key] = np.repeat(sums, np.diff(np.append(at, len(keys))))
        return [packed_counts(total[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def scored(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, known, texts = unpacked(rows)
        words = hashed(texts)
        grams = [ngrams(h, k) for h in words for k in range(1, order + 1)]
        sizes = np.array([len(x) for x in grams], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        del grams, texts
        by_key = np.argsort(keys, kind="stable").astype(np.int32)  # equal keys stay in the order of their documents
        key_order = keys[by_key]
        del keys
        document = np.repeat(np.arange(len(sizes), dtype=np.int32) // np.int32(order), sizes)[by_key]
        at = runs(key_order)
        distinct = key_order[at]
        total = np.zeros(len(distinct), np.int64)
        answers = dict(zip(told["bucket"], told["told"], strict=True))
        for bucket, places in by_bucket(distinct, n):
            total[places] = unpacked_counts(unsqueezed(answers[bucket], np.uint8), len(places))
        del distinct
        # occurrences of a key in one document lie together
        n_keys, changes = len(key_order), np.ones(len(key_order), bool)
        changes[1:] = (key_order[1:] != key_order[:-1]) | (document[1:] != document[:-1])
        del key_order, document
        own = np.diff(np.append(np.flatnonzero(changes), n_keys)).astype(np.int32)
        elsewhere = np.zeros(n_keys, np.int64)
        elsewhere[by_key] = np.repeat(total, np.diff(np.append(at, n_keys))) - np.repeat(own, own)
        del by_key, changes, own, total, at
        parts = np.split(elsewhere, np.cumsum(sizes)[:-1]) if len(sizes) else []
        out = []
        for number, (doc_id, has_id, hashes) in enumerate(zip(ids.tolist(), known.tolist(), words, strict=True)):
            size = len(hashes)
            others = parts[number * order:(number + 1) * order]
            # from single words upwards; a longer n-gram takes over where it occurs elsewhere
            single = others[0]
            value = np.where(single > 0, np.log(np.maximum(single, 0.5)), np.log(0.5 * alpha))
            over_all = np.ones(size, bool)  # still to be divided by the number of other words
            steps = np.zeros(size, np.int64)
            for k in range(2, order + 1):
                found = others[k - 1] > 0
                here = slice(k - 1, size)
                context = others[k - 2][:len(found)]
                value[here] = np.where(found, np.log(np.maximum(others[k - 1], 1) / np.maximum(context, 1)), value[here] + np.log(alpha))
                over_all[here] &= ~found
                steps[here] = np.where(found, 0, steps[here] + 1)
            out.append((doc_id, has_id, size, float(value.sum()), int(over_all.sum()), int((steps + (single <= 0) > 0).sum())))
        return pd.DataFrame(out, columns=["id", "known", "n_words", "part", "n_single", "n_backoff"])

    told = answered(asked(grouped, n, counted), totals, np.uint32)
    parts = checkpointed(grouped.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(
        scored, "id long, known boolean, n_words long, part double, n_single long, n_backoff long"))
    all_words = parts.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(all_words) - F.col("n_words"), F.lit(1))
    total = F.col("part") - F.col("n_single") * F.log(rest)
    return parts.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_words", total.alias("log_score"),
                        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"), "n_backoff")
