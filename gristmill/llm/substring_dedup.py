"""Substring deduplication by Rabin-Karp windows (operator 5).

Every window of a fixed number of words has a polynomial hash of its words'
hashes. Groups of documents ask for each of their windows whether a smaller
doc_id elsewhere has it; with what they know themselves, that tells which
windows go. Windows that go and overlap or touch are one removal interval.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.exchange import answered, asked, dealt, hash_words, mixed, parts_for, runs, unpacked, unsqueezed

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``size`` words, modulo 2**64."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    rolled = hashes[:n].copy()
    for k in range(1, size):
        rolled *= BASE
        rolled += hashes[k:n + k]
    return mixed(rolled)


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal (first word, word after the last) of windows at sorted ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > size)
    firsts, lasts = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + size
    return list(zip(firsts.tolist(), lasts.tolist(), strict=True))


def remove_repeats(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove words in windows that also start in a document with a smaller doc_id.

    For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed,
    kept_sha256 (of the kept words, joined by one space), removed (intervals as
    first:end in words, comma-joined) and, ``with_text``, kept_text.

    A null text has no words. A null doc_id has the place of the largest one,
    2**63 - 1, and rows with equal places don't remove each other's words. Texts shorter than
    a window lose nothing, texts of any length are read whole; repeated rows each
    get their row; an empty table gives no rows; other columns are ignored. Two windows that differ share a hash with a chance of 2**-64.
    """
    n = parts_for(docs)
    grouped = dealt(docs, n)

    def windows(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each window, its document's id, where each document's windows end)."""
        words, sizes = hash_words(texts)
        ends = np.cumsum(sizes)
        whole = np.arange(len(words) - size + 1) + size <= np.repeat(ends, sizes)[:max(0, len(words) - size + 1)]
        found = np.maximum(sizes - size + 1, 0)
        return window_hashes(words, size)[whole], np.repeat(ids, found), np.cumsum(found)

    def least_ids(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct window of a group, and the smallest id that has it, in the order of its first place."""
        ids, _, texts = unpacked(rows)
        by_id = np.argsort(ids, kind="stable")
        keys, ids, _ = windows(ids[by_id], [texts[k] for k in by_id])
        order = np.argsort(keys)
        at = runs(keys[order])
        # ids rise with the place, so the first place has the smallest; in that order ids compress well
        first = np.sort(np.minimum.reduceat(order, at)) if len(at) else order
        return keys[first], ids[first]

    def repeated(keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each question its keys that another group has with a smaller id."""
        order = np.argsort(keys)
        at = runs(keys[order])
        least = np.minimum.reduceat(ids[order], at) if len(at) else ids
        smaller = np.zeros(len(keys), bool)
        smaller[order] = ids[order] > np.repeat(least, np.diff(np.append(at, len(keys))))
        return [keys[a:b][smaller[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def removed(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        elsewhere = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unsqueezed(x, np.uint64) for x in told["told"])]))
        doc_ids, known, texts = unpacked(rows)
        keys, ids, ends = windows(doc_ids, texts)
        order = np.argsort(keys)
        at = runs(keys[order])
        gone_windows = np.zeros(len(keys), bool)
        if len(at):
            times = np.diff(np.append(at, len(keys)))
            least = np.minimum.reduceat(ids[order], at)
            distinct = keys[order[at]]
            place = np.minimum(np.searchsorted(elsewhere, distinct), max(0, len(elsewhere) - 1))
            before = elsewhere[place] == distinct if len(elsewhere) else np.zeros(len(distinct), bool)
            gone_windows[order] = (ids[order] > np.repeat(least, times)) | np.repeat(before, times)
        out = []
        for doc_id, has_id, text, a, b in zip(doc_ids.tolist(), known.tolist(), texts, np.append(0, ends[:-1]), ends, strict=True):
            words = text.split()
            gone = np.zeros(len(words), bool)
            spans = intervals(np.flatnonzero(gone_windows[a:b]), size)
            for first, after in spans:
                gone[first:after] = True
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words)
            out.append((doc_id, has_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                        ",".join(f"{a}:{b}" for a, b in spans), kept.decode("utf-8", "replace") if with_text else None))
        return pd.DataFrame(out, columns=["id", "known", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    questions = asked(grouped, n, least_ids)
    told = answered(questions, repeated, np.int64)
    out = grouped.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(
        removed, "id long, known boolean, n_words long, n_removed long, kept_sha256 string, removed string, kept_text string")
    columns = ["n_words", "n_removed", "kept_sha256", "removed", *["kept_text"] * with_text]
    return out.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), *columns)
