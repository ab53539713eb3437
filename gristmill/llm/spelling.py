"""Spelling variants of the words of a corpus, by permuterm rotations.

A word of L letters with a terminator behind it has L + 1 rotations. Words
that differ in one letter share a rotation up to that letter, and a word that
lacks the letter has all that is left as a rotation of its own. So rotations
are sorted by what stands before their last letter, and each range of equal
keys is scanned for neighbours: it has one row for each last letter at most,
and one for the whole word that lacks it, so no range grows with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter.
DAMAGE = 97
#: A form is at least so many times as frequent.
FORM_FACTOR = 2
END = "$"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters of a text that are cut into words at once, and distinct words that a task holds before it sends their counts.
PIECE, HELD = 1 << 20, 1 << 17
#: Steps to the root after which a chain counts as broken; counts at least double along it.
MAX_STEPS = 64


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z lower-cased, piece by piece; a piece ends where no run is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            over = RUN.match(text, end)
            end = over.end() if over else end
        yield [x if x.islower() else x.translate(LOWER) for x in RUN.findall(text, at, end)]
        at = end


LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def damaged(doc_id: object, run: str) -> str:
    """The run as it counts in a document: one in ``DAMAGE`` lacks a letter. A null doc_id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % DAMAGE == 0 else run


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found in runs(text.as_py() or ""):
                    own: dict[str, int] = {}
                    for run in found:
                        own[run] = own.get(run, 0) + 1
                    for run, n in own.items():
                        word = damaged(doc_id, run)
                        if len(word) >= LEAST_LETTERS:
                            held[word] = held.get(word, 0) + n
                    if len(held) >= HELD:
                        yield sent()
                        held.clear()
        yield sent()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(key, letter, single, word, n): the rotations of ``words`` by what stands before their last letter.

    The whole rotation of a word, as the one that lacks a letter of others, has a
    null letter. Of equal letters in a row, ``single`` marks the first: the
    others lack nothing else than it does.
    """
    size, word, i = F.length("word"), F.col("word"), F.col("i")
    marked = words.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("word") + 1)))
    # place i from 1: the letter at i ends the rotation; L + 1 is the terminator, which is never left out
    tail, head = F.substring(word, i + 1, size), F.substring(word, F.lit(1), i - 1)
    letter = F.substring(word, i, F.lit(1))
    cut = marked.where(i <= size).select(
        F.concat(tail, F.lit(END), head).alias("key"), letter.alias("letter"),
        ((i == 1) | (letter != F.substring(word, i - 1, F.lit(1)))).alias("single"), "word", "n")
    whole = marked.select(F.concat(F.substring(word, i, size), F.lit(END), head).alias("key"), F.lit(None).cast("string").alias("letter"),
                          F.lit(True).alias("single"), "word", "n")
    return cut.union(whole)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of ``words`` (word, n) that one inserted, deleted or replaced letter parts, once."""
    row = F.struct("letter", "single", "word", "n")
    ranges = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("rows")).where(F.size("rows") > 1)
    one = ranges.select("rows", F.explode("rows").alias("a"))
    both = one.select("a", F.explode("rows").alias("b"))
    letters = F.col("a.letter").isNotNull() & F.col("b.letter").isNotNull() & (F.col("a.word") != F.col("b.word"))
    indel = (F.col("a.letter").isNull() != F.col("b.letter").isNull()) & F.col("a.single") & F.col("b.single")
    return both.where(letters | indel).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"),
                                              F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of ``docs`` (doc_id, text); other columns are not read.

    Words are the maximal runs of ASCII and Latin-1 letters, A-Z lower-cased, with
    5 letters and 3 occurrences at least; by a checksum of doc_id and run, one
    run in 97 has lost a letter before it is counted (a null doc_id counts as
    an empty one). A word's form is the most frequent word that one inserted,
    deleted or replaced letter away, of equal ones the first in code-point
    order, if it occurs twice as often; root follows forms to the last. Null and
    empty texts have no words, repeated rows count again, texts of any length are
    read whole; an empty table gives no rows.
    """
    words = checkpointed(word_counts(docs))
    near = neighbours(words)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    of = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(of, "word", "left").withColumn("best", F.when(F.col("best.near_n") >= FORM_FACTOR * F.col("n"), F.col("best")))
    known = checkpointed(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                      F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")))
    steps = checkpointed(known.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(MAX_STEPS):
        # paths halve, so a few rounds reach every root
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = checkpointed(steps.join(ahead, "root").select("word", "root", "_next"))
        moved = after.where("root != _next").limit(1).count()
        steps = after.select("word", F.col("_next").alias("root"))
        if not moved:
            return known.join(steps, "word").select("word", "n", "n_near", "form", "form_n", "root")
    raise RuntimeError("a chain of forms has no end")
