"""Quality classifier by perplexity under a model of trusted text (operator 7).

An interpolated modified Kneser-Ney model of the words of each language is
trained on all trusted documents but those held out for the thresholds; its
n-grams are counted in buckets of bounded size. In logarithms the probability
of a text is a sum over all its n-grams of what each changes: against the order
below, and as a context of what follows it. So the model is a table of these
values, partitioned by hash; the documents' n-grams are joined with it and added
up by document. Documents that are more, or less, surprising than nearly all
trusted documents of their language that the model has not seen are rejected.

The most common words and n-grams of the model are looked up where the
documents are read; so no key of the join is hot. A Bloom filter, in parts that
are made in tasks, keeps n-grams that the model doesn't have out of the join; of
what is sent to the tasks only the filter grows with the corpus, by two to four
bytes for each n-gram of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, counted, fields, forget, like_string, made_once, removed, small, small_batches, stored, unique_name
from gristmill.llm.exchange import by_bucket, hash_words, mixed, packed_keys, squeezed, unpacked_keys, unsqueezed
from gristmill.llm.kneser_ney import START, HashArray, rolled, text_hash

#: Words of an n-gram, and the least count of n-grams of two words or more.
ORDER, LEAST = 3, 2
#: Bits of a word's hash that are left out; 40 stay, so two words of a language are taken for one with a chance of 2**-40.
SHIFT = np.uint64(24)
#: Bytes of text whose n-grams a task counts at once, and bytes of all documents for each bucket of n-grams.
COUNTED, BUCKET_BYTES = 4 << 20, 16 << 20
#: One of so many trusted documents never trains the model, so that thresholds can be set on it.
HELD_OUT = 4
#: A language's thresholds are these quantiles of bits a word: the lower of all its trusted documents, the upper of those held out.
QUANTILES = (0.002, 0.98)
#: Languages with fewer held-out documents take the thresholds of all languages together.
MIN_HELD_OUT = 20
#: Words and n-grams of the models that are looked up in the tasks, the most common ones.
FREQUENT = 1 << 21
#: Bits of the Bloom filter for each n-gram, hashes of an n-gram, and n-grams in a part of the filter.
FILTER_BITS, HASHES, FILTER_PART = 16, 4, 1 << 20
#: Words that are looked up at once.
PIECE = 1 << 17
#: Questions of a block of documents, about, before they are sent, and n-grams of the model in a bucket that answers them.
ASKED, BUCKET_KEYS = 1 << 20, 1 << 18
#: What ends a text. No word is equal to it.
END = "\n"


def trusted_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, held_out) of labelled documents of good quality that are not toxic.

    An id with contradicting labels is not trusted; null labels are not either.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")).where("good")
    known = docs.select("doc_id", like_string("lang").alias("lang")).distinct().join(good, "doc_id")
    return known.select("doc_id", "lang", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))


def training_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, h, data, size): the texts of all trusted documents that are not held out, compressed, dealt by their hash; one may occur more than once in its partition."""
    chosen = small(trusted.where("not held_out").select("doc_id", "lang"))
    texts = docs.select("doc_id", like_string("lang").alias("lang"), "text", F.xxhash64("text").alias("h")).join(chosen, ["doc_id", "lang"], "left_semi")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64())],
                ["lang", "h", "data", "size"])

    return texts.select("lang", "h", "text").mapInArrow(sent, "lang string, h long, data binary, size long").repartition("lang", "h")


def mark_hash(mark: str) -> np.uint64:
    return text_hash(f"mark {ord(mark)}")


def padded(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words and marks, place in its text, number of its text): texts of ``sizes`` words, each behind start marks and with an end mark."""
    lengths = sizes + ORDER
    number = np.repeat(np.arange(len(sizes)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    units = np.full(len(place), mark_hash(START) >> SHIFT)
    units[(place >= ORDER - 1) & (place < ORDER - 1 + np.repeat(sizes, lengths))] = words >> SHIFT
    units[np.cumsum(lengths) - 1] = mark_hash(END) >> SHIFT
    return units, place, number


def keys_of(units: np.ndarray, size: int, lang: str) -> np.ndarray:
    """A key of the ``size`` units that end at each place from the size-th on, in a language."""
    return mixed(rolled(units, size) ^ text_hash(lang))


def discounts(n: np.ndarray, least: int) -> np.ndarray:
    """What counts of 0, 1, 2 and more give up to the order below; counts below ``least`` all they have."""
    return discounts_of([float((n == k).sum()) for k in (1, 2, 3, 4)], least)


def discounts_of(counts: list[float], least: int) -> np.ndarray:
    """``discounts`` by the numbers of counts of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([0.0, *(float(k) if k < least else min(max(d, 0.1), k) for k, d in enumerate(raw, 1))])


def word_model(lang: str, words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], float]:
    """(keys, values, logarithms of the probabilities) of each order from the first on, and the value of an unknown word.

    Keys rise. What is only a context, as the start marks, has no probability; n-grams that change nothing are left out.
    This is the plain form, in one process, of what ``word_models`` works out in many tasks.
    """
    units, place, _ = padded(words, sizes)
    ends = np.flatnonzero(place >= ORDER - 1)
    grams = [np.zeros(len(ends), np.uint64), *(keys_of(units, k, lang)[ends - k + 1] for k in range(1, ORDER + 1))]
    heads = [np.zeros(len(ends), np.uint64), *(keys_of(units, k, lang)[ends - k] for k in range(1, ORDER))]
    levels, at = [], np.arange(len(ends))
    for k in range(ORDER, 0, -1):
        # one place of each n-gram, and its count: of places at the longest, of left neighbours at shorter ones
        _, first, n = np.unique(grams[k][at], return_index=True, return_counts=True)
        at = at[first]
        levels.insert(0, (at, n))
    below_keys, below_p = np.zeros(1, np.uint64), np.array([-np.log2(len(levels[0][0]) + 1.0)])
    keys, values, logs, unknown = [], [], [], 0.0
    for k, (at, n) in enumerate(levels, 1):
        d = discounts(n, least if k > 1 else 1)[np.minimum(n, 3)]
        contexts, of = np.unique(heads[k - 1][at], return_inverse=True)
        total, given_up = np.bincount(of, n), np.bincount(of, np.minimum(d, n))
        left = np.log2(given_up / total)
        below = left[of] + below_p[np.searchsorted(below_keys, grams[k - 1][at] if k > 1 else np.zeros(len(at), np.uint64))]
        p = np.log2(np.maximum(n - d, 0) / total[of] + 2.0**below)
        if k == 1:
            unknown = float(left[0] + below_p[0])
        else:
            # the contexts' weights belong to the values of the order below
            there = np.searchsorted(keys[-1], contexts)
            same = there < len(keys[-1])
            same[same] = keys[-1][there[same]] == contexts[same]
            values[-1][there[same]] += left[same]
            order = np.argsort(np.concatenate([keys[-1], contexts[~same]]), kind="stable")
            keys[-1] = np.concatenate([keys[-1], contexts[~same]])[order]
            values[-1] = np.concatenate([values[-1], left[~same]])[order]
            logs[-1] = np.concatenate([logs[-1], np.full((~same).sum(), np.nan)])[order]
        keys.append(grams[k][at])
        values.append(p if k == 1 else p - below)
        logs.append(p)
        below_keys, below_p = grams[k][at], p
    kept = [slice(None), *(x != 0 for x in values[1:])]
    return *([x[m] for x, m in zip(of, kept, strict=True)] for of in (keys, values, logs)), unknown


def planes(values: np.ndarray, kind: str) -> np.ndarray:
    """All lowest bytes of whole numbers, then all second ones."""
    values = np.ascontiguousarray(values.astype(kind))
    return values.view(np.uint8).reshape(-1, values.itemsize).T.ravel()


def packed(columns: list[np.ndarray], size: int) -> bytes:
    """Rows in the order of ``size`` columns of words, and counts behind them, in compressed byte planes: each distinct word once, and the words' places among those."""
    words, of = np.unique(np.concatenate(columns[:size]), return_inverse=True)
    of = of.reshape(size, -1).astype("<u4")
    of[0] = np.diff(of[0], prepend=np.uint32(0))  # it rises
    raw = np.concatenate([planes(np.diff(words, prepend=np.uint64(0)), "<u8"), *(planes(x, "<u4") for x in of), *(planes(x, "<u8") for x in columns[size:])])
    return len(columns[0]).to_bytes(8, "little") + len(words).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, size: int, n_counts: int) -> Iterator[np.ndarray]:
    """The columns that ``packed`` has packed, one at a time."""
    n, n_words = (int.from_bytes(data[k:k + 8], "little") for k in (0, 8))
    raw = np.frombuffer(pa.decompress(data[16:], 8 * n_words + (4 * size + 8 * n_counts) * n, "zstd", asbytes=True), np.uint8)
    edges = np.cumsum([0, 8 * n_words, *[4 * n] * size, *[8 * n] * n_counts])

    def column(k: int, kind: str, rows: int) -> np.ndarray:
        return np.ascontiguousarray(raw[edges[k]:edges[k + 1]].reshape(-1, rows).T).view(kind).ravel() if rows else np.zeros(0, kind)

    words = np.cumsum(column(0, "<u8", n_words), dtype=np.uint64)
    for k in range(size):
        of = column(1 + k, "<u4", n)
        yield words[np.cumsum(of, dtype=np.int64) if k == 0 else of]
    for k in range(n_counts):
        yield column(1 + size + k, "<u8", n)


def added_up(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in order, and the sums of their ``n``."""
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    starts = np.flatnonzero(changes(columns))
    return [x[starts] for x in columns], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out


def blocks(columns: list[np.ndarray], counts: list[np.ndarray], by: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) of rows in order, dealt by a hash."""
    bucket = (mixed(by) % np.uint64(n_buckets)).astype(np.int64)
    for k in np.unique(bucket).tolist():
        own = bucket == k
        yield k, packed([x[own].astype(np.uint64) for x in (*columns, *counts)], len(columns))


#: What a bucket says: n-grams that change something, contexts, counts of counts (in n, total, n1 and n2), and packed counts of the order below.
COUNTS = dict(lang="string", kind="string", size="int", **dict.fromkeys(("key", "tail", "n", "total", "n1", "n2", "n3", "bucket"), "long"), data="binary")


def counted_rows(lang: str, grams: list[np.ndarray], n: np.ndarray, kept: np.ndarray) -> list[dict]:
    """Columns of ``COUNTS`` of all n-grams (a column for each unit, in order) of some contexts; of n-grams only those ``kept``."""
    size = len(grams)
    key = lambda columns: keys_of(np.stack(columns, 1).ravel(), len(columns), lang)[::len(columns)].view(np.int64)
    changed = changes(grams[:-1])
    starts, of = np.flatnonzero(changed), np.cumsum(changed)[kept] - 1
    sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (n, n == 1, n == 2, n > 2)]
    # a context that leaves all changes nothing, but a word is looked up as one
    told = np.ones(len(starts), bool) if size == 2 else sums[2] + sums[3] > 0
    contexts = {"kind": "context", "size": size - 1, "key": key([x[starts[told]] for x in grams[:-1]])}
    own = [x[kept] for x in grams]
    names = ("total", "n1", "n2", "n3")
    found = {"kind": "gram", "size": size, "key": key(own), "tail": key(own[1:]), "n": n[kept].astype(np.int64)}
    counts = dict(zip(("n", "total", "n1", "n2"), ([int((n == k).sum())] for k in (1, 2, 3, 4)), strict=True))
    return [contexts | {c: x[told] for c, x in zip(names, sums, strict=True)},
            found | {c: x[of] for c, x in zip(names, sums, strict=True)},
            {"kind": "counts", "size": size} | counts]


def in_schema(lang: str, parts: list[dict]) -> pa.Table:
    """Rows of ``COUNTS`` by their columns; a column that is one text or number has it in each row, one that is missing is null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    tables = []
    for part in parts:
        n = next(len(x) for x in part.values() if not isinstance(x, str | int))
        told = {name: (part | {"lang": lang}).get(name) for name in COUNTS}
        tables.append(pa.table({name: pa.nulls(n, kinds[COUNTS[name]]) if x is None else pa.repeat(pa.scalar(x, kinds[COUNTS[name]]), n)
                                if isinstance(x, str | int) else pa.array(x, kinds[COUNTS[name]]) for name, x in told.items()}))
    return pa.concat_tables(tables)


def counts(texts: DataFrame, n_buckets: int) -> DataFrame:
    """``COUNTS`` of the model of ``training_texts``, each distinct text once.

    N-grams are dealt to buckets by their context, which is whole there; the
    distinct ones tell how often their tails have a left neighbour, and those
    counts are dealt by context once more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        held: dict[str, list[bytes]] = {}
        forget("lookup")  # of a model before this one

        def sent(lang: str) -> pa.RecordBatch:
            units, place, _ = padded(*hash_words(held.pop(lang)))
            ends = np.flatnonzero(place >= ORDER - 1)
            grams, n = added_up([units[ends - k] for k in range(ORDER - 1, -1, -1)], np.ones(len(ends), np.int64))
            found = list(blocks(grams, [n], mixed(grams[0]) + grams[1], n_buckets))
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "bucket": pa.array([k for k, _ in found], pa.int64()),
                                               "data": pa.array([x for _, x in found], pa.binary())})

        for batch in batches:
            for lang, h, data, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    held.setdefault(lang, []).append(pa.decompress(data, size, "zstd", asbytes=True))
                    if sum(map(len, held[lang])) >= COUNTED:
                        yield sent(lang)
        for lang in list(held):
            yield sent(lang)

    def merged(rows: pa.Table, size: int, n_counts: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
        data = rows["data"].to_pylist()
        ends = np.cumsum([int.from_bytes(x[:8], "little") for x in data]).tolist()
        columns = [np.empty(ends[-1], np.uint64) for _ in range(size + n_counts)]
        for block, start, end in zip(data, [0, *ends[:-1]], ends, strict=True):
            for whole, part in zip(columns, unpacked(block, size, n_counts), strict=True):
                whole[start:end] = part
        sums = [added_up(columns[:size], x.view(np.int64)) for x in columns[size:]]
        return sums[0][0], [x for _, x in sums]

    def sent_on(grams: list[np.ndarray], counts: list[np.ndarray]) -> dict:
        found = list(blocks(grams, counts, grams[0], n_buckets))
        return {"kind": "block", "bucket": [k for k, _ in found], "data": [x for _, x in found]}

    def longest(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        grams, (n,) = merged(rows, ORDER)
        kept = n >= LEAST
        # how many left neighbours a tail has here, and whether a kept n-gram asks for it
        tails, left = added_up(grams[1:], np.ones(len(n), np.int64))
        asked = added_up(grams[1:], kept.astype(np.int64))[1] > 0
        return in_schema(lang, [*counted_rows(lang, grams, n, kept), sent_on(tails, [left, asked])])

    def pairs(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        grams, (n, asked) = merged(rows, ORDER - 1, 2)
        words, left = added_up(grams[1:], np.ones(len(n), np.int64))
        return in_schema(lang, [*counted_rows(lang, grams, n, (n >= LEAST) | (asked > 0)), sent_on(words, [left])])

    def single(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        words, (n,) = merged(rows, 1)
        return in_schema(lang, [{"kind": "word", "size": 1, "key": keys_of(words[0], 1, lang).view(np.int64), "n": n}])

    dealt = texts.mapInArrow(count, "lang string, bucket long, data binary")
    out, kept = dealt, []
    for step in (longest, pairs, single):
        found = out.select("lang", "bucket", "data").groupBy("lang", "bucket").applyInArrow(step, fields(**COUNTS))
        kept.append(found.where("kind != 'block'").drop("bucket", "data"))
        out = found.where("kind = 'block'")
    return reduce(DataFrame.union, kept)


def word_models(texts: DataFrame, n_buckets: int) -> tuple[DataFrame, dict[str, float]]:
    """(key, value, base, n) of the n-grams and contexts of the models of ``training_texts``, and the value of an unknown word by language.

    The same values as ``word_model``; base is the value of an unknown word for words, else 0, and n says how common one is.
    """
    spark = texts.sparkSession
    with small_batches(spark):
        rows = stored(counts(texts, n_buckets))
    words = rows.where("kind = 'word'").select("lang", "key", "n")
    of = [F.sum((F.col("n") == k).cast("long")).alias(f"c{k}") for k in (1, 2, 3, 4)]
    known = [(r["lang"], 1, r) for r in words.groupBy("lang").agg(*of, F.sum("n").alias("total"), F.count(F.lit(1)).alias("known")).collect()]
    known += [(r["lang"], r["size"], r) for r in rows.where("kind = 'counts'").groupBy("lang", "size").agg(
        F.sum("n").alias("c1"), F.sum("total").alias("c2"), F.sum("n1").alias("c3"), F.sum("n2").alias("c4")).collect()]
    unknown, given = {}, []
    for lang, size, r in known:
        d = discounts_of([float(r[f"c{k}"]) for k in (1, 2, 3, 4)], LEAST if size > 1 else 1).tolist()
        total = base = None
        if size == 1:
            total = r["total"]
            left = d[1] * r["c1"] + d[2] * r["c2"] + d[3] * (r["known"] - r["c1"] - r["c2"])
            base = unknown[lang] = float(np.log2(left / total) - np.log2(r["known"] + 1.0))
        given.append((lang, size, *d[1:], total, base))
    d = F.broadcast(spark.createDataFrame(given, "lang string, size int, d1 double, d2 double, d3 double, all long, base double"))
    n, drop = F.col("n"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    two = F.lit(2.0)
    p1 = F.log2(F.greatest(n - drop, F.lit(0.0)) / F.col("all") + F.pow(two, F.col("base")))
    words = words.join(d.where("size = 1"), "lang").select("key", "n", p1.alias("p"), "base")

    given_up = F.least(F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3"), F.col("total"))
    left = F.log2(given_up / F.col("total"))
    contexts = rows.where("kind = 'context'").join(d.withColumn("size", F.col("size") - 1), ["lang", "size"]).select("size", "key", "total", left.alias("left"))
    # a context's words have the logarithm of their order below before it is changed
    grams = rows.where("kind = 'gram'").join(d, ["lang", "size"]).withColumns({"left": left, "own": F.greatest(n - drop, F.lit(0.0)) / F.col("total")})

    def gained(size: int, below: DataFrame) -> DataFrame:
        """(key, p, value, n) of the n-grams of an order by the (tail, below) of the one below; a count under ``LEAST`` adds nothing."""
        found = grams.where(F.col("size") == size).select("key", "tail", "n", "own", "left").join(below, "tail")
        p = F.when(n < LEAST, F.col("left") + F.col("below")).otherwise(F.log2(F.col("own") + F.pow(two, F.col("left") + F.col("below"))))
        return found.select("key", p.alias("p"), (p - F.col("left") - F.col("below")).alias("value"), "n")

    shorter = stored(gained(2, words.select(F.col("key").alias("tail"), F.col("p").alias("below"))))
    longer = gained(3, shorter.select(F.col("key").alias("tail"), F.col("p").alias("below")))
    shorter = shorter.where(n >= LEAST)
    zero = F.lit(0.0).alias("base")
    found = words.select("key", F.col("p").alias("value"), "base", "n")
    for part, value in ((shorter, "value"), (longer, "value"), (contexts.withColumnRenamed("total", "n"), "left")):
        found = found.union(part.select("key", F.col(value).alias("value"), zero, "n"))
    return found.groupBy("key").agg(F.sum("value").alias("value"), F.sum("base").alias("base"), F.max("n").alias("n")), unknown


def filter_slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        keys = mixed(keys + np.uint64(k + 1))
        yield (keys >> np.uint64(64 - bits)).astype(np.int64)


def filter_part(keys: np.ndarray) -> bytes:
    """A Bloom filter of keys, of a power of two bits."""
    bits = max(10, int(FILTER_BITS * len(keys)).bit_length())
    there = np.zeros(1 << bits, bool)
    for at in filter_slots(keys, bits):
        there[at] = True
    return np.packbits(there, bitorder="little").tobytes()


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the filter that has a key, by its leading bits; the number of parts is a power of two."""
    return (keys >> np.uint64(33)).astype(np.int64) >> (31 - (n_parts.bit_length() - 1))


class Lookup:
    """The frequent words and n-grams of the models, and a filter of all others.

    The filter comes as their keys, or in parts (a power of two) by their leading bits.
    """

    def __init__(self, near: tuple[np.ndarray, np.ndarray], far: np.ndarray | list[bytes], unknown: dict[str, float]):
        keys, values = near
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        self.near, self.unknown = HashArray(keys, values), unknown
        self.filter = [np.frombuffer(x, np.uint8) for x in ([filter_part(far)] if isinstance(far, np.ndarray) else far)]

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        part = part_of(keys, len(self.filter))
        for k, held in enumerate(self.filter):
            own = np.flatnonzero(part == k) if len(self.filter) > 1 else np.arange(len(keys))
            for at in filter_slots(keys[own], (8 * len(held)).bit_length() - 1):
                there = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                out[own[~there]] = False
        return out

    def score(self, lang: str, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log2 probability of each text as far as it is known here; number of the text, key and times of other n-grams that the model may have)."""
        units, place, number = padded(words, sizes)
        total = np.zeros(len(sizes))
        keys, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size in range(1, ORDER + 1):
            # n-grams that end in the text, and the start marks alone as a context of its first word
            ends = np.flatnonzero(place >= (ORDER - 2 if size < ORDER else ORDER - 1))
            wanted = keys_of(units, size, lang)[ends - size + 1]
            value = self.near.find(wanted)
            missed = np.flatnonzero(np.isnan(value))
            # what the join finds for a word is above the value of an unknown one; a start mark has none of its own
            value[missed] = np.where(place[ends[missed]] >= ORDER - 1, self.unknown[lang], 0) if size == 1 else 0
            total += np.bincount(number[ends], value.astype(np.float64), len(sizes))
            missed = missed[self.maybe(wanted[missed])]
            keys.append(wanted[missed])
            texts.append(number[ends[missed]])
        key, text = np.concatenate(keys), np.concatenate(texts)
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, np.int64)
        return total, text[first], key[first], np.diff(np.append(first, len(key)))


def score(docs: DataFrame, table: DataFrame, unknown: dict[str, float]) -> DataFrame:
    """(doc_id, lang, text_hash, log2_p, n): a row for each distinct document in a language of the model; n counts words and the end.

    What a task can't look up it asks: for each block of documents and bucket of
    the model one row with all keys, which the bucket answers with one row.
    ``table`` is read several times, so it should be written.
    """
    spark = docs.sparkSession
    sizes = table.groupBy(F.least("n", F.lit(FREQUENT)).alias("n")).count().orderBy(F.desc("n")).collect()
    rank = np.cumsum([r["count"] for r in sizes])
    # the most common ones, all of a count or none
    least = next((r["n"] for r, k in zip(sizes, rank.tolist(), strict=True) if k > FREQUENT), 0) + 1
    common = table.where(F.col("n") >= least).select("key", "value").toArrow()
    near = common["key"].to_numpy().view(np.uint64), common["value"].to_numpy().astype(np.float32)
    near = tuple(x[np.argsort(near[0])] for x in near)  # here, so that no worker needs the memory for it
    far = table.where(F.col("n") < least).select("key", (F.col("value") - F.col("base")).alias("value"))
    n_far = counted(far)
    parts = 1 << (max(0, n_far - 1) // FILTER_PART).bit_length()

    def filtered(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "data": [filter_part(rows["key"].to_numpy().view(np.uint64))]})

    part = F.shiftrightunsigned("key", 33).bitwiseAND(F.lit((1 << 31) - 1))
    dealt = far.select("key", F.shiftright(part, 31 - (parts.bit_length() - 1)).cast("int").alias("part"))
    held = {r["part"]: spark.sparkContext.broadcast(bytes(r["data"])) for r in dealt.groupBy("part").applyInPandas(filtered, "part int, data binary").toLocalIterator()}
    empty = spark.sparkContext.broadcast(filter_part(np.zeros(0, np.uint64)))
    name = f"lookup {unique_name()}"
    shared = spark.sparkContext.broadcast(near)
    del common, near

    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_far // BUCKET_KEYS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = made_once(name, lambda: Lookup(shared.value, [held.get(k, empty).value for k in range(parts)], unknown), "lookup")
        block, n_docs, asked = unique_name(), 0, []

        def sent(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(x.name, pa.nulls(size, x.type)) for x in schema], schema=schema)

        def questions() -> pa.RecordBatch:
            key, text, times = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.argsort(key, kind="stable")
            key, text, times = key[order], text[order], times[order]
            found = [(k, packed_keys(key[own]), squeezed(text[own]), squeezed(times[own])) for k, own in by_bucket(key, n_buckets)]
            return sent(len(found), block=pa.array([block] * len(found)), **{c: pa.array(x, schema.field(c).type) for c, x in zip(
                ("bucket", "keys", "texts", "times"), zip(*found, strict=True), strict=True)})

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.column(0).type), ("lang", pa.string()), ("text_hash", pa.int64()), ("log2_p", pa.float64()), ("n", pa.int64()), ("block", pa.string()),
                                    ("place", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary()), ("times", pa.binary())])
            langs = np.array(batch.column(1).to_pylist(), object)
            words, sizes = hash_words(x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist())
            starts = np.cumsum(sizes) - sizes
            for lang in set(langs.tolist()) & unknown.keys():
                own = np.flatnonzero(langs == lang)
                for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // PIECE)) + 1):
                    chosen = np.repeat(starts[part] - (np.cumsum(sizes[part]) - sizes[part]), sizes[part]) + np.arange(sizes[part].sum())
                    total, text, key, times = lookup.score(lang, words[chosen], sizes[part])
                    at, place = pa.array(part), n_docs + np.arange(len(part))
                    yield sent(len(part), doc_id=batch.column(0).take(at), lang=batch.column(1).take(at), text_hash=batch.column(3).take(at), log2_p=pa.array(total),
                               n=pa.array(sizes[part] + 1), block=pa.array([block] * len(part)), place=pa.array(place, pa.int32()))
                    asked.append((key, place[text].astype(np.uint32), times.astype(np.uint32)))
                    n_docs += len(part)
                    if sum(len(x) for x, _, _ in asked) >= ASKED:
                        yield questions()
                        block, n_docs, asked = unique_name(), 0, []
        if sum(len(x) for x, _, _ in asked):
            yield questions()

    kind = docs.schema["doc_id"].dataType.simpleString()
    # written once, as documents and questions are read apart
    with small_batches(spark):
        rows = stored(docs.select("doc_id", like_string("lang").alias("lang"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
            scored, fields(doc_id=kind, lang="string", text_hash="long", log2_p="double", n="long", block="string", place="int", bucket="int", keys="binary", texts="binary", times="binary")))

    def answered(asked: pa.Table, table: pa.Table) -> pa.Table:
        """What the n-grams of a bucket add to each document that asks, by block."""
        keys, values = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for block, *data in zip(*(asked[c].to_pylist() for c in ("block", "keys", "texts", "times")), strict=True):
            wanted, text, times = unpacked_keys(data[0]), unsqueezed(data[1], np.uint32), unsqueezed(data[2], np.uint32)
            there = np.searchsorted(keys, wanted)
            hit = np.flatnonzero(there < len(keys))
            hit = hit[keys[there[hit]] == wanted[hit]]
            texts, of = np.unique(text[hit], return_inverse=True)
            out.append((block, squeezed(texts), squeezed(np.bincount(of, times[hit] * values[there[hit]], len(texts)))))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("block", "texts", "sums"), columns, (pa.string(), pa.binary(), pa.binary()), strict=True)})

    def added(own: pa.Table, told: pa.Table) -> pa.Table:
        """The documents of a block with what all buckets have told."""
        place = own["place"].to_numpy()
        total = np.zeros(int(place.max(initial=-1)) + 1)
        for texts, sums in zip(told["texts"].to_pylist(), told["sums"].to_pylist(), strict=True):
            total[unsqueezed(texts, np.uint32)] += unsqueezed(sums, np.float64)
        return pa.table({c: own[c] for c in ("doc_id", "lang", "text_hash")} | {"log2_p": pa.array(own["log2_p"].to_numpy() + total[place]), "n": own["n"]})

    bucket = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * n_buckets, 32).cast("int")  # as ``by_bucket`` deals them
    told = rows.where("bucket is not null").select("bucket", "block", "keys", "texts", "times").groupBy("bucket").cogroup(
        far.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(answered, "block string, texts binary, sums binary")
    found = rows.where("bucket is null").select("doc_id", "lang", "text_hash", "log2_p", "n", "block", "place")
    if counted(rows.where("bucket is not null").limit(1)):
        found = found.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(added, fields(doc_id=kind, lang="string", text_hash="long", log2_p="double", n="long"))
    # rows that repeat have the same values
    return found.groupBy("doc_id", "lang", "text_hash").agg(F.max("log2_p").alias("log2_p"), F.max("n").alias("n"))


def verdicts(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """(doc_id, lang, text_hash, quality_bits, quality_least, quality_limit, quality_kept) of each distinct document that can be judged."""
    trusted = checkpointed(trusted_ids(docs, labels))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model, unknown = word_models(training_texts(docs, trusted), size // BUCKET_BYTES + 1)
    table = stored(model)
    removed(model)
    scored = score(docs, table, unknown)
    scores = checkpointed(scored.where("n > 1").withColumn("quality_bits", -F.col("log2_p") / F.col("n")))
    removed(scored, table)
    # what the model has seen is easier to foretell, so it tells nothing of the upper threshold, and is above the lower one
    seen = scores.join(trusted, ["doc_id", "lang"]).select("lang", "quality_bits", "held_out")
    upper = F.percentile_approx(F.when(F.col("held_out"), F.col("quality_bits")), F.lit(float(quantiles[1])), F.lit(10_000))
    lower = F.percentile_approx("quality_bits", F.lit(float(quantiles[0])), F.lit(10_000))
    pooled = seen.agg(lower.alias("lower"), F.coalesce(upper, F.max("quality_bits")).alias("upper")).first()
    own = seen.groupBy("lang").agg(lower.alias("own_lower"), upper.alias("own_upper"), F.count(F.when(F.col("held_out"), 1)).alias("n_held_out")).where(
        F.col("n_held_out") >= MIN_HELD_OUT)
    judged = scores.join(small(own), "lang", "left").select(
        "doc_id", "lang", "text_hash", "quality_bits", F.coalesce("own_lower", F.lit(pooled["lower"])).alias("quality_least"),
        F.coalesce("own_upper", F.lit(pooled["upper"])).alias("quality_limit"))
    return judged.withColumn("quality_kept", F.coalesce(F.col("quality_bits").between(F.col("quality_least"), F.col("quality_limit")), F.lit(True)))


ADDED = ["quality_bits", "quality_least", "quality_limit", "quality_kept"]


def with_verdicts(rows: DataFrame, text_hash: Column, judged: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``ADDED``."""
    names = [c for c in rows.columns if c not in ADDED]
    left = rows.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), like_string("lang").alias("of"), text_hash.alias("h"))
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("lang")) & (F.col("h") == F.col("text_hash"))
    return left.join(judged, match, "left").select(
        *[F.col(f"row.{c}").alias(c) for c in names], *ADDED[:3], F.coalesce("quality_kept", F.lit(True)).alias("quality_kept"))


def classify(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, lang) with quality_bits, quality_least, quality_limit and quality_kept.

    quality_bits is the log2 perplexity a word, quality_least and quality_limit
    are the thresholds of the language; columns of these names are replaced. A
    text without words has no bits and is kept; so is a document in a language
    without trusted documents that train a model. A null language is the language
    ''. Texts of any length are scored whole. Repeated rows each get their
    verdict; without labels all is kept; an empty table gives no rows. Different
    words share what is kept of their hashes with a chance of 2**-40.
    """
    return with_verdicts(docs, F.xxhash64("text"), verdicts(docs, labels, quantiles))
