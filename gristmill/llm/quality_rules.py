"""Quality rules with an n-gram perplexity band (operator 3).

Counting rules come first. Documents that pass them are held against a modified
Kneser-Ney model of the characters of their language, counted by Spark over all
documents that pass the rules and are made of letters, each distinct text once.
A perplexity far below the language's usual range is boilerplate, far above it
is noise. Both bounds are set from the quartiles of the language.

A model is stored in sorted hash arrays, cut by key into parts of bounded size.
Each part is sent to the workers on its own, and a worker keeps a few of them,
so a model may grow with the corpus, and there may be any number of languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, fields, like_string, small, unique_name
from gristmill.llm.exchange import mixed
from gristmill.llm.kneser_ney import CONTEXT, START, HashArray, SortedArray, char_levels, fit, rolled

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Characters of an n-gram.
ORDER = 5
#: A band reaches this many times the distance of the quartiles beyond them.
REACH = 4.0
#: Documents train the model if so many of a hundred characters at least are letters or spaces.
LETTERS_PERCENT = 90
#: Characters that are scored and counted at once, and n-grams in a part of a model.
PIECE, COUNTED, PART = 1 << 17, 1 << 19, 1 << 21
#: N-grams of a part in one row on its way over the driver.
SENT = 1 << 16
#: Bytes of text that a task counts at least, cores permitting; a task of little text hardly combines equal n-grams.
TASK_BYTES = 16 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) >= 1 << 21:  # the packed window would not fit into 63 bits
        windows = Counter(zip(a[:-2].tolist(), a[1:-1].tolist(), a[2:].tolist(), strict=True))
        often = np.array([windows[w] > 1 for w in zip(a[:-2].tolist(), a[1:-1].tolist(), a[2:].tolist(), strict=True)])
    else:
        n = len(ids)
        _, inverse, times = np.unique((a[:-2] * n + a[1:-1]) * n + a[2:], return_inverse=True, return_counts=True)
        often = times[inverse] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k: len(often) + k] |= often
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """The values of ``COUNTS``."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated,
            repeated_words(words))


def fails(n_words: int, n_repeat_words: int) -> bool:
    """The base rules."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


# -- characters


def code_points(text: str) -> np.ndarray:
    """The code points of a text; the start mark cannot occur, as a tab is read as a space, nor can a zero."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points == ord(START), 32, np.where(points == 0, 0xFFFD, points)).astype(np.uint32)


def pieces(texts: Iterable[str], size: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of the texts, code points, where each one's begin): texts behind start marks, and cut where they are long."""
    numbers, parts, total = [], [], 0
    for number, text in enumerate(texts):
        before = np.full(ORDER - 1, ord(START), np.uint32)
        for at in range(0, len(text), size):
            points = np.concatenate([before, code_points(text[at:at + size])])
            before = points[1 - ORDER:]
            numbers.append(number)
            parts.append(points)
            total += len(points)
            if total >= size:
                yield numbers, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
                numbers, parts, total = [], [], 0
    if parts:
        yield numbers, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def ends_of(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of the characters that are no marks or repeated context."""
    kept = np.ones(len(points), bool)
    kept[(begins[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return np.flatnonzero(kept)


def units(points: np.ndarray) -> np.ndarray:
    return mixed((points.astype(np.uint64) + np.uint64(1)) << np.uint64(20))


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points of the basic plane are letters or spaces; what lies above counts as letters."""
    return np.array([chr(c).isalpha() or chr(c) in SPACES for c in range(0x10000)] + [True])


def trains(text: str) -> bool:
    """Whether a text that passes the base rules is made of letters."""
    n = sum(int(letters()[np.minimum(code_points(text[at:at + PIECE]), 0x10000)].sum()) for at in range(0, len(text), PIECE))
    return 100 * n >= LETTERS_PERCENT * len(text)


def training_texts(docs: DataFrame) -> DataFrame:
    """(lang, data, h, size): the texts of ``docs`` (lang, text) that train, compressed, dealt by their hash; one may occur more than once in its partition."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            kept = []
            for number, (lang, text, h) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if text and (lang, h) not in seen:
                    seen.add((lang, h))
                    counts = text_counts(text)
                    if not fails(counts[0], counts[4]) and trains(text):
                        kept.append(number)
            sent = batch.take(pa.array(kept, pa.int64()))
            data = [pa.compress(x.encode("utf-8", "surrogatepass"), "zstd", asbytes=True) for x in sent.column(1).to_pylist()]
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in sent.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([sent.column(0), pa.array(data, pa.binary()), sent.column(2), pa.array(sizes, pa.int64())],
                                             ["lang", "data", "h", "size"])

    rows = docs.select(like_string("lang").alias("lang"), "text", F.xxhash64("text").alias("h"))
    # a task sends each text once, so a text with many copies is as many rows as there are tasks
    return rows.mapInArrow(chosen, "lang string, data binary, h long, size long").repartition("lang", "h")


def count_chars(texts: DataFrame, n_tasks: int) -> DataFrame:
    """(lang, gram, n) of all character n-grams of ``training_texts``; each distinct text counts once. At most ``n_tasks`` tasks count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, data, h, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    by_lang.setdefault(lang, []).append(pa.decompress(data, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass"))
            for lang, own in by_lang.items():
                for _, points, begins in pieces(own, COUNTED):
                    ends = ends_of(points, begins)
                    _, first, n = np.unique(rolled(units(points), ORDER)[ends - ORDER + 1], return_index=True, return_counts=True)
                    grams = np.ascontiguousarray(points[(ends[first] - ORDER + 1)[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "gram": pa.array(grams), "n": pa.array(n)})

    return texts.coalesce(n_tasks).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def packed(model: DataFrame, n_parts: int) -> DataFrame:
    """(lang, part, keys, values): the sorted hash arrays of the model, in rows of up to ``SENT`` keys in order; a part lies in one partition."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        keys, values = [], []
        for size, own in rows.groupby("size"):
            grams = np.array(own["gram"].tolist(), f"<U{max(1, size)}")
            points = np.ascontiguousarray(grams).view("<u4").reshape(len(own), -1).astype(np.uint32)
            h = rolled(units(points.ravel()), size)[::size] if size else mixed(np.zeros(len(own), np.uint64))
            for column, extra in (("p", np.uint64(0)), ("left", CONTEXT)):
                there = own[column].notna().to_numpy()
                keys.append(h[there] ^ extra)
                values.append(own[column].to_numpy()[there])
        key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
        order = np.argsort(key)
        key, value = key[order], value[order]
        starts = range(0, len(key), SENT)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "part": rows["part"].iloc[0], "keys": [key[k:k + SENT].tobytes() for k in starts], "values": [value[k:k + SENT].tobytes() for k in starts]})

    # dealt by the n-gram: its hash as an n-gram and as a context lie in different parts otherwise
    held = model.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(n_parts)).cast("int"))
    return held.groupBy("lang", "part").applyInPandas(pack, "lang string, part int, keys binary, values binary")


#: Parts of models that a worker keeps with a table of where runs of keys begin, and the tables of the models in use.
INDEXED = 4
_TABLES: dict[str, dict[tuple[str, int], HashArray]] = {}


class Models:
    """Models of characters by language, from the parts that were sent."""

    def __init__(self, name: str, sent: dict[str, list]):
        self.name, self.sent = name, sent

    def arrays(self, lang: str) -> Iterator[HashArray | SortedArray]:
        """The parts of a language; the first ``INDEXED`` that a worker meets get a table, the others are asked as they are."""
        if self.name not in _TABLES:
            _TABLES.clear()
            _TABLES[self.name] = {}
        tables = _TABLES[self.name]
        for number, part in enumerate(self.sent[lang]):
            keys, values = np.frombuffer(part.value[0], np.uint64), np.frombuffer(part.value[1], np.float32)
            if (lang, number) not in tables and len(tables) < INDEXED:
                tables[lang, number] = HashArray(keys, values)
            yield tables.get((lang, number)) or SortedArray(keys, values)

    def find(self, lang: str, keys: np.ndarray) -> np.ndarray:
        out = None
        for array in self.arrays(lang):
            found = array.find(keys)
            out = found if out is None else np.where(np.isnan(out), found, out)
        return out

    def log2(self, lang: str, texts: list[str]) -> np.ndarray:
        """log2 probability of each text; not a number where no model knows the language."""
        out = np.full(len(texts), np.nan if lang not in self.sent else 0.0)
        for numbers, points, begins in pieces(texts, PIECE) if lang in self.sent else ():
            p = self.characters(lang, points, begins)
            np.add.at(out, numbers, np.add.reduceat(p, begins - (ORDER - 1) * np.arange(len(begins))))
        return out

    def characters(self, lang: str, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log2 probability of each character that is no mark."""
        todo, hashes = ends_of(points, begins), units(points)
        out, here = np.zeros(len(todo)), np.arange(len(todo))
        for size in range(ORDER, 0, -1):
            # the n-gram where it was seen; else the weight of its context, and the order below
            found = self.find(lang, rolled(hashes, size)[todo[here] - size + 1])
            missed = np.isnan(found)
            out[here] += np.where(missed, 0.0, found)
            here = here[missed]
            if not len(here):
                return out
            contexts = rolled(hashes, size - 1)[todo[here] - size + 1] if size > 1 else mixed(np.zeros(1, np.uint64)).repeat(len(here))
            weight = self.find(lang, contexts ^ CONTEXT)
            out[here] += np.where(np.isnan(weight), 0.0, weight)
        # an unknown character has the share of one of all known and one more
        out[here] += self.find(lang, mixed(np.zeros(1, np.uint64)))[0]
        return out


def fitted(docs: DataFrame) -> dict[str, list]:
    """The parts of the models of all languages of ``docs`` (lang, text), as broadcasts of at most about ``PART`` n-grams each."""
    context, size = docs.sparkSession.sparkContext, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = char_levels(count_chars(training_texts(docs), max(context.defaultParallelism, size // TASK_BYTES)), ORDER)
    # by the counts, which are there already, so that the model itself is not written once more
    sizes = reduce(DataFrame.union, (level.groupBy("lang").count() for level in levels))
    most = sizes.groupBy("lang").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0
    model = fit(levels)
    sent = {}
    # one part at a time on the driver, in small rows, as the JVM holds several copies of a row that it hands on
    for (lang, _), rows in groupby(packed(model, most // PART + 1).toLocalIterator(), lambda row: (row["lang"], row["part"])):
        keys, values = zip(*((row["keys"], row["values"]) for row in rows), strict=True)
        sent.setdefault(lang, []).append(context.broadcast((b"".join(keys), b"".join(values))))
    return sent


def apply_rules(docs: DataFrame) -> DataFrame:
    """A verdict for each row of ``docs`` (doc_id, text, lang).

    Returns doc_id, the counts of ``COUNTS``, lang, log2_perplexity (bits a
    character), lower, upper, base_failed and kept.

    A null text has no words and fails the base rules; a null language is the
    language ''. A tab is read as a space by the model. Bands come from the
    documents that train the model, each text once. A language in which no document could
    train a model has no perplexities, and there the base rules decide alone.
    Texts of any length are scored whole. Repeated rows each get their verdict;
    an empty table gives no rows; other columns are ignored.
    """
    name, sent = unique_name(), fitted(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(name, sent)
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), [x or "" for x in batch.column(2).to_pylist()]
            counts = [text_counts(text) for text in texts]
            bits = np.full(len(texts), np.nan)
            for lang in set(langs):
                own = [k for k, x in enumerate(langs) if x == lang and texts[k] and not fails(counts[k][0], counts[k][4])]
                bits[own] = -models.log2(lang, [texts[k] for k in own]) / [len(texts[k]) for k in own]
            columns = list(zip(*counts, strict=True)) or [()] * 5
            fit_to_train = [b == b and trains(text) for b, text in zip(bits.tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), batch.column(1), pa.array(bits, pa.float64(), from_pandas=True),
                 batch.column(3), pa.array(fit_to_train, pa.bool_())],
                ["doc_id", *COUNTS, "lang", "log2_perplexity", "text_hash", "trains"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", like_string("lang").alias("lang"), "text", F.xxhash64("text"))
    scored = checkpointed(rows.mapInArrow(score, fields(
        doc_id=kind, **dict.fromkeys(COUNTS, "long"), lang="string", log2_perplexity="double", text_hash="long", trains="boolean")))
    scored = scored.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                               | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    quartiles = scored.where("trains").select("lang", "text_hash", "log2_perplexity").distinct().groupBy("lang").agg(
        F.percentile_approx("log2_perplexity", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    bands = quartiles.select("lang", (low - REACH * (high - low)).alias("lower"), (high + REACH * (high - low)).alias("upper"))
    judged = scored.join(small(bands), "lang", "left")  # a row for each language
    inside = F.col("log2_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.select("doc_id", *COUNTS, "lang", "log2_perplexity", "lower", "upper", "base_failed",
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
