"""Benchmark decontamination by the q-gram lemma (operator 9).

Benchmark items are cut into overlapping segments. A place in a document where
a segment of m characters occurs with at most e edits shares m + 1 - q(e + 1)
q-grams with it, all within e diagonals of each other. So shared q-grams are
counted in overlapping diagonal bands, bands that reach the bound are kept, and
a banded alignment verifies each. An item is found where verified segments
cover half of it, or ``LONG_PASSAGE`` characters of it whatever its length.

Items too short for the error rate may have the edits that leave a shared
q-gram, ones shorter than a q-gram none. Segments that several items share are
one segment. Where many segments share a q-gram, as in a common question stem,
a segment may give up the most frequent of its q-grams: it then needs so many
less, so nothing is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import fields, made_once, unique_name

Q = 12
#: Characters of a segment, and edits as a share of them.
SEGMENT, ERROR_RATE = 96, 0.06
#: Share of an item that verified segments must cover, or characters.
MIN_COVER, LONG_PASSAGE = 0.5, 192
#: A q-gram of more segments is given up where a segment can spare it; a segment keeps a bound of at least ``KEPT_BOUND``.
COMMON, KEPT_BOUND = 64, 8
#: Shared q-grams that are counted at once.
ENTRIES = 1 << 22
#: Characters of benchmark items that are sought in one pass over the documents.
BLOCK_CHARS = 8 << 20
PIECE = 1 << 20
EDITS = int(SEGMENT * ERROR_RATE)
STRIDE = EDITS + 1  # bands are two strides wide and one apart, so any EDITS + 1 diagonals lie in one
GAP = 4 * STRIDE
CARRIED = SEGMENT + GAP


@lru_cache(1)
def folded() -> np.ndarray:
    """Code point to lower-case code point of the basic plane; all spaces are one, others 0xFFFF."""
    out = np.arange(0x10000, dtype=np.uint16)
    for c in range(1, 0xD800):
        char = chr(c)
        low = char.lower()
        out[c] = 32 if char.isspace() else ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    out[0] = 0xFFFF  # 0 separates documents
    return out


def normal_pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(folded characters without repeated spaces, their places in the text); each piece begins with the last one's end."""
    table = folded()
    codes, places = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        new = table[np.minimum(points, 0xFFFF)]
        before = codes[-1] if len(codes) else 32
        kept = (new != 32) | (np.concatenate([[before], new[:-1]]) != 32)
        codes = np.concatenate([codes[-CARRIED:], new[kept]])
        places = np.concatenate([places[-CARRIED:], np.flatnonzero(kept) + at])
        yield codes, places


def qgrams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place on."""
    n = len(codes) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    low = ((codes & 255) ^ (codes >> 8)).astype(np.uint8)
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # eight characters each, overlapping
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[Q - 8:Q - 8 + n]


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


class Index:
    """The segments of some items and their q-grams."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        """``items`` are (number, text); numbers are unique."""
        segments: dict[bytes, int] = {}
        self.length, self.uses, self.exact = {}, [], []
        for item, text in items:
            codes, carried = np.zeros(0, np.uint16), 0
            for piece, _ in normal_pieces(text):
                codes, carried = np.concatenate([codes, piece[carried:]]), min(CARRIED, len(piece))
            codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
            if not len(codes):
                continue
            self.length[item] = len(codes)
            if len(codes) < Q:
                self.exact.append((item, codes))
                continue
            last = max(0, len(codes) - SEGMENT)
            for start in sorted({*range(0, last, SEGMENT // 2), last}):
                k = segments.setdefault(codes[start:start + SEGMENT].tobytes(), len(segments))
                if k == len(self.uses):
                    self.uses.append([])
                self.uses[k].append((item, start))
        texts = [np.frombuffer(x, np.uint16) for x in segments]
        self.size = np.array([len(x) for x in texts], np.int64)
        # the lemma asks for a shared q-gram at least
        self.edits = np.minimum((self.size * ERROR_RATE).astype(np.int64), self.size // Q - 1)
        self.needed = self.size + 1 - Q * (self.edits + 1)
        self.codes = np.zeros((len(segments), SEGMENT), np.uint16)
        keys, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, codes in enumerate(texts):
            self.codes[k, :len(codes)] = codes
            keys.append(qgrams(codes))
            owner.append(np.full(len(keys[-1]), k))
            offset.append(np.arange(len(keys[-1])))
        key, owner, offset = np.concatenate(keys), np.concatenate(owner), np.concatenate(offset)
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        common = np.flatnonzero(times[of] > COMMON)
        common = common[np.lexsort((-times[of[common]], owner[common]))]
        nth = np.arange(len(common)) - np.searchsorted(owner[common], owner[common])
        spared = common[nth < self.needed[owner[common]] - KEPT_BOUND]
        self.needed -= np.bincount(owner[spared], minlength=len(segments))
        kept = np.ones(len(key), bool)
        kept[spared] = False
        key, owner, offset = key[kept], owner[kept], offset[kept]
        order = np.argsort(key, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(key)))
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[slot(self.keys, self.bits)] = True

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, band): where bands share enough q-grams."""
        none = np.zeros(0, np.int64)
        grams = qgrams(codes)
        if not len(self.keys) or not len(grams):
            return none, none
        at = np.flatnonzero(self.filter[slot(grams, self.bits)])
        found = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[found] == grams[at]
        at, found = at[same], found[same]
        if not len(at):
            return none, none
        times = self.times[found]
        bands = len(codes) // STRIDE + SEGMENT + 2
        bands_found, counts_found = [none], [none]
        # so many matches at once that the counts of a slice stay small
        edges = np.searchsorted(np.cumsum(times), np.arange(ENTRIES, times.sum() + ENTRIES, ENTRIES), "left") + 1
        for low, high in zip(np.append(0, edges[:-1]), edges, strict=True):
            n, first = times[low:high], self.first[found[low:high]]
            entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            segment, diagonal = self.owner[entry], np.repeat(at[low:high], n) - self.offset[entry] + SEGMENT
            key = segment * bands + diagonal // STRIDE
            for held, new in zip((bands_found, counts_found), np.unique(np.concatenate([key, key - 1]), return_counts=True), strict=True):
                held.append(new)
            if sum(map(len, bands_found)) > 4 * ENTRIES or high == edges[-1]:
                band, inverse = np.unique(np.concatenate(bands_found), return_inverse=True)
                counts_found = [np.bincount(inverse, np.concatenate(counts_found), len(band)).astype(np.int64)]
                bands_found = [band]
        band, count = bands_found[0], counts_found[0]
        kept = count >= self.needed[band // bands]
        return band[kept] // bands, (band[kept] % bands) * STRIDE - SEGMENT

    def aligned(self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best alignment of each segment near its band."""
        width = 2 * STRIDE + 2 * EDITS
        left = diagonal - EDITS
        padded = np.concatenate([np.zeros(GAP + SEGMENT, np.uint16), codes, np.zeros(2 * SEGMENT + GAP + width, np.uint16)])
        far = np.int32(SEGMENT + GAP)
        cost = np.zeros((width, len(segment)), np.int32)
        start = np.arange(width)[:, None] + left
        best, best_start, best_end = np.full(len(segment), far), np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
        for i in range(SEGMENT):
            new, new_start = np.empty_like(cost), np.empty_like(start)
            pattern = self.codes[segment, i]
            for k in range(width):
                c = cost[k] + (padded[left + (GAP + SEGMENT + i + k)] != pattern)
                s = start[k]
                if k + 1 < width:
                    skipped = cost[k + 1] + 1 < c
                    c, s = np.where(skipped, cost[k + 1] + 1, c), np.where(skipped, start[k + 1], s)
                if k:
                    added = new[k - 1] + 1 < c
                    c, s = np.where(added, new[k - 1] + 1, c), np.where(added, new_start[k - 1], s)
                new[k], new_start[k] = c, s
            cost, start = new, new_start
            if (done := self.size[segment] == i + 1).any():
                k = cost.argmin(0)
                best = np.where(done, cost.min(0), best)
                best_start = np.where(done, np.take_along_axis(start, k[None], 0)[0], best_start)
                best_end = np.where(done, left + i + k + 1, best_end)
        return best, best_start, best_end

    def places(self, codes: np.ndarray, short: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of ``short`` in ``codes`` where it stands between other than letters and digits."""
        data, wanted = codes.tobytes(), short.tobytes()
        at = data.find(wanted)
        while at >= 0:
            low, high = at // 2, (at + len(wanted)) // 2
            if at % 2 == 0 and not (low and chr(codes[low - 1]).isalnum()) and not (high < len(codes) and chr(codes[high]).isalnum()):
                yield low, high
            at = data.find(wanted, at + 1)

    def found(self, texts: Iterable[str]) -> dict[int, dict[int, tuple[int, int, float, int]]]:
        """By text number and item: (start, end, share of the item covered, edits) where enough is covered."""
        hits: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = defaultdict(list)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            edge = np.zeros(GAP, np.uint16)
            codes = np.concatenate([x for _, c, _ in held for x in (c, edge)])
            sizes = np.array([len(c) + GAP for _, c, _ in held])
            begins = np.cumsum(sizes) - sizes
            for item, short in self.exact:
                for low, high in self.places(codes, short):
                    piece = int(np.searchsorted(begins, low, "right")) - 1
                    number, _, places = held[piece]
                    hits[number, item].append((0, len(short), int(places[low - begins[piece]]), int(places[high - 1 - begins[piece]]) + 1, 0))
            segment, diagonal = self.candidates(codes)
            for a in range(0, len(segment), 20_000):
                seg = segment[a:a + 20_000]
                edits, start, end = self.aligned(codes, seg, diagonal[a:a + 20_000])
                for k in np.flatnonzero(edits <= self.edits[seg]):
                    first = max(int(start[k]), 0)
                    piece = int(np.searchsorted(begins, min(int(end[k]) - 1, len(codes) - 1), "right")) - 1
                    number, _, places = held[piece]
                    low, high = max(0, first - begins[piece]), min(len(places), int(end[k]) - begins[piece]) - 1
                    s = int(seg[k])
                    for item, at in self.uses[s]:
                        hits[number, item].append((at, at + int(self.size[s]), int(places[low]), int(places[high]) + 1, int(edits[k])))
            held.clear()

        total = 0
        for number, text in enumerate(texts):
            for codes, places in normal_pieces(text):
                held.append((number, codes, places))
                total += len(codes)
                if total >= PIECE:
                    flush()
                    total = 0
        flush()
        out: dict[int, dict[int, tuple[int, int, float, int]]] = defaultdict(dict)
        for (number, item), parts in hits.items():
            covered = np.zeros(self.length[item], bool)
            for a, b, *_ in parts:
                covered[a:b] = True
            if covered.mean() >= MIN_COVER or covered.sum() >= LONG_PASSAGE:
                out[number][item] = (min(p[2] for p in parts), max(p[3] for p in parts), round(float(covered.mean()), 4),
                                     max(p[4] for p in parts))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with ids and texts, each distinct one once, in blocks of about ``BLOCK_CHARS`` characters."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // BLOCK_CHARS + 1
    for block in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def _index(items: list[tuple[int, str]]) -> Index:
    return Index((k, text) for k, (_, text) in enumerate(items))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents contain benchmark items: a row for each row of ``docs`` and item found in it.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Returns doc_id,
    item_id, start and end (code points of the text, end exclusive), covered
    (share of the item) and edits (most in a segment).

    Case and runs of spaces don't count. Items without id, or with no text but
    spaces, are not sought; null texts contain nothing. Items of fewer than
    ``Q`` characters are sought as they are, between other than letters and
    digits. An item that is repeated whole counts once; items that share an id
    but not the text are each reported, and so are repeated documents. Texts of
    any length are searched whole. Empty tables give no rows; other columns are
    ignored.
    """
    context, out = docs.sparkSession.sparkContext, None
    schema = fields(doc_id=docs.schema["doc_id"].dataType.simpleString(), item_id="long", start="long", end="long",
                    covered="double", edits="long")
    rows = docs.select("doc_id", "text")
    for items in _blocks(benchmark):
        shared, name = context.broadcast(items), unique_name()  # a block of the benchmark, bounded by BLOCK_CHARS

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = made_once(name, lambda: _index(shared.value))
            for batch in batches:
                found = index.found(x.as_py() or "" for x in batch.column(1))
                said = [(number, shared.value[item][0], *f) for number, of in found.items() for item, f in of.items()]
                columns = list(zip(*said, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]],
                                                 ["doc_id", "item_id", "start", "end", "covered", "edits"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; see ``contaminations``."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for items in _blocks(benchmark):
        shared, name = context.broadcast(items), unique_name()  # a block of the benchmark, bounded by BLOCK_CHARS

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = made_once(name, lambda: _index(shared.value))
            for batch in batches:
                found = index.found(x.as_py() or "" for x in batch.column(at))
                yield batch.filter(pa.array([number not in found for number in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
