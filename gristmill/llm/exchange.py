"""Questions about hashed keys: documents ask in groups, buckets of keys answer.

Documents are dealt into groups by a hash. Each group sends its distinct
keys, once each, to the buckets that hold them; each bucket sees all that is
asked about its keys and answers every group. Keys travel as arrays, a row for
each group and bucket, so a common key costs a row's share for each group and
not one for each occurrence. Groups and buckets are sized by the text's bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a group on average; a bucket holds the keys of as much.
GROUP_BYTES = 8 << 20
#: A null doc_id has the place of the largest one.
LAST_ID = (1 << 63) - 1
#: Bytes that are hashed at once.
PIECE = 1 << 20


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (the splitmix64 finalizer)."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


#: What a byte and its place in a word are worth; white space is worth nothing.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = np.where(SPACES, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) << np.uint64(20)))
PLACES = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)


def _hashed_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it starts): a sum of byte values times place values, mixed."""
    codes = np.frombuffer(data, np.uint8)
    inside = ~SPACES[codes]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    starts = starts.astype(np.int32)
    place = np.arange(len(codes), dtype=np.int32)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, np.int32(len(codes)))))
    worth = BYTES[codes]
    worth *= PLACES[place & 0xFFFF]
    far = np.flatnonzero(place > 0xFFFF)  # only in very long words, so that no other word's hash depends on them
    worth[far] *= mixed((place[far] >> 16).astype(np.uint64) << np.uint64(32)) | np.uint64(1)
    return mixed(np.add.reduceat(worth, starts)), starts


def hash_words(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts, in order; number of words of each text)."""
    hashes, sizes = [np.zeros(0, np.uint64)], []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            found, starts = _hashed_piece(b"\n".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            sizes.extend(np.diff(np.searchsorted(starts, ends), prepend=0).tolist())
            hashes.append(found)
            held.clear()

    total = 0
    for data in texts:
        if total + len(data) > PIECE:
            flush()
            total = 0
        if len(data) <= PIECE:
            held.append(data)
            total += len(data)
            continue
        number = at = 0
        while at < len(data):  # a long text is cut at white space
            end = at + PIECE
            if end < len(data) and (following := re.compile(rb"[\x09-\x0d\x20]").search(data, end)):
                end = following.start()
            elif end < len(data):
                end = len(data)
            found, _ = _hashed_piece(data[at:end])
            hashes.append(found)
            number += len(found)
            at = end
        sizes.append(number)
    flush()
    return np.concatenate(hashes), np.array(sizes, np.int64)


def parts_for(docs: DataFrame) -> int:
    """Number of groups, and of buckets, for the text of ``docs``: by its bytes, and one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // GROUP_BYTES)


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """(g, ids, known, sizes, texts): the rows of ``docs`` (doc_id, text) in packed blocks, dealt to groups by a hash of both.

    Words are parted by ASCII alone, so texts stay UTF-8 from here on; null
    texts are empty and null ids ``LAST_ID``, not known. Blocks are compressed,
    as the groups' shuffle is the only one that moves the text.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy()
            ids, texts = batch.column(1).to_numpy(), batch.column(2).cast(pa.binary()).to_pylist()
            known = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            blocks = []
            for places in np.split(order, runs(group[order])[1:]) if len(order) else ():
                own = [texts[k] or b"" for k in places]
                blocks.append((group[places[0]], ids[places].tobytes(), known[places].tobytes(),
                               np.array([len(x) for x in own], np.int64).tobytes(), pa.compress(b"".join(own), "zstd", asbytes=True)))
            columns = list(zip(*blocks, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)],
                                             ["g", "ids", "known", "sizes", "texts"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"), F.coalesce(doc_id, F.lit(LAST_ID)), "text", doc_id.isNotNull())
    return rows.mapInArrow(pack, "g int, ids binary, known binary, sizes binary, texts binary")


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, whether they are known, texts) of the blocks of a group."""
    ids, known, texts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
    for block in rows.itertuples(index=False):
        sizes = np.frombuffer(block.sizes, np.int64)
        data = pa.decompress(block.texts, int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b""
        ends = np.cumsum(sizes)
        ids.append(np.frombuffer(block.ids, np.int64))
        known.append(np.frombuffer(block.known, bool))
        texts += [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return np.concatenate(ids), np.concatenate(known), texts


def packed_counts(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: one for each below 255, and those from 255 on in full behind them."""
    large = counts >= 255
    return np.concatenate([np.minimum(counts, 255).astype(np.uint8), counts[large].astype("<u8").view(np.uint8)])


def unpacked_counts(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` counts that ``packed_counts`` has packed."""
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=n)
    return counts


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in their order) for each bucket that has keys."""
    # a range of keys, so that those of a bucket are close together; sixteen bits sort in one pass
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    edges = runs(bucket[order])
    for at, places in zip(edges, np.split(order, edges[1:]), strict=True) if len(keys) else ():
        yield int(bucket[order[at]]), places


def squeezed(values: np.ndarray) -> bytes:
    """Values, byte by byte (first all lowest bytes, then all second ones), compressed behind their size."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    """The values of one type that ``squeezed`` has packed."""
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys as their differences; those of rising keys are small, so their high bytes take next to nothing."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    """The keys that ``packed_keys`` has packed; they may come in any order."""
    return np.cumsum(unsqueezed(data, np.uint64), dtype=np.uint64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def asked(grouped: DataFrame, n: int, request: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(bucket, g, keys, noted): what ``request`` makes of each group, dealt to buckets."""

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, noted = request(rows)
        sent = [(bucket, key[0], packed_keys(keys[places]), squeezed(noted[places])) for bucket, places in by_bucket(keys, n)]
        return pd.DataFrame(sent, columns=["bucket", "g", "keys", "noted"])

    return grouped.groupBy("g").applyInPandas(send, "bucket int, g int, keys binary, noted binary")


def answered(questions: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]],
             noted_type: type) -> DataFrame:
    """(g, bucket, told): for each question of a bucket what ``answer`` tells the group that asked.

    ``answer`` gets the keys and notes of all questions in a row and where each
    question starts, and returns an array for each, which travels ``squeezed``.
    """

    def tell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asking = [unpacked_keys(x) for x in rows["keys"]]
        noted = np.concatenate([unsqueezed(x, noted_type) for x in rows["noted"]])
        keys, starts = np.concatenate(asking), np.concatenate([[0], np.cumsum([len(x) for x in asking])])
        del asking
        told = answer(keys, noted, starts)
        return pd.DataFrame({"g": rows["g"], "bucket": key[0], "told": [squeezed(x) for x in told]})

    return questions.groupBy("bucket").applyInPandas(tell, "g int, bucket int, told binary")
