"""MinHash near-duplicates, spelling variants and ranked search against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from gristmill.llm import minhash as M
from gristmill.llm import near_copies as N
from gristmill.llm import quality_rules as Q
from gristmill.llm import ranked_search as R
from gristmill.llm import spelling as S
from gristmill.llm.kneser_ney import HashArray, SortedArray
from gristmill.llm.near_copies import shingle_sets
from gristmill.llm.simhash import fingerprint, links, signed

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text):
    w = WORDS.findall((text or "").translate(ASCII_LOWER))
    return {" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_duplicates(rows):
    """(doc_id, n, component, kept) of (doc_id, text) rows, every pair compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        component = i if not sets[k] else least.get(top(k))
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=repr)


def found_duplicates(df):
    return sorted((tuple(r) for r in M.minhash_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_minhash_against_all_pairs(spark):
    texts = []
    for family in range(12):
        base = prose(family, 90 + 20 * family)
        texts += [edited(base, n, 100 * family + n) for n in (0, 0, 1, 1, 2, 2, 3, 4, 6)]
    texts += [prose(1000 + k, 60) for k in range(40)] + ["One two", "one TWO", "one", "", None, " \n", "É x", "é x"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_duplicates(rows)
    assert found_duplicates(df) == expected
    assert 20 < sum(not r[3] for r in expected) < 100


def test_minhash_chain_at_one_point(spark):
    """A chain of texts, of which neighbours are similar and the ends are not, is one component."""
    words = [f"w{k}" for k in range(140)]
    texts = [" ".join(words[k:k + 100]) for k in range(0, 40, 5)]
    rows = list(enumerate(texts))
    assert found_duplicates(spark.createDataFrame(rows, "doc_id long, text string")) == plain_duplicates(rows)
    assert {r[2] for r in plain_duplicates(rows)} == {0}


def test_minhash_in_many_blocks(spark, monkeypatch):
    """A template's pages, which stay apart, with near copies of some: in blocks of a few texts the links are the same."""
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 600)
    core = prose(5, 120)
    texts = [core + " " + prose(2000 + k, 16, 4000) for k in range(60)]
    texts += [edited(t, 1, k) for k, t in enumerate(texts[:20])]
    rows = list(enumerate(texts))
    assert found_duplicates(spark.createDataFrame(rows, "doc_id long, text string")) == plain_duplicates(rows)


def test_minhash_edges(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = found_duplicates(odd_docs)
    assert len(found) == len(rows) and M.minhash_duplicates(no_docs).count() == 0
    # rows without an id are kept, as nothing smaller is known
    assert [r for r in found if r[0] is not None] == [r for r in plain_duplicates(rows) if r[0] is not None]
    assert all(r[3] for r in found if r[0] is None)
    same = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(7, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["component_id"], r["kept"]) for r in M.minhash_duplicates(same).collect()) == [(7, False)] * 3 + [(7, True)]
    words = spark.createDataFrame([("b", "x y z"), ("a", "X y z")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in M.minhash_duplicates(words).collect()) == [("a", "a"), ("b", "a")]


def test_posterior():
    needed = M.least_matches()
    assert len(needed) == M.SIGNATURE // M.BATCH and all(a < b for a, b in zip(needed, needed[1:], strict=False))
    # the chance by a sum over the posterior itself
    h, m = M.SIGNATURE, needed[-1]
    s = (np.arange(200_000) + 0.5) / 200_000
    for matches, over in ((m, True), (m - 1, False)):
        density = s**matches * (1 - s) ** (h - matches)
        assert (density[s >= 0.85].sum() / density.sum() >= M.MISS) == over
    near, far = (shingle_sets([x.encode()])[0] for x in (prose(1, 300), prose(2, 300)))
    one, two, other = M.minima(near)[1], M.minima(shingle_sets([edited(prose(1, 300), 1, 3).encode()])[0])[1], M.minima(far)[1]
    assert M.possible(one, np.stack([two, other, one]), needed).tolist() == [0, 2]
    assert len(M.minima(np.zeros(0, np.uint64))[0]) == 0


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))

    around = defaultdict(list)
    for a, b in combinations(words, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w in words:
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(around[w]), form[w], words.get(form[w]), root))
    return sorted(out, key=repr)


def found_words(df):
    return sorted((tuple(r) for r in S.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


def test_spelling_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "HELD", 8)
    r = random.Random(3)
    stems = ["aabbaa", "letter", "lettér", "aaaaa", "überall", "Straße", "vowels"]
    texts = []
    for _ in range(300):
        words = []
        for _ in range(20):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abt") + w[k:], w[:k] + r.choice("abé") + w[k + 1:]])
            words.append(w)
        texts.append(r.choice([" ", "-", "1"]).join(words))
    rows = list(enumerate(texts))
    expected = plain_words(rows)
    assert found_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected
    assert len(expected) > 50 and any(x[5] not in (x[0], x[3]) for x in expected)


def test_spelling_edges(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found_words(odd_docs) == plain_words(rows) and S.spelling_variants(no_docs).count() == 0
    # ties go to the first in code-point order; × and ÷ lie between the letters and count as such
    tied = [(None, "wordz " * 3 + "worda " * 9 + "wordé " * 9 + "wor×d WOR×D wor×d ")] + [(k, None) for k in range(3)]
    assert found_words(spark.createDataFrame(tied, SCHEMA.split(", lang")[0])) == plain_words(tied)
    assert ("wordz", 3, 2, "worda", 9, "worda") in plain_words(tied)
    long = [(1, "x" * 300_000 + " " + "Aword " * 4)]
    assert [w[:2] for w in found_words(spark.createDataFrame(long, "doc_id long, text string"))] == [("aword", 4)]


@pytest.mark.parametrize("text", ["", "abc", "a" * 200, "ab1cd" * 50, "é" * 70 + "-" + "b" * 70])
def test_pieces_cut_no_run(text, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 16)
    monkeypatch.setattr(R, "PIECE", 16)
    assert [x for piece in S.runs(text) for x in piece] == re.findall("[a-zÀ-ÿ]+", text)
    assert [x for piece in R.terms(text.encode()) for x in piece] == R.TERM.findall(text.encode())


def plain_search(docs, items, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    read = lambda t: Counter(term.findall((t or "").translate(ASCII_LOWER)))
    counts = [(i, c, sum(c.values())) for i, c in ((i, read(t)) for i, t in docs) if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for doc_id, c, n in counts:
            m, score = 100 - 75 + (75 * n * n_docs) // n_terms, 0
            for t, q in read(text).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((score, doc_id))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item_id, k + 1, d, s) for k, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def found_search(docs, items, **more):
    return sorted((tuple(r) for r in R.ranked_documents(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("span", "share", "shard"), [(4096, 8, 1 << 16), (7, 3, 40), (1, 1, 25), (16, 10**9, 1 << 16)])
def test_search_against_all_documents(spark, monkeypatch, span, share, shard):
    monkeypatch.setattr(R, "SPAN", span)
    monkeypatch.setattr(R, "SHORT_SHARE", share)
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "PARTS", 3)
    texts = [prose(k, 5 + k % 90, 60) for k in range(150)]
    docs = list(enumerate(texts)) + [(200 + k, texts[k]) for k in range(30)] + [(500, None), (501, " .,- ")]
    items = [(k, prose(300 + k, 3 + k, 80)) for k in range(12)] + [(3, texts[4]), (20, "zzz unseen"), (21, ""), (22, None), (23, texts[1] * 3), (23, texts[1] * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found_search(d, i) == plain_search(docs, items)


def test_search_edges(spark, odd_docs, no_docs, no_benchmark):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "One TWO 漢字 word"), (None, prose(2, 300)), (2, "á")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert found_search(odd_docs, df) == plain_search(docs, items)
    assert found_search(odd_docs, df, top=2) == plain_search(docs, items, 2)
    assert R.ranked_documents(no_docs, df).count() == R.ranked_documents(odd_docs, no_benchmark).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    assert [(r[1], r[2]) for r in found_search(named, spark.createDataFrame([("q", "X")], "item_id string, text string"))] == [(1, "a"), (2, "b")]


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_CHARS", 60)
    docs, items = [(k, prose(k, 20, 50)) for k in range(40)], [(k, prose(90 + k, 6, 50)) for k in range(9)]
    found = found_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found == plain_search(docs, items)


def test_rows_with_other_columns(spark):
    rows = rows_of([prose(k, 30) for k in range(5)])
    df = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(1, prose(1, 5), "x", 2)], "item_id long, text string, rank string, score int")
    assert found_search(df, items) == plain_search([r[:2] for r in rows], [(1, prose(1, 5))])
    assert found_duplicates(df) == plain_duplicates([r[:2] for r in rows])


def test_near_copies_in_many_blocks(spark, monkeypatch):
    """A template's pages at 0.75, which stay apart, and near copies of some, in blocks of a few texts; columns of any name stay."""
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 900)
    core = prose(5, 120)
    texts = [core + " " + prose(2000 + k, 18, 4000) for k in range(50)]
    texts += [edited(t, 1, k) for k, t in enumerate(texts[:15])]
    df = spark.createDataFrame([(k, t, k, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, _id long, _null string, _hash int")
    assert N.near_copies(df).groupBy("component").count().where("count = 2").count() == 15
    kept = N.without_near_copies(df)
    assert kept.columns == df.columns and sorted(r["_id"] for r in kept.collect()) == list(range(50))
    named = spark.createDataFrame([("b", core), ("a", core), (None, core + " x")], "doc_id string, text string")
    assert [r["doc_id"] for r in N.without_near_copies(named).collect()] == ["a"]


def test_near_copies_by_fingerprints_alone(spark, monkeypatch):
    """Without minima, long near copies within two bits are joined; texts with one fingerprint that share too little are not."""
    whole = N._marked
    monkeypatch.setattr(N, "_marked", lambda docs: whole(docs).withColumn("points", F.array().cast("array<long>")))
    texts = [prose(700 + k, 4000) for k in range(12)]
    texts += [edited(t, 1, k) for k, t in enumerate(texts)] + ["a b c", "d e f", "", None]
    marks = [fingerprint(t or "", N.SHINGLE) for t in texts]
    near = [k for k in range(12) if (marks[k] ^ marks[12 + k]).bit_count() <= 2]
    found = {r["doc_id"]: r["component"] for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 6 and [k for k in range(12) if found[k] == found[12 + k]] == near
    assert found[26] == found[27] and len(set(found.values())) == 27 - len(near)


@pytest.mark.parametrize("large", [0, 256])
def test_fingerprints_within_two_bits_share_a_point(spark, monkeypatch, large):
    monkeypatch.setattr(N, "links", lambda distinct: links(distinct, large))
    r = random.Random(4)
    fps = sorted({sum(1 << b for b in r.sample(range(64), r.randrange(3))) for _ in range(120)})
    marked = spark.createDataFrame([(k, 5, k, signed(fp)) for k, fp in enumerate(fps)], "node long, n long, text_hash long, fp long")
    at = defaultdict(set)
    for row in N.fingerprint_points(marked).collect():
        at[row["node"]].add(row["point"])
    assert all(at[a] & at[b] for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2)


def test_many_pages_of_one_template(spark):
    """Two thousand pages of one template end soon, each on its own."""
    core = prose(5, 120)
    rows = [(k, f"{core} " + " ".join(f"w{k}x{j}" for j in range(17))) for k in range(2000)]
    began = time.time()
    found = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.select("component").distinct().count() == 2000 and time.time() - began < 120


def test_character_model_in_many_parts(spark, monkeypatch):
    """However many parts a model comes in, the verdicts are the same, and most parts need no table."""
    rows = [(k, prose(k, 150, 3000), "en" if k % 3 else "fr") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    told = []
    for part in (Q.PART, 300):
        monkeypatch.setattr(Q, "PART", part)
        began = time.time()
        told.append(sorted((r["doc_id"], round(r["log2_perplexity"], 5), r["kept"]) for r in Q.apply_rules(df).collect()))
        assert time.time() - began < 100
    assert told[0] == told[1]


def test_character_model_passes_the_driver_in_small_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("en", prose(k, 200)) for k in range(8)], "lang string, text string")
    whole = [part.value for part in Q.fitted(docs)["en"]]
    monkeypatch.setattr(Q, "SENT", 100)
    sizes, pack = [], Q.packed

    def noted(model, n_parts):
        found = pack(model, n_parts)
        sizes.extend(r["n"] for r in found.selectExpr("octet_length(keys) n").collect())
        return found

    monkeypatch.setattr(Q, "packed", noted)
    assert [part.value for part in Q.fitted(docs)["en"]] == whole
    assert len(sizes) > 1 and max(sizes) <= 8 * 100


def test_sorted_array_is_a_hash_array():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**64, 5000, np.uint64))
    values = r.random(len(keys)).astype(np.float32)
    wanted = np.concatenate([keys[::7], r.integers(0, 2**64, 500, np.uint64), keys[:3], keys[-1:]])
    np.testing.assert_array_equal(SortedArray(keys, values).find(wanted), HashArray(keys, values).find(wanted))
    assert np.isnan(SortedArray(keys[:0], values[:0]).find(wanted)).all()
