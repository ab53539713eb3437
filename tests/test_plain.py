"""Queries that SQL can't express, against plain versions over the whole tables."""

from __future__ import annotations

import difflib
import hashlib
import html
import re

import pandas as pd
import pytest

from gristmill.plans import all_queries  # noqa: F401
from gristmill.plans.registry import ORACLES, QUERIES


def given(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def kept_blocks(blocks):
    kept = []
    for block in blocks:
        if len(block) > 5 and not any(block in other for other in kept):
            kept = [other for other in kept if other not in block] + [block]
    return kept


def plain_block_texts(sf_dir):
    out = []
    for page in given(sf_dir, "pages").itertuples():
        article = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"<p>|</h1>", article)]
        out += [(page.page_id, k, b) for k, b in enumerate(kept_blocks(b for b in blocks if len(b) > 1))]
    return out


def plain_lines(sf_dir):
    out = []
    for doc in given(sf_dir, "documents").itertuples():
        lines = doc.text.split("\n")
        kept = kept_blocks(lines)
        out.append((doc.doc_id, len(lines), len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()))
    return out


def plain_fuzzy(sf_dir):
    parts = given(sf_dir, "part")
    parts["title"] = parts["p_type"].str.lower()
    first = parts.groupby("p_brand")["title"].min()
    rows = ((p.p_partkey, p.title, first[p.p_brand], round(difflib.SequenceMatcher(None, p.title, first[p.p_brand]).ratio(), 4)) for p in parts.itertuples())
    return [r for r in rows if r[3] >= 0.92]


def plain_segments(sf_dir):
    out = []
    for conv, turns in given(sf_dir, "conversations").sort_values(["conv_id", "turn", "text"]).groupby("conv_id"):
        texts = [t.strip() for t in turns["text"] if t and t.strip()]
        groups = []
        for t in texts:
            # a chunk of two or more closes when the next turn would pass a thousand characters
            if groups and not (len(groups[-1]) >= min(2, len(texts)) and sum(map(len, groups[-1])) + len(t) > 1000):
                groups[-1].append(t)
            else:
                groups.append([t])
        if len(groups) > 1 and len(groups[-1]) < 2:
            last = groups.pop()
            groups[-1] += last
        out += [(conv, k, " ".join(g)) for k, g in enumerate(groups)]
    return out


PLAIN = {"page_block_texts": plain_block_texts, "contained_lines_dropped": plain_lines, "fuzzy_category_titles": plain_fuzzy, "segment_chunks": plain_segments}


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_plain_version(spark, sf_dir, name):
    found = sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())
    assert found == sorted(PLAIN[name](sf_dir)) and len(found) > 3


def test_semantic_chunks_keep_all_words(spark, sf_dir):
    """Texts without marks of Markdown are cut between paragraphs, or in windows that overlap; nothing is lost and nothing grows too long."""
    rows = QUERIES["semantic_chunks"](spark, sf_dir).toPandas()
    number = next(c for c in rows.columns if c.endswith("_no"))
    text = next(c for c in rows.columns if c not in ("doc_id", number))
    assert rows[text].str.len().max() <= 1000 and not rows.duplicated(["doc_id", number]).any()
    chunks = rows.sort_values(["doc_id", number]).groupby("doc_id")[text].apply(list)
    for doc in given(sf_dir, "documents").itertuples():
        flat = lambda t: re.sub(r"\s", "", t)
        own, at = flat(doc.text), 0
        for chunk in chunks.get(doc.doc_id, []):
            found = own.find(flat(chunk), max(0, at - 50))
            assert 0 <= found <= at  # starts where the last one ended, or in what they share
            at = found + len(flat(chunk))
        assert at == len(own)


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLES) == {*PLAIN, "semantic_chunks"}
