"""Rows that the tests of this folder share."""

from __future__ import annotations

import os
import random

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position string, key string, n int, g string"


def rows_of(texts, start=0):
    """Documents with columns whose names clash with those that operators use."""
    return [(start + k, t, "en", f"src{k % 3}", len(t or ""), "p", "k", 1, "g") for k, t in enumerate(texts)]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    syllables = ["the", "on", "er", "at", "in", "re", "ha", "th", "nd", "ou", "es", "st"]
    words = ["".join(r.choice(syllables) for _ in range(1 + (w * 7) % 3)) + str(w % 2) * (w % 11 == 0) for w in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))
