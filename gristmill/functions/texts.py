"""Text functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import as_column

RRN = r"(?<![0-9])[0-9]{6}\s*[-－‐‑‒–—]\s*[0-9]{7}(?![0-9])"
SUCCESS_WORDS = ["success", "complete", "done", "saved"]
FAILURE_WORDS = ["fail", "error", "timeout", "skip", "blocked"]


def without_emoji(c: Column | str) -> Column:
    """Without code points from U+10000 on."""
    return F.regexp_replace(as_column(c), r"[\x{10000}-\x{10FFFF}]", "")


def without_controls(c: Column | str) -> Column:
    """Without control characters but tab and line ends."""
    return F.regexp_replace(as_column(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def clean_utf8(c: Column | str) -> Column:
    """Also without U+007F to U+009F."""
    return F.regexp_replace(as_column(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def flat(c: Column | str) -> Column:
    """Letters and digits only, in lower case, for comparing titles."""
    return F.lower(F.regexp_replace(as_column(c), r"(?U)[\W_]+", ""))


def has_rrn(c: Column | str) -> Column:
    """Whether something shaped like a resident registration number occurs."""
    return F.coalesce(as_column(c).rlike(RRN), F.lit(False))


def find_rrn(c: Column | str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(RRN), F.lit(0))


def mask_rrn(c: Column | str, replacement: str = "[RRN_MASKED]") -> Column:
    return F.regexp_replace(F.coalesce(as_column(c), F.lit("")), RRN, replacement.replace("$", r"\$"))


def masked_terms(c: Column | str, terms: list[str], mask: str = "***") -> tuple[Column, Column]:
    """(text with every term masked, how many were)."""
    text, count = as_column(c), F.lit(0).cast("long")
    for term in terms:
        count = count + ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")
        text = F.replace(text, F.lit(term), F.lit(mask))
    return text, count


def looks_like_markdown(c: Column | str) -> Column:
    """A heading, two table rows or three list items."""
    text = as_column(c)
    heads = F.regexp_count(text, F.lit(r"(?m)^#{1,3}\s+\S"))
    rows = F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*\|.+\|[^\S\n]*$"))
    items = F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*(?:[-*+]|[0-9]+[.)])\s+\S"))
    return (heads >= 1) | (rows >= 2) | (items >= 3)


def body_of(c: Column | str) -> Column:
    """Text without ``Key: value`` head lines that describe it, and with runs of blank lines squeezed."""
    lines = F.regexp_replace(as_column(c), r"(?m)^(Title|Author|Date|URL|Source):.*$\n?", "")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def has_body(c: Column | str) -> Column:
    """At least ten characters that aren't white space."""
    return F.length(F.regexp_replace(as_column(c), r"\s", "")) >= 10


def is_cid_text(c: Column | str) -> Column:
    """Text that a PDF left as glyph ids: five or more, and over 30 % of the words."""
    hits = F.regexp_count(as_column(c), F.lit(r"\(cid:[0-9]+\)"))
    words = F.size(F.filter(F.split(as_column(c), r"\s+"), lambda w: w != ""))
    return (hits >= 5) & (hits > 0.3 * words)


def snippet(c: Column | str, size: int = 200) -> Column:
    """Squeezed text of at most ``size`` characters, cut before a word, with ``...`` if cut."""
    text = F.trim(F.regexp_replace(as_column(c), r"\s+", " "))
    cut = F.regexp_replace(F.substring(text, 1, size), r"\s+\S*$", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def is_failure(c: Column | str) -> Column:
    """Whether an event tells of a failure: words of success win, blanks are failures."""
    low = F.lower(F.trim(F.coalesce(as_column(c), F.lit(""))))
    return (F.when(low == "", True).when(low.rlike("|".join(SUCCESS_WORDS)), False)
            .otherwise(low.rlike("|".join(FAILURE_WORDS))))


def hashed(c: Column | str, enabled: bool = True) -> Column:
    """SHA-256, or null where hashing is switched off."""
    return F.sha2(as_column(c).cast("binary"), 256) if enabled else F.lit(None).cast("string")


def unique_key(url: Column | str, name: Column | str, size: Column | str) -> Column:
    """Identity of a file: SHA-256 of URL, name and size."""
    return F.sha2(F.concat(*[F.coalesce(as_column(x).cast("string"), F.lit("")) for x in (url, name, size)]).cast("binary"), 256)


def query_signature(c: Column | str) -> Column:
    """``OPERATION table`` of a statement."""
    text = F.trim(F.regexp_replace(as_column(c), r"\s+", " "))
    return F.concat_ws(" ", F.upper(F.substring_index(text, " ", 1)),
                       F.lower(F.regexp_extract(text, r"(?i)\b(?:from|into|update|join)\s+([A-Za-z0-9_.]+)", 1)))


def trimmed_to_bytes(c: Column | str, limit: int) -> Column:
    """The longest prefix of whole characters that fits into ``limit`` UTF-8 bytes."""
    text = F.substring(as_column(c), 1, limit)
    sizes = F.filter(F.sequence(F.lit(0), F.length(text)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), F.array_max(sizes)))


def holds(c: Column | str, part: str) -> Column:
    """Whether a text holds a part as it is written; a blank part is in every text."""
    return as_column(c).contains(part)


def unescaped(c: Column | str) -> Column:
    """Text with the entities of HTML as characters and its white space squeezed."""
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else " ".join(html.unescape(t).split()) for t in texts], dtype="object")

    return F.pandas_udf(read, "string")(as_column(c))
