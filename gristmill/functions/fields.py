"""Standard forms of authors, marks, days, titles and rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import as_column
from gristmill.functions.dates import parse_date

# Labels and words of list pages.
AUTHOR_LABEL = r"(?i)^(작성자|담당자|등록자|author|writer)\s*[:：]?\s*"
NO_ATTACHMENT = ["", "x", "-", "0", "n", "no", "none", "false", "없음"]
TITLE_LABELS = r"(작성자|등록일|작성일|조회수?|첨부|번호|date|views|author)"
DAY = r"(?:19|20)?[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}"


def author(c: Column | str) -> Column:
    """A name without its label; '' for dashes."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(as_column(c), F.lit(""))), AUTHOR_LABEL, ""))
    return F.when(text.rlike(r"^[-–—.]*$"), "").otherwise(text)


def attached(c: Column | str) -> Column:
    """O where there is an attachment, else X."""
    return F.when(F.lower(F.trim(F.coalesce(as_column(c), F.lit("")))).isin(NO_ATTACHMENT), "X").otherwise("O")


def day(c: Column | str) -> Column:
    """A date as yyyy-MM-dd, or null."""
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def title(c: Column | str) -> Column:
    """A title without a tail of two labels or more, or of a date."""
    text = F.trim(F.regexp_replace(as_column(c), r"\s+", " "))
    labelled = F.regexp_replace(text, rf"(?i)\s+{TITLE_LABELS}\b.*{TITLE_LABELS}.*$", "")
    return F.trim(F.regexp_replace(labelled, rf"\s+{DAY}\s*$", ""))


def rule_tokens(json: Column | str) -> Column:
    """Distinct tokens, in order, of a JSON list or of a JSON text with bars between them."""
    text = as_column(json)
    listed = F.coalesce(F.from_json(text, "array<string>"), F.split(F.regexp_replace(F.trim(text), '^"|"$', ""), r"\|"))
    return F.array_distinct(F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != ""))
