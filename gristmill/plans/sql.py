"""Pieces of DuckDB SQL that several queries' SQL shares."""

from __future__ import annotations

from gristmill.functions.urls import CRAWL_PAGE_KEYS, CRAWL_VOLATILE_KEYS, DEDUP_PAGE_KEYS, DEDUP_VOLATILE_KEYS, TRACKING_KEYS

SCHEME = "lower(regexp_extract(url, '^([a-zA-Z]+)://', 1))"
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def listed(keys: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in keys)


def segments(path: str) -> str:
    return f"[s for s in string_split({path}, '/') if s <> '']"


def pairs(query: str, drop: list[str]) -> str:
    return (f"list_sort([p for p in string_split({query}, '&') if regexp_matches(p, '^[^=]+=.') "
            f"and split_part(p, '=', 1) not in ({listed(drop)}) and not starts_with(p, 'utm_')])")


def with_query(place: str, found: str) -> str:
    return f"{place} || case when len({found}) > 0 then '?' || array_to_string({found}, '&') else '' end"


CRAWL_KEY = (f"regexp_replace({SCHEME} || '://' || {BARE} || " + with_query(
    f"'/' || array_to_string({segments(f'lower({PATH})')}, '/')",
    pairs(f"lower({QUERY})", [*CRAWL_PAGE_KEYS, *TRACKING_KEYS, *CRAWL_VOLATILE_KEYS])) + ", '/+$', '')")
DEDUP_KEY = (f"{SCHEME} || '://' || {BARE} || " + with_query(
    f"'/' || array_to_string({segments(PATH)}, '/')", pairs(QUERY, [*DEDUP_PAGE_KEYS, *TRACKING_KEYS, *DEDUP_VOLATILE_KEYS])))


def unescaped(text: str) -> str:
    """``text`` with entities as characters, as HTML reads them: those that old pages wrote count without their semicolon too."""
    for name, c in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{c}', 'g')"
    return text
