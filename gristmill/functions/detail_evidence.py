"""Whether a page shows one post, by its address and what stands on it."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlsplit

from gristmill.functions.dom import Tree
from gristmill.functions.urls import CRAWL_PAGE_KEYS, DEDUP_PAGE_KEYS

# Marks of lists and of posts.
PAGING = ".pagination, .paging, .pg, .page-navi, .paging-area"
LIST_ITEMS = ["ul.board_list li", ".board_list li", ".list_box li", ".notice-list li", ".news-list li", "table tbody tr", ".board_list tr", ".list tr"]
LIST_PLACES = ["/board/", "/notice/", "/bbs/"]
BOARD_PARAMETERS = ["nttid", "ntt_id", "nttno", "bbsid", "bbs_id", "articleno", "article_no", "boardno", "board_no", "postno", "post_no", "num", "id", "seq", "no", "idx",
                    "articleid", "article_id", "bbsno", "bbs_no", "postid", "post_id", "boardid", "board_id", "docid", "doc_id", "progrmsn", "progrm_sn", "empmnsn", "empmn_sn",
                    "resvesn", "bizid", "wr_id", "document_srl"]
TITLE_LINKS = "h1 a, h2 a, h3 a, h4 a, .title a, .subject a, .post-title a, .article-title a, .board-title a, #title a, #subject a, a[rel=bookmark]"
DATE_PLACES = ["td.date", "td.reg-date", "td.write-date", "span.date", "span.reg-date", "span.write-date", ".date", ".reg-date", ".write-date", ".info", ".writer",
               ".post-meta", ".post-date", ".created", "[class*=date]", "[id*=date]", "[class*=info]"]
DATE_WORDS = ["등록일", "작성일", "날짜", "게시일"]
AUTHOR_PLACES = ".writer, .author, .post-author, [class*=writer], [class*=author]"
ARTICLE_CARDS = ["summary", "summary_large_image"]
PAGE_KEYS = {*CRAWL_PAGE_KEYS, *DEDUP_PAGE_KEYS}
LIST_FILE = re.compile(r"[a-z0-9]list\.(do|asp|jsp|php|html)")
DAY = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}")
#: Entries that make a list, letters that make a heading, and marks that make a post.
LIST_LENGTH, TITLE_LENGTH, LEAST_MARKS = 3, 5, 2


def _dated(text: str) -> bool:
    return bool(DAY.search(text)) or any(w in text for w in DATE_WORDS)


def looks_like_list(tree: Tree) -> bool:
    """Paging, three entries with a day or link in a list, or without any list three links near a day."""
    if tree.select(PAGING):
        return True
    entries = [k for s in LIST_ITEMS for k in tree.select(s)]
    if entries:
        return sum(bool(DAY.search(tree.text(k)) or tree.within(k, ["a"])) for k in entries) >= LIST_LENGTH
    near = (next((p for p in tree.ancestors(k) if tree.tag[p] in ("li", "tr", "div", "td")), max(tree.parent[k], 0)) for k in tree.by_tag.get("a", ()))
    return sum(_dated(tree.text(k)) for k in near) >= LIST_LENGTH


def detail_marks(tree: Tree, url: str) -> list[str]:
    """What speaks for one post on a page, in order; empty for addresses and pages that are lists.

    An address below a board is one of a list unless a parameter names an article,
    or has a positive number and is no page number.
    """
    low, parts = url.lower(), urlsplit(url)
    keys = {k.lower(): v for k, v in parse_qsl(parts.query)}
    named = any(v and (k in BOARD_PARAMETERS or re.fullmatch("0*[1-9][0-9]*", v) and k not in PAGE_KEYS) for k, v in keys.items())
    place = parts.path.lower()
    if not url or not len(tree) > 1 or LIST_FILE.search(low) or (any(x in place for x in LIST_PLACES) and "detail" not in place and not named) or looks_like_list(tree):
        return []
    heading = next((f"{tag}_title" for tag in ("h1", "h2", "h3") if (own := tree.by_tag.get(tag)) and len(tree.text(own[0])) >= TITLE_LENGTH), "")
    first = lambda s: tree.first(s)
    card = lambda s: tree.get(k, "content").strip().lower() if (k := first(s)) is not None else ""
    article = (card("meta[property=og:type]") or card("meta[name=og:type]")) == "article" or card("meta[name=twitter:card]") in ARTICLE_CARDS
    dated = any(_dated(tree.text(k)) for k in map(first, DATE_PLACES) if k is not None)
    marks = (
        ("query", "?" in url), ("board_parameter", any(k in BOARD_PARAMETERS for k in keys)), ("title_link" if tree.select(TITLE_LINKS) else heading, bool(tree.select(TITLE_LINKS) or heading)),
        ("date_place", dated), ("day", bool(DAY.search(tree.text(0)))),
        ("article_type", article), ("author", bool(tree.select(AUTHOR_PLACES))))
    return [mark for mark, holds in marks if holds]


def is_post(marks: list[str]) -> bool:
    return len(marks) >= LEAST_MARKS
