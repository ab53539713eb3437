"""The posts that a list page of a board names: addresses of its links and scripts that are those of posts, with titles and days.

Links are sought in the page's lists, else in its content. An address counts
as a post's by its parameters or its path; rows without a day stay, as nothing
says that they are out of range. Where no link is a post's, addresses written
anywhere in the page count, and after them the links of dated rows.
"""

from __future__ import annotations

import re
from datetime import date
from urllib.parse import parse_qs, parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from gristmill.functions.detail_evidence import BOARD_PARAMETERS
from gristmill.functions.dom import Tree
from gristmill.functions.page_parts import first_day, posts

# Where lists and content stand, and what addresses of posts and lists look like.
LIST_PLACES = ["table.bbsList", "table[class*=bbsList]", "ul.rp-tblstyle1", "ul.rowFluid", ".gallery2", ".tabPhoto", ".board_list", ".board-list", ".bbs_list",
               ".bbs-list", ".list_table", ".table_style2"]
CONTENT_PLACES = ["#content", "#contents", ".dbData", ".dbdata", ".view", ".view_wrap", ".content", ".contents", ".post", ".post-content", ".article",
                  ".article-content", "article", "main", ".board_view", ".board-view", "#main"]
POST_KEYS = {"nttid", "nttno", "q_bbscttsn", "bbscttsn", "articleid", "articleno", "seq", "idx", "no", "ctrtacctbookmngno"}
POST_PATHS = ["brddetail.do", "brdview.do", "postdetail.do", "selectbbsnttview.do", "selectbbsnttlist.do", "detail.do", "view.asp", "view.php", "view.jsp", "detail.asp",
              "detail.php", "detail.jsp", "read.asp", "read.php", "read.jsp", "board_view", "board_read", "board_detail", "selectempmntestinfo.do", "/view/", "/view?",
              "/detail/", "/read/", "/post/detail", "view.do", "read.do"]
LIST_PATHS = ["list.do", "list.asp", "list.jsp", "list.php", "list.html", "deptgdc.do"]
SITE_PATHS = [r"identity\.kisa\.or\.kr.*/web/main/bbs/[^/?#]+/\d+/*(?:[?#]|$)", r"epik\.go\.kr.*/epk/updates/\d+",
              r"yongin\.go\.kr[^?#]*/water/wttnkmanage/[^?#]*bd_select(?:wttnkcln|wtwayedc|wttnkinspct|wsptnkinspct)\.do\?(?:.*&)?q_(?:clnsn|edcsn|inspctsn|wsptnkinspctsn)=[^&#]"]
#: Parameters of lists whose numbers name no article.
NUMBER_KEYS = {"page", "pageindex", "page_index", "pageno", "page_no", "curpage", "cur_page", "pg", "cp", "boardpage", "startpage", "start", "offset", "limit",
               "rows", "row", "perpage", "pagesize", "listcount", "recordcountperpage", "block", "blockpage", "sst", "sod", "sop", "sort", "order", "ord", "year",
               "yr", "yyyy", "month", "mon", "mm", "day", "dd", "week", "wk", "category", "cat", "cate", "cat_id", "cate_id", "ctype", "mno", "menu", "menuno",
               "menu_cd", "menu_no", "deptid", "tab", "tabindex", "item", "p"}
#: Contracts of one city's lists: what the list's file is called, and the page of one of them.
CONTRACT_PLACE, CONTRACT_KEY = "/bidContractInfo/contractInfo/", "ctrtAcctBookMngNo"
CONTRACT_PAGES = {"hdContractList.do": "hdContractView.do", "contractList.do": "contractView.do", "accountList.do": "accountView.do"}
#: Attributes of a link that may hold an address, and whether it may stand there as it is.
ADDRESSES = {"href": True, "onclick": False, "data-url": True, "data-href": True}

_BOARD_PATH = re.compile(r"/(?:board|notice|bbs)(?:/[^/?#]+)*/?$")
_POST_PAGE, _APART = re.compile(r"(?:BD_selectBbs|view|detail)\.do", re.I), re.compile(r"[\"'()\s<>]+")
_QUOTED = re.compile(r"['\"]([^'\"]+)['\"]")
_OPENED = re.compile(r"opView\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", re.I)
_DAY = re.compile(r"(20\d{2})[-./](\d{1,2})[-./](\d{1,2})")
#: Characters of a content's text from which it is taken.
CONTENT_LENGTH = 20


def names_article(url: str) -> bool:
    """Whether a parameter names an article, or has a positive number and isn't one of lists."""
    pairs = [(k.strip().lower(), v.strip()) for k, v in parse_qsl(urlsplit(url).query)]
    return any(v and k in BOARD_PARAMETERS or k and re.fullmatch("0*[1-9][0-9]*", v, re.ASCII) and k not in NUMBER_KEYS for k, v in pairs)


def is_list_url(url: str) -> bool:
    """Whether an address is that of a list, unless its parameters name an article."""
    place = urlsplit(url).path.lower()
    return "openbrlviewer" not in url.lower() and (any(x in place for x in LIST_PATHS) or bool(_BOARD_PATH.search(place))) and not names_article(url)


def is_post_url(url: str, base: str) -> bool:
    """Whether an address is that of a post on the host of ``base``."""
    if not url:
        return False
    try:
        parts, host = urlsplit(url), urlsplit(base).netloc.lower()
        low, keys = url.lower(), {k.lower() for k, _ in parse_qsl(parts.query)}
        if parts.netloc and host and parts.netloc.lower() != host or "selectbbslist.do" in low:
            return False
        if keys & POST_KEYS:
            return True
        if is_list_url(url):
            return False
    except ValueError:  # no address at all
        return False
    return "openbrlviewer" in low or any(x in low for x in POST_PATHS) or any(re.search(x, low) for x in SITE_PATHS) or not keys.isdisjoint(BOARD_PARAMETERS)


def absolute(said: str, base: str) -> str:
    """An address as written in a page, made whole; empty for marks in the page and for scripts."""
    text = said.strip().replace("&amp;", "&")
    if not text or text.lower().startswith(("#", "mailto:", "tel:", "javascript:")):
        return ""
    try:
        return urljoin(base, text)
    except ValueError:
        return ""


def written(text: str) -> list[str]:
    """The addresses of pages of posts that are written in a text, whatever it is."""
    return [x for x in _APART.split(text) if _POST_PAGE.search(x)] if _POST_PAGE.search(text) else []


def _by_number(text: str, base: str) -> str:
    """The post that the last number of a script means, on lists that go by numbers."""
    if "BD_selectBbsList.do" not in base or "q_bbscttsn" in text.lower():
        return ""
    parts = urlsplit(base)
    code = next((v for k in ("q_bbsCode", "q_bbscode") for v in parse_qs(parts.query).get(k, ())), "")
    numbers = re.findall(r"\b\d{3,}\b", text)
    if not code or not numbers:
        return ""
    return urlunsplit((parts.scheme, parts.netloc, parts.path.replace("BD_selectBbsList.do", "BD_selectBbs.do"), urlencode({"q_bbsCode": code, "q_bbscttSn": numbers[-1]}), ""))


def _contract(text: str, base: str) -> str:
    """The contract that a script opens, on the lists of contracts."""
    if CONTRACT_PLACE not in base or not (m := _OPENED.search(text)) or not m[1].strip():
        return ""
    parts = urlsplit(base)
    if "gm.go.kr" not in parts.netloc.lower() or CONTRACT_PLACE not in parts.path:
        return ""
    folder, _, file = parts.path.rpartition("/")
    old = next((x for x in CONTRACT_PAGES if file.endswith(x)), "")
    page = file.removesuffix(old) + CONTRACT_PAGES[old] if old else "contractView.do"
    query = parse_qs(parts.query, keep_blank_values=True) | {CONTRACT_KEY: [m[1].strip()]}
    return urlunsplit((parts.scheme, parts.netloc, f"{folder}/{page}", urlencode(query, doseq=True), ""))


def addresses(tree: Tree, node: int, base: str) -> list[str]:
    """The addresses of posts that a link leads to, by its attributes: as they stand, else what their scripts name."""
    out: dict[str, None] = {}
    for name, direct in ADDRESSES.items():
        if not (said := tree.get(node, name).strip()):
            continue
        if direct and is_post_url(own := absolute(said, base), base):
            out[own] = None
            continue
        named = [absolute(x, base) for x in (*_QUOTED.findall(said), *written(said))]
        out |= dict.fromkeys(x for x in (*named, _by_number(said, base), _contract(said, base)) if is_post_url(x, base))
    return list(out)


def day_of(text: str) -> str:
    """The first day of a row as yyyy-mm-dd, or nothing if there is none or no such day."""
    m = _DAY.search(text)
    try:
        return date(int(m[1]), int(m[2]), int(m[3])).isoformat() if m else date.fromisoformat(day).isoformat() if (day := first_day(text)) else ""
    except ValueError:
        return ""


def places(tree: Tree) -> list[int]:
    """Where the entries of a page are sought: its lists, else the content with most text, else its body."""
    if lists := list(dict.fromkeys(k for s in LIST_PLACES for k in tree.select(s))):
        return lists
    length = lambda k: len(tree.text(k))
    for found in ([k for s in CONTENT_PLACES if (k := tree.first(s)) is not None], tree.within(0, ["article", "main"])):
        if found and length(best := max(found, key=length)) > CONTENT_LENGTH:
            return [best]
    return tree.by_tag.get("body", [0])[:1]


def entries(tree: Tree, base: str) -> list[tuple[str, str, str]]:
    """(url, title, day) of each mention of a post, in order; day is that of its row."""
    out, days = [], {}
    for k in dict.fromkeys(k for place in places(tree) for k in tree.within(place, ["a"])):
        if found := addresses(tree, k, base):
            row = next((p for tag in ("tr", "li", "div") for p in tree.ancestors(k) if tree.tag[p] == tag), k)
            if row not in days:  # a row may hold all links of a page
                days[row] = day_of(tree.text(row))
            out += [(url, tree.text(k) or tree.get(k, "title").strip(), days[row]) for url in found]
    if not out:
        out = [(url, "", "") for x in written(tree.source) if is_post_url(url := absolute(x, base), base)]
    return out or posts(tree, base)


def list_posts(tree: Tree, base: str, start: str = "", end: str = "", old_rows: int = 3) -> dict[str, object]:
    """posts (url, title, day) of a list page, each address once, those before ``start`` as old and after ``end`` as new; stopped after ``old_rows`` old ones.

    Bounds are days, inclusive, none if empty. A post without a day is never
    out of range. A repeated address gives its title to one that has none.
    stopped says that pages that follow need not be read; this one is read whole.
    """
    try:
        urlsplit(base)
    except ValueError:  # no address to which others are relative
        base = ""
    found: dict[str, tuple[str, str, str]] = {}
    old, new = [], []
    for url, title, day in entries(tree, base):
        if url in found:
            if not found[url][1]:
                found[url] = (url, title, found[url][2])
        elif day and start and day < start:
            old.append((url, title, day))
        elif day and end and day > end:
            new.append((url, title, day))
        else:
            found[url] = (url, title, day)
    return {"posts": list(found.values()), "old": old, "new": new, "stopped": len(old) >= max(1, old_rows)}
