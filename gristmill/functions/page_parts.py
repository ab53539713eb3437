"""What is read from a page's tree: main content, titles, attachments, posts, trails and menus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote, urljoin, urlsplit

from gristmill.functions.dom import Tree
from gristmill.functions.script_calls import EXTENSIONS, parameters, script_download

# Where the content of a page is sought, and what is never content.
CONTENT_SELECTORS = ["main", "[role=main]", ".main", "#main", "article", ".article", ".content", "#content", ".post", ".entry", ".board_view_content"]
CONTENT_DROPPED_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
CONTENT_DROPPED_CLASSES = ["ad", "advertisement", "banner", "menu", "nav", "sidebar", "footer", "header", "social", "share", "comment"]
FAST_CONTENT_SELECTORS = [
    "#contents .board_view", "#contents .bbs_view", "#contents .view_area", "#contents .view_cont", "#contents .view_content",
    "#contents .board_view_content", "#contents .bbs_view_content", "#contents .tbl_view", "#content .board_view", "#content .bbs_view",
    "#content .view_area", "#content .view_cont", "#content .view_content", ".board_view", ".bbs_view", ".board-view", ".bbs-view",
    ".view_area", ".view_cont", ".view-content", ".view_content", ".board_view_content", ".bbs_view_content", ".tbl_view", "article",
    "#contents", "#content", "body"]

# Where titles are sought and what marks them.
TITLE_ROOTS = ["#view_div", ".bod_view", ".board_view", ".view_top", ".view_cont", ".view-cont", ".p-table", "#contents", "#content", "#conts",
               "article", "main", "[role=main]"]
TITLE_PLACES = [".poll_view > h4.no_bgimg.mT0", ".poll_view h4.no_bgimg", ".poll_view > h4", "strong.tit", ".tit", ".view_top .tit",
                ".board_view .tit", ".bod_view h4", ".board_view h4", ".view_cont h4", ".view-cont h4", ".board_view_title", ".bod_view_title",
                ".view_title"]
TITLE_CLASSES = ["subject", "sub", "heading", "제목", "headline", "tit", "pg-tit", "pg-title", "pg-hd-tit", "sub-tit", "sub-title", "sub-cont1", "title",
                 "sp-title", "big_title", "htit", "p-table__subject_text", "sub_title", "subject_title", "main-content-tit", "head", "board-view",
                 "content-title"]
TITLE_IDS = ["title", "subject", "heading", "tit", "sub", "head", "sub-cont1"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6", "h7", "h8"]
OTHER_TITLE_TAGS = ["div", "span", "p", "strong", "b", "em", "section"]
NAV_TAGS = ["nav", "header", "footer", "aside"]
NAV_WORDS = ["left-nav", "navigation", "nav", "menu", "sidebar", "left-menu", "side-nav", "gnb", "lnb", "top-nav", "main-nav", "left-tit", "aside",
             "submenu", "area", "skip", "jump_menu", "blind", "header", "footer", "site-header", "site-footer", "global-header", "global-footer",
             "header-box", "quick-links", "header-tp", "header-tp-right", "header-tp-left", "tp-right-util", "quick-links-btn", "quick-links-list"]
NAV_EXACT = ["tit mt20", "sub-visual sb5", "sub-visual sb1", "box_title h0"]
NAV_IDS = ["jump_menu", "skip", "gnb", "lnb", "nav", "menu", "header", "footer", "nuri-header-top", "layout-wrap", "skipnavigation"]
NOISE_IN_TITLES = ["tag", "badge", "label", "date", "status", "state"]
STATUS_WORDS = ["접수중", "접수마감", "접수예정", "신청중", "신청마감", "모집중", "모집마감", "공고중", "진행중", "진행예정", "상시"]
META_LABELS = ["작성자", "등록자", "등록인", "담당자", "글쓴이", "성명", "담당부서", "부서", "부서명", "작성부서", "작성부서명", "등록일", "작성일", "게시일",
               "수정일", "조회수", "조회"]
DATED_LABELS = ["등록일", "작성일", "게시일", "수정일", "조회수", "조회"]

# Scored titles.
SCORED_PLACES = ["#divTable .tr", ".table .tr", ".board_view .title", ".bbs_view .subject", ".view_title", ".view-title", ".view_tit h4", ".view_tit h5",
                 "#bo_view .view_tit h5", "caption.tit_article", "table caption.tit_article", ".board-view-title", ".p-table__subject_text", "td.title",
                 "th.subject", ".subject", ".title", ".tit", "h1", "h2", "meta[property=og:title]", "meta[name=twitter:title]", "title"]
SCORED_CONTENT = [".content", ".view_content", ".view_cont", ".board_view", ".bbs_view", "article", "main"]
SCORES = {"inside_post_area": 40, "heading_or_title": 30, "caption_article_title": 15, "view_title_container": 25, "page_section_title": -55,
          "semantic_class_or_id": 25, "label_value_row": 35, "prev_next_row": -90, "bad_length": -20, "site_or_menu_only": -30,
          "admin_or_layout_title": -50, "same_as_body_first_sentence": -10, "breadcrumb": -20}
TITLE_LABELS = ["제목", "글제목", "게시글제목", "행사명", "축제명", "공연명", "전시명", "강연명", "교육명", "사업명", "프로그램명", "프로그램", "title", "subject"]
LAYOUT_TITLES = ["자료관리", "최상단메뉴", "전체메뉴", "하단메뉴영역", "주소연락처copyright", "보건소소개"]
MENU_TITLES = ["내비게이션메뉴", "네비게이션메뉴", "navigationmenu", "navmenu", "연관자료", "홈", "목록", "상세보기", "게시판", "공지사항", "보도자료", "종로구청",
               "종로구의회", "안내메시지", *LAYOUT_TITLES]
NEIGHBOUR_ROWS = ["이전글", "다음글"]
ERROR_TITLES = ["error", "err", "404", "500", "403", "502", "503", "badrequest", "notfound", "내비게이션메뉴", "네비게이션메뉴", "navigationmenu", "navmenu"]
ERROR_PARTS = ["error_title", "server error", "runtime error"]
TRAIL_WORDS = ["breadcrumb", "location", "path", "navigation", "nav"]

# Trails.
TRAIL_PLACES = ["nav[aria-label*=breadcrumb]", "nav[aria-label*=Breadcrumb]", "ol.breadcrumb", "ul.breadcrumb", ".breadcrumb", "#breadcrumb", ".breadcrumbs", ".bread-crumb",
                ".breadCrumb", ".location", ".locationarea", ".page_location", ".page-location", ".pagepath", ".page-path", ".pagePath", ".path"]
TRAIL_MARKS = [">", "/", "|"]
HOME_WORDS = ["home", "main", "start", "homepage", "홈"]
LABEL_TAGS = ["a", "span", "em", "strong", "button"]

# Attachments.
DOWNLOAD_HINTS = ["downloadbbsfile", "filedown", "filedownload", "file_down", "download.do", "download.jsp", "atchfile", "atchmnfl", "filesn", "fileid",
                  "file_id", "file_sn", "/file/download/", "/download/uu/", "downloadcontentsfile", "menucntfile", "process.file.do"]
PREVIEW_HINTS = ["previewbbs", "previewmenucntfile", "previewmenu", "htmlconv.do", "preview.jsp", "convert.jsp", "/convert/", "viewer", "tts"]
ATTACHMENT_ROOTS = [".p-attach", ".file_area", ".file-list", ".file_list", ".fileList", ".attach", ".attachment", ".bbs_file", ".bbs-file", ".filebox",
                    ".fileBox", "[class*=attach]", "[id*=attach]", "[class*=file]"]
ATTACHMENT_LABELS = ["첨부", "첨부파일", "파일", "붙임", "다운로드"]
ATTACHMENT_WORDS = ["attach", "file-list", "file_list", "filebox", "file-box", "filedown", "download"]
NOISE_WORDS = ["gnb", "lnb", "snb", "menu", "nav", "breadcrumb", "footer", "header", "quick", "sns", "share", "depth", "side", "family-site",
               "family_site", "related-site", "related_site", "major-site", "major_site", "shortcut", "site-link", "site_link"]
GENERIC_NAMES = ["attachment", "attachedfile", "file", "download", "filedownload", "view", "preview", "open", "save", "첨부", "첨부파일", "파일", "다운로드",
                 "파일다운로드", "내려받기", "받기", "바로보기", "미리보기"]
NAME_PARAMETERS = ["user_file_nm", "file_nm", "filename", "orgfilenm"]
LINK_ATTRIBUTES = ["href", "data-href", "data-url", "data-download-url", "formaction"]

# Anchors of menus, and where menus stand.
MENU_TAGS = ["nav", "header", "footer", "aside"]
MENU_HINTS = ["menu", "gnb", "lnb", "snb", "sidebar", "nav", "header", "footer", "topmenu", "quick"]
MENU_PLACES = ["header", "nav", "#gnb", ".gnb", ".menu", ".nav", "ul.menu-depth1", "ul.depth1"]
MENU_DEPTH = 5
# Rel values that name an icon, the first that is there counts; after them any with "icon" in it.
ICON_RELS = ["icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed"]
FAST_LINKS = 80

_FLAT = re.compile(r"[\s:：ㆍ·\-\[\]()]")
_COMPACT = re.compile(r"[\s:\-\[\]().]+")
_DAY = re.compile(r"(20\d{2}|19\d{2})\s*[-./년]\s*(1[0-2]|0?[1-9])\s*[-./월]\s*(3[01]|[12]\d|0?[1-9])(?!\d)")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_EXTENSION = re.compile(rf"(?i)\.({'|'.join(EXTENSIONS)})(?=$|[\s\])}},;:&?#])")
_FILE_NAME = re.compile(rf"(?i)([^\s\"'<>]{{1,220}}\.(?:{'|'.join(EXTENSIONS)}))(?![a-z0-9])")
_SIZE_END = re.compile(r"(?i)\s*[\[(]?\s*[0-9]+(?:[.,][0-9]+)?\s*(?:bytes?|[kmgt]?b|[kmgt]bytes?)\s*[\])]?\s*$")
_STATUS = re.compile(rf"^(?:(?:{'|'.join(STATUS_WORDS)})\s*(?:\([^)]*\))?\s*)+")
_NOT_LINKS = ("#", "javascript:", "mailto:", "tel:")


def flat(text: str) -> str:
    return _FLAT.sub("", text).lower()


def compact(text: str) -> str:
    return _COMPACT.sub("", text.lower())


# content


def content(tree: Tree) -> str:
    """The text of the first place of content, without menus and advertisements; else that of the body, or of the page."""
    noisy = [k for k in range(1, len(tree)) if any(w in name.lower() for name in tree.classes(k) for w in CONTENT_DROPPED_CLASSES)]
    dropped = tree.marked([*tree.within(0, CONTENT_DROPPED_TAGS), *noisy])
    for selector in CONTENT_SELECTORS:
        found = next((k for k in tree.select(selector) if not dropped[k]), None)
        if found is not None:
            if text := tree.text(found, dropped):
                return text
            break
    body = next((k for k in tree.by_tag.get("body", ()) if not dropped[k]), 0)
    return tree.text(body, dropped)


def fast_parse(tree: Tree, base: str) -> dict:
    """Title, content, first day and up to 80 links of a page, read without judging; ok says whether that is worth something."""
    dropped = tree.marked(tree.within(0, ["script", "style", "noscript", "svg", "iframe"]))
    title = next((v for s in ("meta[property=og:title]", "meta[name=title]", "meta[name=twitter:title]")
                  if (k := tree.first(s)) is not None and (v := tree.get(k, "content").strip())), "")
    title = title or next((tree.text(k) for k in tree.by_tag.get("title", ())), "")
    text, place = "", "root"
    for selector in FAST_CONTENT_SELECTORS:
        if (k := tree.first(selector)) is not None and (len(t := tree.text(k, dropped)) >= 30 or selector == "body"):
            text, place = t, selector
            break
    text = text or tree.text(0, dropped)
    day = first_day(text[:20_000])
    links = list(dict.fromkeys(urljoin(base, href) for k in tree.by_tag.get("a", ())
                               if (href := tree.get(k, "href").strip()) and not href.startswith(_NOT_LINKS)))[:FAST_LINKS]
    return {"title": title, "content": text, "place": place, "day": day, "links": links, "ok": bool(title or len(text) >= 30 or day)}


def first_day(text: str) -> str:
    """The first day in a text as yyyy-mm-dd, or nothing."""
    m = _DAY.search(text)
    return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}" if m else ""


# titles


def _is_menu(tree: Tree, node: int) -> bool:
    classes, name = [x.lower() for x in tree.classes(node)], tree.get(node, "id").lower()
    return (tree.tag[node] in NAV_TAGS or any(w in c for c in classes for w in NAV_WORDS)
            or sorted(classes) in [sorted(x.split()) for x in NAV_EXACT] and bool(classes) or any(w in name for w in NAV_IDS))


def _without_tail(text: str) -> str:
    """A title without status words in front, a day behind, and the labelled values that follow it."""
    text = _STATUS.sub("", " ".join(text.split())).strip()
    text = re.sub(r"\s+\d{4}\.\d{1,2}\.\d{1,2}\.?\s*$", "", text).strip()
    found = []
    for label in META_LABELS:
        at = text.find(f" {label}")
        after = text[at + len(label) + 1:][:1]
        if at >= 0 and (not after or after.isspace() or after in ":："):
            found.append((at, label))
    if not found:
        return text
    at, label = min(found, key=lambda x: x[0])
    tail = text[at:].strip()
    many = sum(f" {x}" in tail for x in META_LABELS)
    dated = bool(re.search(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{4}년\s*\d{1,2}월\s*\d{1,2}일", tail))
    return text[:at].strip(" -|:/") if many >= 2 or dated and (many >= 1 or label in DATED_LABELS) else text


def title_text(tree: Tree, node: int) -> str:
    """The title that a node holds: its own text if it is a heading, else that of the first heading in it that is no badge."""
    if tree.tag[node] not in HEADINGS[:6]:
        for inner in tree.within(node, ["strong", *HEADINGS[:6]]):
            chain = [inner, *tree.ancestors(inner)]
            if not any(w in name for k in chain for name in tree.named(k) for w in NOISE_IN_TITLES) and (text := _without_tail(tree.text(inner))):
                return text
    return _without_tail(tree.text(node))


def title(tree: Tree, block: str | None = None) -> tuple[str, str]:
    """(title, stage): block, place, heading_class, heading, class, article, meta, tag; the first stage that has one.

    ``block`` is a selector that is known for the site. Menus and what hangs in
    them, headers and footers hold no title.
    """
    excluded: dict[int, bool] = {}

    def in_menu(node: int) -> bool:
        if node <= 0:
            return False
        if node not in excluded:
            excluded[node] = _is_menu(tree, node) or in_menu(tree.parent[node])
        return excluded[node]

    def roots() -> list[int]:
        return [*dict.fromkeys(k for s in TITLE_ROOTS if (k := tree.first(s)) is not None), 0]

    def titles(nodes: list[int], least: int = 1) -> str:
        return next((t for k in nodes if not in_menu(k) and len(t := title_text(tree, k)) >= least), "")

    def has_class(node: int) -> bool:
        return any(x.lower() in TITLE_CLASSES for x in tree.classes(node))

    if block and block.strip():
        try:
            found = tree.select(block.strip()) or tree.select(f".{block.strip()}")
        except ValueError:
            found = []
        if text := next((t for k in found if len(t := title_text(tree, k)) > 5), ""):
            return text, "block"
    for places in TITLE_PLACES:
        if text := titles(tree.select(places), 6):
            return text, "place"
    for root in roots():
        marked = [k for k in tree.within(root, HEADINGS) if has_class(k) or any(w in tree.get(k, "id").lower() for w in TITLE_IDS)]
        if text := titles(marked) or titles([k for k in tree.within(root, ["p"]) if has_class(k)]):
            return text, "heading_class"
    for root in roots():
        if text := titles(tree.within(root, HEADINGS)):
            return text, "heading"
    for root in roots():
        for tag in OTHER_TITLE_TAGS:
            if text := titles([k for k in tree.within(root, [tag]) if has_class(k) and len(tree.text(k)) <= 200]):
                return text, "class"
    if (article := tree.first("article")) is not None:
        for tag in HEADINGS[:6]:
            first = next(iter(tree.within(article, [tag])), None)
            if first is not None and not tree.within(first, ["a"]) and (text := title_text(tree, first)):
                return text, "article"
    for selector, most in (("meta[property=og:title]", None), ("meta[name=twitter:title]", None), ("meta[name=description]", 100)):
        if (k := tree.first(selector)) is not None and (text := tree.get(k, "content").strip()) and (most is None or len(text) <= most):
            return text, "meta"
    text = next((tree.text(k) for k in tree.by_tag.get("title", ())), "")
    return (text, "tag") if text else ("", "")


def _label_and_value(tree: Tree, node: int) -> tuple[int | None, int | None]:
    def child(tags: tuple[str, ...], name: str) -> int | None:
        return next((k for k in tree.children(node) if tree.tag[k] in tags or name in tree.classes(k)), None)

    return child(("th", "dt"), "th"), child(("td", "dd"), "td")


def scored_titles(tree: Tree) -> list[tuple[str, str, int, list[str]]]:
    """(text, selector, score, reasons) of title candidates by falling score, each text once at its best; 20 at most."""
    roots = [k for s in SCORED_CONTENT for k in tree.select(s)[:5]] or [0]
    inside = tree.marked(roots)
    sentence = next((s for r in roots if (s := _SENTENCE.split(tree.text(r), maxsplit=1)[0][:160])), "")
    best: dict[str, tuple[str, str, int, list[str]]] = {}
    for selector in SCORED_PLACES:
        for node in tree.select(selector)[:20]:
            tag, semantic = tree.tag[node], " ".join(tree.named(node))
            label, value = _label_and_value(tree, node)
            labelled = label is not None and value is not None and flat(tree.text(label)) in TITLE_LABELS
            text = tree.text(value) if labelled else tree.get(node, "content") if tag == "meta" else tree.get(node, "value") or tree.text(node)
            text = " ".join(unescape(text).replace("\xa0", " ").split())
            if (tag == "caption" and "tit_article" in semantic) or (tag in ("h4", "h5") and "view_tit" in selector):
                cut = re.sub(r"^\[[^\]]{1,20}\]\s*", "", text)
                text = cut if len(cut) >= 6 else text
            key = flat(text)
            if not text or key in ERROR_TITLES or any(w in text.lower() for w in ERROR_PARTS):
                continue
            heading = tag in ("h1", "h2", "title", "caption") or "title" in selector or (tag in ("h4", "h5") and "view_tit" in selector) or (
                tag in ("h3", "h4") and any(w in semantic for w in ("title", "subject", "tit"))) or (
                tag == "th" and tree.get(node, "scope").lower() == "colgroup")
            own_label = flat(tree.text(label)) if label is not None and value is not None else ""
            reasons = [r for r, holds in (
                ("inside_post_area", inside[node]), ("heading_or_title", heading), ("caption_article_title", tag == "caption" and "tit_article" in selector),
                ("view_title_container", "view_tit" in selector), ("page_section_title", "tit_page" in semantic),
                ("semantic_class_or_id", any(w in semantic or w in selector for w in ("title", "subject", "view", "tit"))),
                ("label_value_row", labelled), ("prev_next_row", own_label in NEIGHBOUR_ROWS or key.startswith(tuple(NEIGHBOUR_ROWS))),
                ("bad_length", not 4 <= len(text) <= 160), ("site_or_menu_only", key in MENU_TITLES or len(key) <= 3 and not re.search(r"\d", key)),
                ("admin_or_layout_title", key in LAYOUT_TITLES), ("same_as_body_first_sentence", bool(sentence) and flat(sentence) == key),
                ("breadcrumb", any(w in semantic for w in TRAIL_WORDS) or text.count(">") >= 2 or " 홈 " in text)) if holds]
            score = sum(SCORES[r] for r in reasons)
            if key not in best or best[key][2] < score:
                best[key] = (text, selector, score, reasons)
    return sorted(best.values(), key=lambda x: -x[2])[:20]


# attachments


def extension(*values: str) -> str:
    m = _EXTENSION.search(" ".join(values))
    return m[1].lower() if m else ""


def is_download(url: str) -> bool:
    low = url.lower()
    return bool(low) and not any(w in low for w in PREVIEW_HINTS) and (any(w in low for w in DOWNLOAD_HINTS) or bool(extension(low)))


def clean_name(text: str) -> str:
    """A file's name without a size, plus signs and words like download behind it."""
    name = re.sub(r"\++", " ", _SIZE_END.sub("", " ".join(text.split())))
    return re.sub(r"(?i)\s*(?:download|view|open|다운로드|내려받기|바로보기|미리보기)\s*$", "", name).strip(" -_|:")


def is_attachment_label(text: str) -> bool:
    key = compact(text)
    return key in ATTACHMENT_LABELS or "첨부파일" in key


def _in_noise(tree: Tree, node: int) -> bool:
    """Whether a node hangs in a menu and not in a list of files, by what stands up to eight steps above it."""
    for k in [node, *tree.ancestors(node)][:8]:
        words = " ".join([*tree.named(k), tree.get(k, "role"), tree.get(k, "aria-label")]).lower()
        if any(w in words for w in ATTACHMENT_WORDS):
            return False
        if tree.tag[k] in NAV_TAGS or any(w in words for w in NOISE_WORDS):
            return True
    return False


def _attachment_nodes(tree: Tree) -> list[int]:
    """Links and buttons: those in places of attachments first, then all outside of menus."""
    roots = [k for s in ATTACHMENT_ROOTS for k in tree.select(s)]
    for row in tree.by_tag.get("tr", ()):
        cells = [k for k in tree.children(row) if tree.tag[k] in ("th", "td")]
        if cells and is_attachment_label(tree.text(cells[0])):
            roots.append(cells[1] if len(cells) > 1 else row)
    for label in tree.by_tag.get("dt", ()):
        if is_attachment_label(tree.text(label)):
            after = [k for k in tree.children(tree.parent[label]) if k > label and tree.tag[k] == "dd"]
            roots.append(after[0] if after else tree.parent[label])
    tags = ["a", "button", "input"]
    inside = [k for r in dict.fromkeys(roots) if not _in_noise(tree, r) for k in tree.within(r, tags)]
    return list(dict.fromkeys([*inside, *(k for k in tree.within(0, tags) if not _in_noise(tree, k))]))


def _attachment_name(tree: Tree, node: int, url: str) -> str:
    """A name with an ending from the link, else from beside it, else from the address, else what the link says."""
    said = [clean_name(x) for x in [*(tree.get(node, a) for a in ("download", "title", "aria-label", "alt", "value")), tree.text(node)]]
    if found := next((x for x in said if extension(x)), ""):
        return found
    near = [k for k in tree.ancestors(node) if tree.tag[k] in ("li", "tr", "td", "dl", "div")][:5]
    for place in near:
        if found := next((x for s in ("p", ".file-name", ".file_name", ".filename", ".name", "span") for k in tree.select(s, place)
                          if extension(x := clean_name(tree.text(k))) and len(x) <= 220), ""):
            return found
    real = next((x for x in said if len(x) > 1 and compact(x) not in GENERIC_NAMES and compact(x) not in EXTENSIONS), "")
    if (end := extension(url)) and real:
        return real if real.lower().endswith(f".{end}") else f"{real}.{end}"
    for place in near:
        for s in (".subject", ".file_subject", ".file-title", ".file_title", "[class*=subject]", "[class*=title]"):
            if (k := tree.first(s, place)) is not None and (x := clean_name(tree.text(k))) and compact(x) not in GENERIC_NAMES:
                return x
    if m := _FILE_NAME.search(tree.text(max(tree.parent[node], 0))):
        return clean_name(m[1])
    given = parameters(url)
    if found := next((clean_name(given[p]) for p in NAME_PARAMETERS if given.get(p)), ""):
        return found
    tail = clean_name(unquote(urlsplit(url).path.rstrip("/").rpartition("/")[2]))
    return real or (tail if extension(tail) else "attachment")


def attachments(tree: Tree, base: str) -> list[tuple[str, str, str, bool]]:
    """(url, name, reason, to be checked) of the files that a page offers, each address once, in the order of their places.

    The reason is href, onclick or javascript; an address that a script makes is
    to be checked against its response.
    """
    out: dict[str, tuple[str, str, str, bool]] = {}
    for node in _attachment_nodes(tree):
        raw = next((x for a in LINK_ATTRIBUTES if (x := tree.get(node, a).strip())), "")
        scripts = [(tree.get(node, "onclick"), "onclick"), (raw, "javascript")]
        url, reason, unsure = "", "", False
        if raw and not raw.lower().startswith(_NOT_LINKS) and is_download(joined := urljoin(base, raw)):
            url, reason = joined, "href"
        for script, kind in scripts:
            if not url and (kind == "onclick" or script.lower().startswith("javascript:")) and (found := script_download(script, base)) and is_download(found):
                url, reason, unsure = found, kind, True
        if url and url not in out:
            out[url] = (url, _attachment_name(tree, node, url), reason, unsure)
    return list(out.values())


def favicon(tree: Tree, base: str) -> str:
    """The address of a page's icon: of its link tags, or ``/favicon.ico`` of its host."""
    found = [(" ".join(tree.get(k, "rel").split()).lower(), tree.get(k, "href").strip()) for k in tree.by_tag.get("link", ())]
    href = next((h for rel in ICON_RELS for r, h in found if r == rel and h), "") or next((h for r, h in found if "icon" in r and h), "")
    return urljoin(base, href or "/favicon.ico")


# lists, labels, trails and menus


def labelled_pairs(tree: Tree) -> list[tuple[str, str]]:
    """(label, value) of the rows of tables, cell by cell, and of definition lists."""
    out = []
    for row in tree.by_tag.get("tr", ()):
        cells = [k for k in tree.children(row) if tree.tag[k] in ("th", "td")]
        heads = [n for n, k in enumerate(cells) if tree.tag[k] == "th"]
        starts = heads if heads and heads[-1] < len(cells) - 1 else [0] if len(cells) > 1 else []
        out += [(tree.text(cells[n]).rstrip(" :："), tree.text(cells[n + 1])) for n in starts if n + 1 < len(cells) and n + 1 not in heads]
    for place in tree.by_tag.get("dl", ()):
        kids = list(tree.children(place))
        terms, values = ([tree.text(k) for k in kids if tree.tag[k] == tag] for tag in ("dt", "dd"))
        out += [(a.rstrip(" :："), b) for a, b in zip(terms, values, strict=False)]
    return [(a, b) for a, b in out if a]


def in_menu(tree: Tree, node: int) -> bool:
    """Whether an anchor stands in a menu, header, footer or side bar."""
    return any(tree.tag[k] in MENU_TAGS or any(w in name for name in tree.named(k) for w in MENU_HINTS) for k in tree.ancestors(node))


def links(tree: Tree, base: str) -> list[tuple[str, str, bool]]:
    """(url, text, whether in a menu) of links to other pages, in order."""
    return [(urljoin(base, href), tree.text(k), in_menu(tree, k)) for k in tree.by_tag.get("a", ())
            if (href := tree.get(k, "href").strip()) and not href.lower().startswith(_NOT_LINKS)]


def posts(tree: Tree, base: str) -> list[tuple[str, str, str]]:
    """(url, title, day) of the entries of a list page: rows with a link outside of menus, and a day; a script's address is made out."""
    out: dict[str, tuple[str, str, str]] = {}
    for row in tree.within(0, ["tr", "li", "dl"]):
        if tree.within(row, ["tr", "li"]) and tree.tag[row] != "tr" or not (day := first_day(tree.text(row))):
            continue
        for k in tree.within(row, ["a"]):
            href, text = tree.get(k, "href").strip(), tree.get(k, "title").strip() or tree.text(k)
            if in_menu(tree, k) or not text or not href or href.lower().startswith(("mailto:", "tel:")) or extension(href):
                continue
            if href.startswith("#") or href.lower().startswith("javascript:"):
                continue
            try:
                url = urljoin(base, href)
            except ValueError:  # no address
                continue
            out.setdefault(url, (url, text, day))
            break
    return list(out.values())


def trail_steps(text: str) -> list[str]:
    """The steps of a trail that is written with marks between them."""
    return [x.strip() for x in re.split(r"\s*[>/\\|›»]\s*", " ".join(text.split())) if x.strip()]


def clean_steps(steps: list[str]) -> list[str]:
    """Steps without home pages, marks and repeats of the one before."""
    out: list[str] = []
    for step in (" ".join(s.split()) for s in steps):
        if step and step not in TRAIL_MARKS and step.lower().replace(" ", "") not in HOME_WORDS and step != (out or [""])[-1]:
            out.append(step)
    return out


def trail(tree: Tree) -> list[str]:
    """The steps of the first trail of a page that has two; else those of its title, without the office in front.

    Entries of a list give their own links and labels, not those of lists inside them.
    """
    def labels(item: int) -> list[str]:
        return [t for k in tree.children(item) if tree.tag[k] in LABEL_TAGS and (t := tree.text(k))]

    for place in sorted({k for s in TRAIL_PLACES for k in tree.select(s)}):
        items = [k for k in tree.within(place, ["li"]) if not any(tree.tag[n] == "li" and n > place for n in tree.ancestors(k))]
        if len(items) == 1 and len(own := labels(items[0])) > 1:
            steps = own
        else:
            said = [(labels(k) or [tree.text(k)])[0] for k in items] or labels(place) or [tree.text(place)]
            steps = [x for text in said for x in trail_steps(text)]
        if len(found := clean_steps(steps)) > 1:
            return found
    steps = clean_steps(trail_steps(next((tree.text(k) for k in tree.by_tag.get("title", ())), "")))
    steps = steps[1:] if len(steps) > 1 and steps[0].endswith("청") else steps
    return steps if len(steps) > 1 else []


def category_of(steps: list[str]) -> str:
    """The category that a trail names: the step before its last, or the one before that if it only introduces."""
    if len(steps) < 2:
        return ""
    return steps[-3] if steps[-2].endswith(" 소개") and len(steps) > 2 else steps[-2]


def menu(tree: Tree, base: str) -> list[tuple[int, str, str]]:
    """(depth, label, url) of a page's menu, in order, from the first place that has one."""
    def own_links(item: int) -> list[int]:
        return [k for k in tree.within(item, ["a"]) if next(n for n in tree.ancestors(k) if tree.tag[n] == "li") == item]

    def walk(item: int, depth: int) -> Iterator[tuple[int, str, str]]:
        if depth > MENU_DEPTH:
            return
        found = [(text, href) for k in own_links(item) if (text := tree.text(k)) and not (href := tree.get(k, "href").strip()).lower().startswith(_NOT_LINKS) and href]
        if not found:
            return
        yield depth, found[0][0], urljoin(base, found[0][1])
        for inner in tree.within(item, ["li"]):
            if next(n for n in tree.ancestors(inner) if tree.tag[n] == "li") == item:
                yield from walk(inner, depth + 1)

    for place in sorted({k for s in MENU_PLACES for k in tree.select(s)}, key=lambda k: (tree.tag[k] not in ("header", "nav"), k)):
        tops = [k for k in tree.within(place, ["li"]) if not any(tree.tag[n] == "li" and n > place for n in tree.ancestors(k))]
        if rows := [row for top in tops for row in walk(top, 0)]:
            return rows
    return []


def menu_markdown(rows: list[tuple[int, str, str]]) -> str:
    """A menu as a nested list of links."""
    return "\n".join(f"{'  ' * depth}- [{label}]({url})" for depth, label, url in rows)
