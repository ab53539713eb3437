"""URL functions as column expressions.

There are three canonical forms and they are not the same: the crawl key lowers
everything and drops volatile parameters, the dedup key keeps the case of paths
and values, and ``normalized_url`` keeps the first of repeated parameters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import as_column, contains_any, let
from gristmill.functions.punycode import ascii_host

# Query keys that don't identify a page.
CRAWL_PAGE_KEYS = [
    "pageindex", "pageno", "pgno", "page", "curpage", "currpage", "q_currpage", "page_no", "page_index", "pagenum",
    "pageunit", "pagesize", "recordcountperpage", "row", "rows", "searchcnd", "searchwrd", "searchcategory",
    "searchctg", "searchctgry", "searchctgory", "start", "offset",
]
TRACKING_KEYS = ["fbclid", "gclid", "msclkid", "igshid", "ysclid", "_ga", "_gl", "mc_cid", "mc_eid"]
CRAWL_VOLATILE_KEYS = [
    "session", "sessionid", "sid", "phpsessid", "jsessionid", "_csrf", "cachebust", "cachebuster", "cb", "csrf",
    "device", "from", "ref", "referrer", "returnurl", "return_url", "sessionkey", "timestamp", "token",
    "access_token", "refresh_token", "tracking", "trackingid", "browser", "resolution", "screen", "screensize",
    "viewport", "ts", "userid",
]
DEDUP_VOLATILE_KEYS = [
    "session", "sessionid", "sid", "phpsessid", "jsessionid", "_csrf", "csrf", "token", "access_token", "refresh_token",
]
DEDUP_PAGE_KEYS = [
    "buffer", "bacategory", "bacategory1", "bacategory2", "bacategory3", "currentpage", "currpage", "cp", "page",
    "pageindex", "pageno", "pagenum", "pg", "offset", "start", "startrow", "startindex", "limit", "row", "rows",
    "rowperpage", "pageunit", "pagesize", "recordcountperpage", "optionalyn", "searchdata", "searchtext",
    "searchkeyword", "searchcondition", "searchtype", "searchorder", "searchstate", "sort", "order", "orderby",
    "sortorder", "viewtype", "view", "p", "search", "query", "keyword",
]
PRIMARY_KEYS = [
    "nttid", "bbsid", "articleid", "boardid", "searchlctrekey", "seq", "idx", "id", "num", "no", "ntt_no", "nttno",
    "postid", "docid", "progrmsn",
]
# Pages of one article, whose parameters name it whatever else a URL carries.
DETAIL_NAMES = {"bd_selectbbs.do": "BD_selectBbs.do", "bd_selectbeffatinfoothbcbbs.do": "BD_selectBbs.do",
                "bd_selectnftcbbsdetail.do": "BD_selectNftcBbsDetail.do", "selectboarddetail.do": "selectBoardDetail.do"}
BOARD_DETAIL_KEYS = ["q_bbscode", "q_bbscttsn"]
NOTICE_DETAIL_KEYS = ["q_nftcbbscode", "q_nftcbbsmgtno"]
ARTICLE_KEYS = ["bbsid", "nttid"]
CONTEXT_KEYS = ["deptid", "key", "menu", "menuid", "menuno", "mnno"]
MORE_IDENTITY_KEYS = ["bbscode", "bbscttsn", "bbsmgtno", "mgtno", "nftcbbscode", "nftcbbsmgtno"]
IDENTITY_ENDINGS = ["id", "no", "num", "seq", "sn", "mgtno", "code"]
DETAIL_ENDINGS = [".do", ".jsp", ".php", ".asp", ".aspx"]
DETAIL_WORDS = ["detail", "view", "article", "bbs", "board", "read", "select"]
ARTICLE_PLACES = ["/bbs/", "/board/", "/cop/bbs/"]
ARTICLE_PAGES = ["view.do", "selectboardarticle.do", "selectboarddetail.do", "selectnoticearticle.do", "selectnoticedetail.do"]
# Path and word hints.
LIST_PATHS = ["list.do", "alllist.do", "eventlist.do", "list.asp", "list.jsp", "list.php", "list.html", "deptgdc.do",
              "selectbbsnttlist.do"]
DETAIL_PATHS = ["view.do", "read.do", "detail.do", "/view/", "/view?", "/detail/", "/read/", "/post/detail", "board_view",
                "board_read", "board_detail", "read.asp", "read.php", "read.jsp", "openbrlviewer"]
BOARD_HINTS = ["board", "bbs", "notice", "ntt", "list", "view", "article", "portal", "news", "announcement", "gosi", "gonggo"]
# Endings of URLs that name a file, by kind.
DOWNLOAD_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "svg", "ico", "raw", "cr2", "nef", "arw",
    "mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v", "3gp", "ogv", "mts", "m2ts", "ts", "vob", "asf", "rm", "rmvb",
    "mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff", "au", "mid", "midi",
    "pdf", "hwp", "hwpx", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "rtf", "csv", "odt", "ods", "odp",
    "psd", "ai", "eps", "indd", "sketch", "fig", "xd", "cdr", "dwg", "dxf", "blend", "max", "3ds", "obj", "fbx", "dae",
    "zip", "rar", "7z", "tar", "gz", "bz2", "lzma", "xz", "ace", "arj", "cab", "iso", "dmg", "pkg",
    "exe", "msi", "deb", "rpm", "apk", "app", "bat", "cmd", "com", "scr", "vbs", "js", "jar", "war",
    "swf", "fla", "f4v", "f4p", "f4a", "f4b", "shockwave", "quicktime", "realmedia",
    "db", "sqlite", "mdb", "accdb", "dbf", "odb", "sql",
    "bak", "backup", "old", "tmp", "temp", "log", "cache",
    "ini", "cfg", "conf", "config", "xml", "json", "yaml", "yml", "toml",
    "c", "cpp", "h", "java", "py", "scss", "less", "pl", "rb", "go", "rs", "swift", "kt", "jsx", "tsx", "vue", "svelte",
]
DOWNLOAD_WORDS = ["download", "attachment", "file", "/uploads/", "/media/", "/assets/", "/static/"]
MULTI_LABEL_SUFFIXES = ["co.kr", "go.kr", "or.kr", "ac.kr", "re.kr", "ne.kr", "pe.kr", "co.uk", "co.jp"]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(url), _PARTS, 1))


def host(url: Column | str) -> Column:
    """Host with port, in lower case."""
    return F.lower(F.regexp_extract(as_column(url), _PARTS, 2))


def path(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), _PARTS, 3)


def query(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), _PARTS, 4)


def bare_host(url: Column | str) -> Column:
    """Host in ASCII, without ``www.`` and default ports."""
    named = F.regexp_replace(ascii_host(host(url)), r"^www\.", "")
    return F.when(scheme(url) == "http", F.regexp_replace(named, ":80$", "")).otherwise(F.regexp_replace(named, ":443$", ""))


def absolute(url: Column | str) -> Column:
    """With a scheme; '' for blanks, scripts, mail addresses and fragments; session ids in the path dropped."""
    text = F.trim(F.coalesce(as_column(url), F.lit("")))
    full = (F.when(text.startswith("//"), F.concat(F.lit("https:"), text))
            .when(text.rlike("(?i)^https?://"), text)
            .otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", ""))))
    return F.when((text == "") | text.rlike("^(javascript:|mailto:|#)"), F.lit("")).otherwise(
        F.regexp_replace(full, "(?i);jsessionid=[^/?#]+", ""))


def _decoded(text: Column, plus_is_space: bool) -> Column:
    safe = text if plus_is_space else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def _encoded(text: Column, slash: bool, space: str) -> Column:
    """Percent-encoding of all but letters, digits and ``_.-~``, and slashes where they are safe."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    out = F.replace(out, F.lit("+"), F.lit(space))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if slash else out


def resolved_path(text: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments, with one leading slash and none at the end."""
    segments = F.filter(F.split(text, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def query_pairs(url: Column | str, lower_values: bool = False) -> Column:
    """array<struct<key, value>> of parameters with a value; keys in lower case, both decoded and trimmed."""
    def pair(item: Column) -> Column:
        value = F.trim(_decoded(F.regexp_extract(item, "(?s)=(.*)", 1), True))
        return F.struct(F.lower(F.trim(_decoded(F.substring_index(item, "=", 1), True))).alias("key"),
                        (F.lower(value) if lower_values else value).alias("value"))
    items = F.filter(F.split(query(url), "&"), lambda x: x.contains("="))
    return F.filter(F.transform(items, pair), lambda p: (p["key"] != "") & (p["value"] != ""))


def joined_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(
        _encoded(p["key"], False, "+"), F.lit("="), _encoded(p["value"], False, "+"))), "&")


def _assembled(url: Column, path_text: Column, pairs: Column) -> Column:
    q = let(joined_pairs(pairs), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(scheme(url), F.lit("://"), bare_host(url), path_text, q)


def canonical_crawl_url(url: Column | str) -> Column:
    """Key of a page for a crawl: lower case, resolved path, lasting parameters in order, no fragment."""
    drop = [*CRAWL_PAGE_KEYS, *TRACKING_KEYS, *CRAWL_VOLATILE_KEYS]

    def key(full: Column) -> Column:
        place = _encoded(resolved_path(F.lower(_decoded(path(full), False))), True, "%20")
        pairs = F.filter(query_pairs(full, lower_values=True), lambda p: ~p["key"].startswith("utm_") & ~p["key"].isin(drop))
        return F.when(full == "", "").otherwise(F.regexp_replace(_assembled(full, place, F.array_sort(pairs)), "/+$", ""))

    return let(absolute(url), key)


def _in_one(key: Column, lists: list[str]) -> Column:
    """Whether a parameter's name is listed, with or without ``q_`` in front."""
    return key.isin(lists) | F.regexp_replace(key, "^q_(?=.)", "").isin(lists)


def is_identity_key(key: Column) -> Column:
    """Whether a parameter names an article: a primary key, or an ending like ``no``; menus, pages and sessions don't."""
    plain = F.regexp_replace(key, "^q_(?=.)", "")
    none = _in_one(key, [*CONTEXT_KEYS, *DEDUP_PAGE_KEYS, *TRACKING_KEYS, *DEDUP_VOLATILE_KEYS])
    return (key != "") & ~none & (_in_one(key, PRIMARY_KEYS) | plain.isin(MORE_IDENTITY_KEYS) | plain.rlike(f"({'|'.join(IDENTITY_ENDINGS)})$"))


def _discarded_key(key: Column) -> Column:
    """Whether a parameter never tells documents apart: tracking, sessions, pages and searches."""
    plain = F.regexp_replace(key, "^q_(?=.)", "")
    return (plain.startswith("utm_") | _in_one(key, [*DEDUP_PAGE_KEYS, *TRACKING_KEYS, *DEDUP_VOLATILE_KEYS])
            | ((key.startswith("search") | plain.startswith("search")) & ~is_identity_key(key)))


def identity(url: Column | str) -> Column:
    """struct<stable, suffix, place, pairs> of a full URL: what tells its document from others.

    ``pairs`` are the parameters that count, each once, in their order; ``place``
    is the decoded path, or one name for pages that show the same article by
    different paths; ``stable`` says that some parameters alone name the article.
    """
    full = as_column(url)

    def listed(keys: list[str]) -> Column:
        return F.array(*map(F.lit, keys))

    def read(parts: Column) -> Column:
        """What the parameters' names say, each worked out once."""
        place = parts["place"]
        given = F.array_distinct(F.transform(parts["pairs"], lambda p: p["key"]))
        suffix = F.element_at(F.split(F.regexp_replace(place, "/+$", ""), "/"), -1)
        classes = F.transform(given, lambda k: F.struct(k.alias("key"), is_identity_key(k).alias("names"), _discarded_key(k).alias("dropped")))
        return F.struct(place.alias("place"), parts["pairs"].alias("pairs"), given.alias("given"), suffix.alias("suffix"), classes.alias("keys"))

    def judged(x: Column) -> Column:
        """Which parameters alone name the article, if any do."""
        place, suffix, given = x["place"], x["suffix"], x["given"]
        has = lambda keys: F.size(F.array_intersect(given, listed(keys))) == len(keys)
        named = suffix.isin(list(DETAIL_NAMES))
        shaped = named | (suffix.rlike(f"({'|'.join(e.replace('.', '[.]') for e in DETAIL_ENDINGS)})$") & contains_any(place, DETAIL_WORDS))
        naming = F.transform(F.filter(x["keys"], lambda k: k["names"]), lambda k: k["key"])
        own = F.when(shaped & (F.size(naming) >= 2) & F.forall(x["keys"], lambda k: k["names"] | k["dropped"]), naming).otherwise(F.array().cast("array<string>"))
        board = F.array_contains(given, "nttid") & contains_any(place, ARTICLE_PLACES) & suffix.isin(ARTICLE_PAGES)
        return F.struct(own.alias("own"), named.alias("named"), board.alias("board"), has(BOARD_DETAIL_KEYS).alias("by_board"), has(NOTICE_DETAIL_KEYS).alias("by_notice"),
                        ((suffix == "selectboarddetail.do") & has(ARTICLE_KEYS)).alias("by_article"), x["suffix"].alias("suffix"), x["pairs"].alias("pairs"),
                        F.transform(F.filter(x["keys"], lambda k: k["dropped"]), lambda k: k["key"]).alias("dropped"))

    def made(x: Column) -> Column:
        stable = (x["named"] & (x["by_board"] | x["by_notice"])) | x["by_article"] | (F.size(x["own"]) > 0)
        allowed = (F.when(x["suffix"] == "selectboarddetail.do", listed(ARTICLE_KEYS)).when(x["by_notice"], listed(NOTICE_DETAIL_KEYS))
                   .when(F.size(x["own"]) > 0, x["own"]).otherwise(listed(BOARD_DETAIL_KEYS)))
        name = F.coalesce(*[F.when(x["suffix"] == k, F.lit(v)) for k, v in DETAIL_NAMES.items()])
        place = F.when(stable & x["named"], F.concat(F.lit("/__bbs_detail__/"), name)).otherwise(resolved_path(_decoded(path(full), False)))
        kept = let(F.struct(stable.alias("s"), allowed.alias("a")), lambda y: F.filter(x["pairs"], lambda p: ~F.array_contains(x["dropped"], p["key"]) & (
            ~y["s"] | F.array_contains(y["a"], p["key"])) & (~x["board"] | p["key"].isin(ARTICLE_KEYS))))
        return F.struct(stable.alias("stable"), x["suffix"].alias("suffix"), place.alias("place"), F.array_distinct(kept).alias("pairs"))

    parts = F.struct(F.lower(F.trim(path(full))).alias("place"), query_pairs(full).alias("pairs"))
    return let(parts, lambda p: let(read(p), lambda x: let(judged(x), made)))


def _canonical(full: Column, x: Column) -> Column:
    return _assembled(full, _encoded(x["place"], True, "%20"), F.array_sort(x["pairs"]))


def canonical_dedup_url(url: Column | str) -> Column:
    """Key of a document: path and value case kept, parameters that count in order, each once; see ``identity``."""
    return let(absolute(url), lambda full: F.when(full == "", "").otherwise(let(identity(full), lambda x: _canonical(full, x))))


def without_scheme(key: Column | str) -> Column:
    """A key that http and https share."""
    return F.regexp_replace(as_column(key), "^https?://", "")


def normalized_url(url: Column | str) -> Column:
    """Host in lower case, no fragment, the first of parameters that repeat a key, in their order."""
    full = absolute(url)
    items = F.filter(F.split(query(full), "&"), lambda x: x != "")
    first = F.aggregate(items, F.array().cast("array<string>"), lambda done, x: F.when(
        F.exists(done, lambda y: F.substring_index(y, "=", 1) == F.substring_index(x, "=", 1)), done).otherwise(F.array_append(done, x)))
    q = F.array_join(F.filter(first, lambda x: ~x.startswith("buffer=")), "&")
    return F.when(full == "", "").otherwise(F.concat(
        scheme(full), F.lit("://"), host(full), path(full), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def structure_key(url: Column | str) -> Column:
    """What pages of one kind share: numeric path segments as {num}, parameter names only."""
    return let(canonical_crawl_url(url), structure_of)


def structure_of(key: Column) -> Column:
    """The structure of a crawl key."""
    place = F.array_join(F.transform(F.filter(F.split(path(key), "/"), lambda s: s != ""),
                                     lambda s: F.when(s.rlike("^[0-9]+$"), "{num}").otherwise(s)), "/")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(query_pairs(key), lambda p: p["key"]))), "&")
    made = F.concat(scheme(key), F.lit("://"), host(key), F.lit("/"), place, F.when(names != "", F.concat(F.lit("?"), names)).otherwise(""))
    return F.when(key == "", "").otherwise(F.regexp_replace(made, "/+$", ""))


def segment_template(segment: Column) -> Column:
    """:var for numbers, 8 or more hexadecimal digits, or 16 or more with dashes."""
    low = F.lower(F.trim(segment))
    return F.when(low.rlike(r"^(\d+|[0-9a-f]{8,}|[0-9a-f-]{16,})$"), ":var").otherwise(low)


def path_template(url: Column | str) -> Column:
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, segment_template), "/"))


def stable_query(url: Column | str, drop: Iterable[str] = tuple(CRAWL_PAGE_KEYS + PRIMARY_KEYS)) -> Column:
    """Parameters that name a board rather than an article or page: sorted, distinct, short values."""
    pairs = F.filter(query_pairs(url), lambda p: ~p["key"].isin(list(drop)) & (F.length(p["value"]) <= 40))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pairs)), lambda p: F.concat_ws("=", p["key"], p["value"])), "&")


def pattern_signature(url: Column | str) -> Column:
    return F.concat_ws("|", host(url), path_template(url), stable_query(url))


def top_domain(name: Column) -> Column:
    """The registrable part of a host by a short list of two-label suffixes."""
    labels = F.filter(F.split(F.lower(F.trim(name)), r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return (F.when(F.size(labels) <= 2, F.array_join(labels, "."))
            .when(last(2).isin(MULTI_LABEL_SUFFIXES), last(3)).otherwise(last(2)))


def board_score(url: Column | str, anchor: Column | None = None) -> Column:
    """How much a link looks like one to a board: 2 for each hint, 3 for a list, 1 for a view."""
    low = F.lower(F.concat_ws(" ", as_column(url), anchor if anchor is not None else F.lit("")))
    score = F.lit(0)
    for hint in BOARD_HINTS:
        score = score + F.when(low.contains(hint), 2).otherwise(0)
    score = score + F.when(contains_any(low, ["list.do", "list.jsp", "list.asp", "board"]), 3).otherwise(0)
    return score + F.when(contains_any(low, ["view.do", "nttno=", "nttid=", "wr_id="]), 1).otherwise(0)


def in_scope(url: Column | str, scope_host: str, prefix: str = "/") -> Column:
    """Whether a URL lies under a host (with or without ``www.``, http or https) and path prefix."""
    plain = scope_host.lower().removeprefix("www.")
    same = F.regexp_replace(host(url), r"^www\.", "") == plain
    rest = F.regexp_replace(as_column(url), r"(?i)^https?://[^/?#]*", "")
    if prefix in ("", "/"):
        return scheme(url).isin("http", "https") & same & ((rest == "") | rest.startswith("/"))
    return scheme(url).isin("http", "https") & same & rest.startswith(prefix)


def scope_prefix(url: Column | str) -> Column:
    """First path segment as a scope; ``/`` where it is missing or looks like a file."""
    first = F.element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), 1)
    single = F.size(F.filter(F.split(path(url), "/"), lambda s: s != "")) == 1
    return F.when(first.isNull() | (single & first.contains(".")), "/").otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def directory(url: Column | str) -> Column:
    """Path up to the last slash."""
    return F.regexp_extract(F.when(path(url) == "", "/").otherwise(path(url)), r"^(.*/)", 1)


def extension(name: Column | str) -> Column:
    """Lower-case extension of the last path part, without the dot; '' if there is none."""
    last = F.element_at(F.split(F.regexp_replace(as_column(name), r"[?#].*$", ""), "/"), -1)
    return F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1))


def is_downloadable(url: Column | str) -> Column:
    """A file by its extension or by words of its URL."""
    low = F.lower(as_column(url))
    return low.rlike(rf"\.({'|'.join(DOWNLOAD_EXTENSIONS)})$") | contains_any(low, DOWNLOAD_WORDS)


def suggests_article(url: Column | str) -> Column:
    """A parameter that names one article: a primary key, or a positive number under a key that isn't a page number."""
    return F.exists(query_pairs(url), lambda p: p["key"].isin(PRIMARY_KEYS) | (
        p["value"].rlike("^0*[1-9][0-9]*$") & ~p["key"].isin([*DEDUP_PAGE_KEYS, *CRAWL_PAGE_KEYS])))


def is_list_page(url: Column | str) -> Column:
    low = F.lower(path(url))
    shaped = contains_any(low, LIST_PATHS) | low.rlike(r"/(?:board|notice|bbs)(?:/[^/?#]+)*/?$")
    return shaped & ~suggests_article(url)


def is_detail_page(url: Column | str) -> Column:
    keyed = F.exists(query_pairs(url), lambda p: p["key"].isin(PRIMARY_KEYS))
    return ~is_list_page(url) & (contains_any(F.lower(as_column(url)), DETAIL_PATHS) | keyed)


def passes_query_filter(url: Column | str, mode: str) -> Column:
    """Q keeps URLs with a query, P those without; anything else keeps all."""
    has = query(url) != ""
    return has if mode == "Q" else ~has if mode == "P" else F.lit(True)


def _tokens(full: Column, x: Column) -> Column:
    last = F.element_at(F.filter(F.split(F.lower(x["place"]), "/"), lambda s: s != ""), -1)
    pairs = F.transform(x["pairs"], lambda p: F.concat_ws("=", p["key"], p["value"]))
    parts = F.array_distinct(F.concat(F.array(F.regexp_replace(host(full), r"^www\.", ""), F.coalesce(last, F.lit(""))), pairs))
    return F.array_join(F.array_sort(F.filter(parts, lambda t: t != "")), "|")


def tokens(url: Column | str) -> Column:
    """Sorted tokens of a URL: bare host, last path part in lower case, and the parameters that count, joined by ``|``."""
    return let(absolute(url), lambda full: F.when(full == "", "").otherwise(let(identity(full), lambda x: _tokens(full, x))))


def dedup_keys(url: Column | str) -> Column:
    """Keys of which any shared one means the same document: canonical, tokens, the article of a board, and primary parameters with and without host."""
    def made(full: Column) -> Column:
        def keys(x: Column) -> Column:
            bare = F.regexp_replace(host(full), r"^www\.", "")
            value = lambda k: F.get(F.filter(x["pairs"], lambda p: p["key"] == k), F.lit(0))["value"]
            by = F.when(x["suffix"] == "selectboarddetail.do", F.concat(F.lit("bbsid="), value("bbsid"), F.lit("|nttid="), value("nttid"))).otherwise(
                F.concat(F.lit("q_bbscode="), value("q_bbscode"), F.lit("|q_bbscttsn="), value("q_bbscttsn")))
            article = F.when(x["stable"], F.concat(bare, F.lit("|bbs_detail|"), by))
            named = let(F.transform(F.filter(query_pairs(full), lambda p: p["key"].isin(PRIMARY_KEYS)), lambda p: F.concat_ws("=", p["key"], p["value"])),
                        lambda plain: let(bare, lambda b: F.concat(plain, F.transform(plain, lambda k: F.concat_ws("|", b, k)))))
            return F.concat(F.array(_canonical(full, x), _tokens(full, x), article), named)

        return F.when(full == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(
            let(identity(full), keys), lambda k: k.isNotNull() & (k != ""))))

    return let(absolute(url), made)


def candidate_terms(url: Column | str) -> Column:
    """Parts of a URL, in order and lower case, that the URLs of the same document are likely to hold: parameters, and the path where these don't name it."""
    def made(full: Column) -> Column:
        def terms(x: Column) -> Column:
            named = F.filter(F.transform(x["pairs"], lambda p: F.lower(F.concat_ws("=", p["key"], p["value"]))), lambda t: F.length(t) >= 4)
            place = F.lower(F.trim(path(full)))
            around = F.filter(F.array(place, x["suffix"]), lambda t: F.length(t) >= 3)
            return F.array_distinct(F.when(x["stable"], named).otherwise(F.concat(around, named)))

        return F.when(full == "", F.array().cast("array<string>")).otherwise(let(identity(full), terms))

    return let(absolute(url), made)


# Names of pages of posts and of lists, and parameters of boards and of posts.
BOARD_PATHS = [(f"{name}.{end}", f"list.{end}") for end in ("do", "asp", "php", "jsp") for name in ("view", "detail", "read")]
BOARD_PARAMETERS = ["menuno", "menu_no", "menu_cd", "bbsid", "bbs_id", "boardno", "board_no"]
POST_PARAMETERS = ["nttid", "ntt_id", "num", "id", "seq", "no", "articleno", "article_no"]
CAMPAIGN_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]


def parent_board(url: Column | str) -> Column:
    """The list that a post's URL leads to: list for view in its path, in lower case, with the parameters of the board; null if that is the URL itself."""
    text = as_column(url)
    low = F.lower(path(text))
    place = F.coalesce(*[F.when(low.contains(old), F.replace(low, F.lit(old), F.lit(new))) for old, new in BOARD_PATHS], low)
    items = F.filter(F.split(query(text), "&"), lambda x: x.rlike("^[^=]+=."))
    names = F.array_distinct(F.transform(items, lambda x: F.substring_index(x, "=", 1)))

    def kept(x: Column) -> Column:
        name = F.lower(F.substring_index(x, "=", 1))
        return ~name.isin(POST_PARAMETERS) & (contains_any(name, BOARD_PARAMETERS) | (F.size(names) == 1))

    pairs = F.transform(F.filter(items, kept), lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("="), _encoded(_decoded(F.regexp_extract(x, "(?s)=(.*)", 1), True), False, "+")))
    q = let(F.array_join(pairs, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return let(F.concat(scheme(text), F.lit("://"), host(text), place, q), lambda board: F.when((board != text) & (scheme(text) != ""), board))


def sitemap_query(text: Column) -> Column:
    """A query without campaigns, its parameters sorted; blank values stay."""
    def pair(item: Column) -> Column:
        return F.struct(_decoded(F.substring_index(item, "=", 1), True).alias("key"), _decoded(F.regexp_extract(item, "(?s)=(.*)", 1), True).alias("value"))

    pairs = F.filter(F.transform(F.filter(F.split(text, "&"), lambda x: x != ""), pair), lambda p: ~p["key"].isin(CAMPAIGN_KEYS))
    return joined_pairs(F.array_sort(pairs))


def of_domain(url: Column | str, domain: str) -> Column:
    """Whether a URL's host is a domain or lies below it."""
    plain = domain.strip().lower()
    return (host(url) == plain) | host(url).endswith(f".{plain}")
