"""Names and URLs of attached files, and boards that they hang on, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import urls as U
from gristmill.functions.columns import as_column, contains_any, let
from gristmill.functions.script_calls import script_download

# File kinds and query keys.
DOCUMENTS = ["hwp", "hwpx", "pdf", "doc", "docx", "ppt", "pptx", "txt", "csv", "xlsx", "xls"]
ARCHIVES = ["zip", "rar", "7z"]
IMAGES = ["jpg", "jpeg", "png", "gif", "bmp"]
DESIGN_TYPES = ["illustrator", "postscript", "photoshop", "indesign"]
NAVIGATION_KEYS = ["menumo", "menu_no", "menuno", "menucd", "menu_cd", "lmenu_cd", "lmenumcd", "topmenu", "submenu", "tabid",
                   "tab_id", "link", "mid", "m_id", "pageunit", "pagesize", "recordcountperpage", "pageroffset", "searchword",
                   "searchwrd", "search_ctg", "searchdctg"]
FIRST_SEGMENTS = ["portal", "health", "main", "web", "site"]
FILE_PATHS = ["filedown", "/fms/", "/cmm/", "/cmmn/", "/file", "download", "attach"]
MENU_KEYS = ["menuno", "menu_no", "menu", "menu_cd", "ctgrycd", "ctgry_cd", "categorycd", "category_cd"]
BOARD_KEYS = ["bbsid", "bbs_id", "bbscd", "bbs_cd", "boardid", "board_id"]
PLACEHOLDERS = ["error", "err", "404", "500", "403", "502", "503", "badrequest", "notfound", "navigationmenu", "navmenu"]

_SIZE_LABEL = r"(?i)\s*[\[(]?\s*[0-9]+(?:[.,][0-9]+)?\s*(?:bytes?|[kmgt]?b|[kmgt]bytes?)\s*[\])]?\s*$"


def without_size_label(name: Column | str) -> Column:
    """A file name without a size at its end, like ``[29.0 KB]``."""
    return F.trim(F.regexp_replace(F.trim(as_column(name)), _SIZE_LABEL, ""))


def without_sizes(name: Column | str) -> Column:
    """A file name without sizes at its end and before its ending, however many there are."""
    once = lambda c: F.trim(F.regexp_replace(F.trim(c), _SIZE_LABEL, ""))

    def step(text: Column) -> Column:
        def kept(parts: Column) -> Column:
            return F.when((parts["stem"] != "") & (parts["kept"] != "") & (parts["kept"] != parts["stem"]), F.concat(parts["kept"], parts["end"])).otherwise(text)

        stem, end = (F.regexp_extract(text, r"(?s)^(.+)(\.[^./\\]*)$", k) for k in (1, 2))
        return let(F.struct(stem.alias("stem"), end.alias("end"), once(stem).alias("kept")), kept)

    text = as_column(name)
    for _ in range(3):  # labels in a row, before and after the ending
        text = let(once(text), step)
    return text


def safe_name(name: Column | str) -> Column:
    """A name that any file system takes: letters, digits, spaces and ``._-`` only; ``downloaded_file`` if nothing is left."""
    kept = F.trim(F.regexp_replace(without_sizes(F.coalesce(as_column(name), F.lit(""))), r"[^\p{L}\p{Nd} ._-]", ""))
    return let(kept, lambda x: F.when(x == "", "downloaded_file").otherwise(x))


def name_within(name: Column | str, limit: int) -> Column:
    """A name of at most ``limit`` UTF-8 bytes that keeps its ending if that fits."""
    def cut(part: Column, most: Column) -> Column:
        def longest(short: Column) -> Column:
            fits = F.filter(F.sequence(F.lit(0), F.length(short)), lambda n: F.octet_length(F.substring(short, F.lit(1), n)) <= most)
            return F.substring(short, F.lit(1), F.array_max(fits))

        return let(F.substring(part, 1, limit), longest)

    def made(text: Column) -> Column:
        def ended(end: Column) -> Column:
            stem = F.substring(text, F.lit(1), F.length(text) - F.length(end))
            room = F.lit(limit) - F.octet_length(end)
            return F.when(room <= 0, cut(text, F.lit(limit))).otherwise(F.concat(cut(stem, room), end))

        return F.when(F.octet_length(text) <= limit, text).otherwise(let(F.regexp_extract(text, r"(?s)^.+(\.[^.]*)$", 1), ended))

    return let(as_column(name), made)


def known_extension(name: Column | str) -> Column:
    """The first known extension that ends a token of a name, else what follows the last dot."""
    text = without_size_label(name)
    known = "|".join(sorted([*DOCUMENTS, *ARCHIVES, *IMAGES], key=len, reverse=True))
    first = F.regexp_extract(text, rf"(?i)\.({known})(?=$|[\s\])}},;:])", 1)
    return F.lower(F.when(first != "", first).otherwise(F.regexp_extract(text, r"\.([^./\\]*)$", 1)))


def is_blocked(name: Column | str, content_type: Column | str) -> Column:
    """Whether a file is surely no document, by its name or content type."""
    kind, media = known_extension(name), F.lower(F.coalesce(as_column(content_type), F.lit("")))
    return (((kind != "") & ~kind.isin(DOCUMENTS)) | media.rlike("^(image|video|audio)/")
            | contains_any(media, ["application/zip", "application/x-zip", "application/x-7z", *DESIGN_TYPES]))


def file_identity(name: Column | str, size: Column | str, hwpx_as_hwp: bool = False) -> Column:
    """struct<stem, ext, size> by which files count as the same; a missing size is -1."""
    text = as_column(name)
    ext = F.lower(F.regexp_extract(text, r"\.([^./\\]+)$", 1))
    stem = F.lower(F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\.[^./\\]+$", ""))
    return F.struct(F.when(stem == "", "file").otherwise(stem).alias("stem"),
                    (F.when(ext == "hwpx", "hwp").otherwise(ext) if hwpx_as_hwp else ext).alias("ext"),
                    F.coalesce(as_column(size).cast("long"), F.lit(-1)).alias("size"))


def attachment_key(url: Column | str) -> Column:
    """Key of an attachment: without navigation parameters and portal segments; file ids keep only themselves."""
    def value(kept: Column, name: str) -> Column:
        return F.get(F.filter(kept, _named(name)), F.lit(0))["value"]

    def made(key: Column) -> Column:
        segments = F.filter(F.split(U.path(key), "/"), lambda s: s != "")
        cut = contains_any(F.lower(U.path(key)), FILE_PATHS) & F.coalesce(F.lower(F.get(segments, F.lit(0))).isin(FIRST_SEGMENTS), F.lit(False))
        place = F.concat(F.lit("/"), F.array_join(F.when(cut, F.slice(segments, 2, 1000)).otherwise(segments), "/"))
        origin = F.concat(U.scheme(key), F.lit("://"), U.host(key))

        def whole(kept: Column) -> Column:
            by_id = F.concat(origin, F.lit("/cmm/fms/FileDown.do?atchFileId="), value(kept, "atchfileid"), F.lit("&fileSn="), value(kept, "filesn"))
            q = let(U.joined_pairs(kept), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
            return F.coalesce(by_id, F.concat(origin, place, q))

        kept = F.filter(U.query_pairs(key), lambda p: ~p["key"].isin(NAVIGATION_KEYS))
        return F.when(key == "", "").otherwise(let(kept, whole))

    return let(U.canonical_dedup_url(url), made)


def parameter(url: Column | str, names: list[str]) -> Column:
    """The value of the first of some parameters that a URL has, or null."""
    return let(U.query_pairs(url), lambda pairs: F.coalesce(*[F.get(F.filter(pairs, _named(name)), F.lit(0))["value"] for name in names]))


def _named(name: str):
    return lambda p: p["key"] == name


def board_id(url: Column | str) -> Column:
    """The board's name in a path like ``/bbs/<id>/``, or null."""
    found = F.regexp_extract(U.path(url), "(?i)/bbs/([^/]+)/", 1)
    return F.when(found != "", found)


def same_board(base: Column, candidate: Column) -> Column:
    """Whether a URL belongs to the board of a base URL: same host, then board parameter, board path or menu number."""
    bare = lambda u: F.regexp_replace(U.host(u), r"^www\.", "")
    board, menu = board_id(base), parameter(base, MENU_KEYS)
    by_parameter, by_path, by_menu = parameter(candidate, BOARD_KEYS), board_id(candidate), parameter(candidate, MENU_KEYS)
    scoped = (F.when(board.isNull(), True).when(by_parameter.isNotNull(), F.lower(by_parameter) == F.lower(board))
              .when(by_path.isNotNull(), F.lower(by_path) == F.lower(board))
              .when(menu.isNotNull() & by_menu.isNotNull(), menu == by_menu).otherwise(False))
    return (bare(base) == bare(candidate)) & scoped


def is_placeholder_title(title: Column | str) -> Column:
    """Blank titles, error codes and the names of menus."""
    low = F.lower(F.trim(F.coalesce(as_column(title), F.lit(""))))
    flat = F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")
    return (low == "") | flat.isin(PLACEHOLDERS) | contains_any(low, ["error_title", "server error", "runtime error"])


def ocr_failure(text: Column | str) -> Column:
    """Why a text is the message of a failed OCR call, or null."""
    low = F.lower(F.coalesce(as_column(text), F.lit("")))
    code = F.regexp_extract(low, r"(?<![0-9])(4[0-9][0-9]|5[0-9][0-9])(?![0-9])", 1)
    return F.when(low.contains("ocr"), F.when(code != "", F.concat(F.lit("ocr_status_"), code)).when(low.contains("ocr api"), "ocr_api_failed")
                  .when(contains_any(low, ["failed", "error", "exception"]), "ocr_failed"))


def wiki_page_kind(url: Column | str) -> Column:
    """edit, resource or page: wiki actions and raw files aren't pages."""
    q = F.lower(U.query(url))
    return F.when(q.rlike(r"(^|&)(action|do)=(edit|history|raw|diff|delete)|(^|&)oldid="), "edit").when(
        F.lower(U.path(url)).rlike(r"/(load|opensearch)[^/]*\.php$|/(resources|skins)/"), "resource").otherwise("page")


def script_download_of(script: Column | str, base: Column | str) -> Column:
    """The address that a script downloads, against the URL of its page; empty if none. See ``script_calls.script_download``."""
    @F.pandas_udf("string")
    def found(scripts: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([script_download(x, y or "") for x, y in zip(scripts, bases, strict=True)], dtype="object")

    return found(as_column(script), as_column(base))


def page_url(url: Column, number: Column) -> Column:
    """A list URL with another page number, put in where it has none."""
    name = F.regexp_extract(U.query(url), r"(?i)(?:^|&)(page|pageindex|pageno|currpage|cp)=", 1)
    return F.when(name != "", F.regexp_replace(url, F.concat(F.lit("([?&]"), name, F.lit("=)[^&#]*")), F.concat(F.lit("$1"), number.cast("string")))).otherwise(
        F.concat(F.regexp_replace(url, "#.*$", ""), F.when(url.contains("?"), "&").otherwise("?"), F.lit("page="), number.cast("string")))


def smoothed(previous: Column, target: Column, fraction: float = 0.25, least: int = 1, most: int = 50) -> Column:
    """The next shown value on the way to a target: a part of what is left, within bounds."""
    left = target - previous
    step = F.least(F.greatest(F.lit(least), (left * fraction).cast("int")), F.lit(most), left)
    return F.when(left <= 0, target).otherwise(previous + step)
