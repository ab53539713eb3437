"""Download addresses in the calls of scripts.

A call is cut into its name and arguments by a small tokenizer (quotes, escapes,
nested brackets); which address a call means is a template by the name of its
function. What no template knows falls back to quoted strings that look like files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

# Functions of download scripts with the address of each. {0} is the first argument, percent-encoded;
# {0:raw} as it stands, {2:path} with its slashes kept.
TEMPLATES = {
    "downloadfile": (1, "{0:raw}"),
    "fn_egov_downfile": (2, "/cmm/fms/FileDown.do?atchFileId={0:raw}&fileSn={1:raw}"),
    "cfbrctfiledownload": (2, "/nsbms/comn/fileMng/fileDownload.do?bizDvCd={0}&fileNo=0&fileSeq={1}"),
    "cfcomnfiledownload": (3, "/nsbms/comn/fileMng/fileDownload.do?bizDvCd={0}&fileNo={1}&fileSeq={2}"),
    "filedownnow": (3, "https://eminwon.gm.go.kr/emwp/jsp/ofr/FileDownNew.jsp?user_file_nm={1}&sys_file_nm={0}&file_path={2:path}"),
    "godownload": (3, "/emwp/jsp/ofr/FileDownNew.jsp?user_file_nm={0}&sys_file_nm={1}&file_path={2:path}"),
}
#: File ids and numbers that a call names, for the one form whose last argument may be a board.
FILE_ID = re.compile(r"FILE_[A-Za-z0-9_-]+\Z")
FILE_FUNCTIONS = {"filedown", "fnfiledown", "downloadfile"}
#: The parts of one argument of ``downItem``, and where they go.
ITEM_FIELDS = ["fileSize", "orgfilename", "fileName", "filePath"]
FILE_HINTS = ["filedown", "filedownload", "downloadbbsfile", "download", "attach", "atchfile", "atchmnflno", "atchfileid", "fileid"]
EXTENSIONS = ["hwpx", "hwp", "xlsx", "xls", "pptx", "ppt", "docx", "doc", "pdf", "csv", "txt", "zip", "rar", "7z", "jpg", "jpeg", "png", "gif", "bmp",
              "webp", "tif", "tiff"]

_NAME = re.compile(r"[A-Za-z_$][\w$.]*\s*\(")
_LOCATION = re.compile(r"(?:window\.)?location(?:\.href)?\s*=\s*(['\"])(.+?)\1", re.I)
_FILE_END = re.compile(rf"\.(?:{'|'.join(EXTENSIONS)})(?:$|[?#&])", re.I)
_ABSOLUTE = re.compile(r"(?i)https?://")


def arguments(text: str, at: int) -> tuple[list[str | None], int]:
    """(arguments, end) of a call whose bracket opens before ``at``: quoted strings without quotes and escapes, others as they stand; nested calls are None."""
    out: list[str | None] = []
    held: list[str] = []
    quoted, nested, depth = False, False, 0

    def close() -> None:
        word = "".join(held) if quoted else "".join(held).strip()
        if word or quoted or nested:
            out.append(None if nested else word)
        held.clear()

    while at < len(text):
        c = text[at]
        if c in "'\"`":
            end = at + 1
            piece = []
            while end < len(text) and text[end] != c:
                end += text[end] == "\\" and end + 1 < len(text)
                piece.append(text[end])
                end += 1
            if depth == 0:
                held[:] = ["".join(held).strip(), *piece] if quoted else piece
                quoted = True
            at = end + 1
            continue
        if c in "([{":
            depth, nested = depth + 1, True
        elif c in ")]}":
            if depth == 0:
                close()
                return out, at + 1
            depth -= 1
        elif c == "," and depth == 0:
            close()
            quoted = nested = False
        elif depth == 0 and not (quoted and (c.isspace() or c in "+;")):
            held.append(c)
        at += 1
    close()
    return out, at


def calls(text: str) -> Iterator[tuple[str, list[str | None]]]:
    """(name, arguments) of each call of a script, inner ones too, in order."""
    for m in _NAME.finditer(text):
        yield m[0][:-1].strip().rpartition(".")[2].lower(), arguments(text, m.end())[0]


def _encoded(url: str) -> str:
    """A URL with what isn't ASCII percent-encoded."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def _joined(base: str, path: str) -> str:
    return urljoin(base, path) if base else path


def _filled(template: str, given: list[str]) -> str:
    def put(m: re.Match) -> str:
        value, kind = given[int(m[1])].strip(), m[2]
        return value if kind == ":raw" else quote(value, safe="/") if kind == ":path" else quote(value, safe="")

    return re.sub(r"\{(\d)(:\w+)?\}", put, template)


def looks_like_file(path: str) -> bool:
    """Whether a string may be the address of a file: it has a known ending, or is a path with a word of downloads."""
    low = path.lower()
    starts = bool(_ABSOLUTE.match(path)) or path.startswith(("/", "./", "../"))
    return bool(_FILE_END.search(low)) or starts and any(x in low for x in FILE_HINTS)


def script_download(script: str | None, base: str = "") -> str:
    """The address that a link or click handler downloads; empty if it downloads none.

    Addresses and paths stay (paths need a base), ``location = '...'`` gives its
    file, then the first call with a template, then the first quoted string that
    looks like a file. Null and blank scripts give none.
    """
    text = (script or "").strip()
    if _ABSOLUTE.match(text):
        return _encoded(text)
    if base and text.startswith(("/", "./", "../")):
        return _encoded(_joined(base, text))
    if (m := _LOCATION.search(text)) and looks_like_file(m[2].strip()):
        return _encoded(_joined(base, m[2].strip()))
    found = list(calls(text))
    if not text.lower().startswith("javascript:") and not any(name in TEMPLATES or name in FILE_FUNCTIONS or name == "downitem" for name, _ in found):
        return ""
    for name, given in found:
        words = [x for x in given if x is not None]
        if name in FILE_FUNCTIONS and len(words) > 1 and FILE_ID.match(words[0]) and words[1].isdigit():
            query = {"atchFileId": words[0], "fileSn": words[1]} | ({"bbsId": words[2].strip()} if len(words) > 2 and words[2].strip() else {})
            return _joined(base, "/common/cmm/fms/FileDown.do?" + urlencode(query))
        if name in TEMPLATES and len(words) >= (needed := TEMPLATES[name][0]) and all(x.strip() for x in words[:needed]):
            if name == "downloadfile":
                return _encoded(_joined(base, words[0].strip())) if looks_like_file(words[0].strip()) else ""
            return _joined(base, _filled(TEMPLATES[name][1], words))
        if name == "downitem" and words:
            parts = [x.strip() for x in words[0].split("^")]
            if len(parts) >= len(ITEM_FIELDS) and all(parts[1:4]):
                query = {"fileGubun": "BBS", "gubun": "BBS"} | dict(zip(ITEM_FIELDS, parts, strict=False)) | {"type": ""}
                return _joined(base, "/fileDownload.do?" + urlencode(query))
    for _, given in found or [("", [m[1] for m in re.finditer(r"['\"]([^'\"]{1,500})['\"]", text)])]:
        for word in given:
            if word and looks_like_file(word.strip()):
                return _encoded(_joined(base, word.strip()))
    return ""


def parameters(url: str) -> dict[str, str]:
    """The first value of each parameter of a URL, by its name in lower case."""
    out: dict[str, str] = {}
    for name, value in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        out.setdefault(name.lower(), value)
    return out
