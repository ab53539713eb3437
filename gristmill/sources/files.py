"""Plain text from files read as binary, in batches."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gristmill.sources.hwp import MAGIC, hwp_text

#: Encodings that a text file may be in, in the order in which equals are decided.
ENCODINGS = ["utf-8-sig", "utf-8", "cp949", "euc-kr", "utf-16", "utf-16-le", "utf-16-be", "latin-1"]
#: Where the text of an office file is: members of the archive and the tag that ends a line.
OFFICE = {
    "pptx": (r"ppt/slides/slide[0-9]+\.xml$", "p"),
    "xlsx": (r"xl/sharedStrings\.xml$", "si"),
    "hwpx": (r"Contents/section[0-9]+\.xml$", "p"),
    "odt": (r"content\.xml$", "p"),
}

_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]+")


def badness(text: str) -> int:
    """How wrong a decoding looks: replacement characters, controls and zero bytes."""
    controls = sum(map(len, _CONTROLS.findall(text)))
    return 10 * text.count("�") + controls + 50 * text.count("\0")


def decoded(data: bytes) -> tuple[str, str]:
    """(text, encoding) of the decoding that looks best."""
    best = None
    for name in ENCODINGS:
        found = badness(text := data.decode(name, "replace"))
        if best is None or found < best[0]:
            best = found, text, name
        if not found:  # none that follows can be better
            break
    return best[1:]


def office_text(data: bytes, kind: str) -> str:
    """Text of a zipped XML file, a line for each paragraph."""
    members, line = OFFICE[kind]
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if re.search(members, n)]
        for name in sorted(names, key=lambda n: [int(x) for x in re.findall("[0-9]+", n)] or [0]):
            for element in ElementTree.fromstring(archive.read(name)).iter():
                if element.tag.rpartition("}")[2] == line and (text := "".join(element.itertext()).strip()):
                    out.append(text)
    return "\n".join(out)


def markdown_table(rows: list[list[str]]) -> str:
    """A table as Markdown, its first row as head; short rows are filled up."""
    width = max(map(len, rows), default=0)
    filled = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in filled]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if width else ""


def document_text(data: bytes) -> str:
    """Text of a DOCX file: paragraphs as lines, tables as Markdown."""
    name = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    body = next((e for e in root.iter() if name(e) == "body"), root)
    out: list[str] = []
    for element in body:
        if name(element) == "tbl":
            out.append(markdown_table([["".join(c.itertext()).strip() for c in r if name(c) == "tc"] for r in element if name(r) == "tr"]))
        elif text := "".join(element.itertext()).strip():
            out.append(text)
    return "\n".join(out)


def created_date(data: bytes) -> str | None:
    """The creation time that an office file carries."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            found = re.search(rb"<dcterms:created[^>]*>([^<]+)<", archive.read("docProps/core.xml"))
            return found[1].decode() if found else None
    except (zipfile.BadZipFile, KeyError):
        return None


def plain_text(name: str, data: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, created, error) of a file by its extension."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "docx":
            return document_text(data), created_date(data), None
        if kind in OFFICE:
            return office_text(data, kind), created_date(data), None
        if kind == "hwp" and data[:8] == MAGIC:
            return hwp_text(data), None, None
        if kind == "hwp" and data[:2] == b"PK":  # a newer file with the older ending
            return office_text(data, "hwpx"), created_date(data), None
        if kind in ("txt", "csv", "md", "log", "html", "htm", "json", "xml"):
            return decoded(data)[0], None, None
        return None, None, f"no reader for {kind}"
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, struct.error) as e:
        return None, None, str(e)[:200]


#: Bytes of contents whose texts are given out together, and files at most.
AT_ONCE_BYTES, AT_ONCE = 1 << 24, 1000


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch: up to ``AT_ONCE`` files that have ``AT_ONCE_BYTES`` together, or one larger file."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > AT_ONCE_BYTES or k - start >= AT_ONCE):
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def plain_texts(files: DataFrame) -> DataFrame:
    """(path, size, text, created, error) of ``files`` (path, content); null contents have no text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column(0), batch.column(1)
            sizes = [n or 0 for n in pc.binary_length(contents).to_pylist()]
            for start, end in _parts(sizes):  # only a part of a batch is held as Python's values
                own = paths[start:end].to_pylist()
                found = [plain_text(p, d) if d is not None else (None, None, None) for p, d in zip(own, contents[start:end].to_pylist(), strict=True)]
                text, created, error = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([paths[start:end], pa.array(sizes[start:end], pa.int64()), *(pa.array(c, pa.string()) for c in (text, created, error))],
                                                 ["path", "size", "text", "created", "error"])

    return files.select("path", "content").mapInArrow(read, "path string, size long, text string, created string, error string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``plain_texts`` of the files that ``path`` names."""
    return plain_texts(spark.read.format("binaryFile").load(path))
