"""Rows of spreadsheets: workbooks (sheets, shared strings, numbers, dates, merged cells) and delimited text."""

from __future__ import annotations

import csv
import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.operators.components import cut_lineage
from gristmill.sources.files import decoded

#: Number formats that a workbook doesn't spell out and that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Signs of money, in the order in which a format is asked for them.
MONEY = "$₩¥€"
DELIMITERS = [",", ";", "\t", "|"]
HEAD_ROWS, CHUNK_ROWS = 2, 30
ROWS = "path string, sheet_no int, sheet string, row_no int, cells array<string>"

_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _is_date_format(code: str) -> bool:
    """Whether a number format shows a day or time: a letter of one outside of quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.I)
    return bool(re.search("[dmyhs]", bare, re.I)) and "general" not in bare.lower()


def _moment(value: float, from_1904: bool) -> str:
    """A serial day number as text: a time below one, else a day with its time."""
    if 0 <= value < 1 and not from_1904:
        return str((dt.datetime(1900, 1, 1) + dt.timedelta(seconds=round(value * 86_400))).time())
    day = value + (0 < value < 60 and not from_1904)  # the calendar of 1900 has a 29 February there
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    return str(start + dt.timedelta(seconds=round(day * 86_400)))


def _formats(archive: zipfile.ZipFile) -> list[tuple[bool, str]]:
    """(is a date, sign of money) of each cell style."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    codes = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _local(e) == "numFmt"}
    out = []
    for group in root:
        if _local(group) == "cellXfs":
            for style in group:
                k = int(style.get("numFmtId") or 0)
                code = codes.get(k, "")
                out.append((k in DATE_FORMATS if k not in codes else _is_date_format(code), next((s for s in MONEY if s in code), "")))
    return out


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for part in item if _local(part) in ("t", "r") for t in ([part] if _local(part) == "t" else part) if _local(t) == "t") for item in root]


class Merged:
    """The ranges of cells that are merged: all but the first cell of each hold nothing. Rows are asked for in order."""

    def __init__(self, raw: bytes) -> None:
        self.waiting: list[tuple[int, int, int, int]] = []
        for ref in re.findall(rb'<(?:\w+:)?mergeCell\b[^>]*\bref="([A-Z0-9:$]+)"', raw):
            ends = [_CELL.match(x) for x in ref.decode().replace("$", "").split(":")]
            if len(ends) == 2 and all(ends):
                (a, b), (c, d) = ((int(m[2]), _column(m[1])) for m in ends)
                self.waiting.append((a, b, c, d))
        self.waiting.sort(reverse=True)
        self.open: list[tuple[int, int, int, int]] = []

    def hides(self, row: int, column: int) -> bool:
        while self.waiting and self.waiting[-1][0] <= row:
            self.open.append(self.waiting.pop())
        if any(r[2] < row for r in self.open):
            self.open = [r for r in self.open if r[2] >= row]
        return any(b <= column <= d and (a, b) != (row, column) for a, b, _, d in self.open)


def workbook(data: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, name, row number, cells) of the rows of an XLSX file that have a value.

    Cells are the values that are there, in order, as text: shared and inline
    strings, whole and other numbers, money with its sign, days and times by
    their format, True and False; what merged cells hide is left out, blanks are too.
    Numbers of sheets count all, numbers of rows those given.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        from_1904 = any(_local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        relations = {e.get("Id"): e.get("Target") or "" for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        shared, formats = _shared(archive), _formats(archive)

        def value(cell: ElementTree.Element) -> str:
            kind = cell.get("t") or "n"
            if kind == "inlineStr":
                return "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
            text = next((e.text or "" for e in cell if _local(e) == "v"), "")
            if kind == "s":
                return shared[int(text)] if text else ""
            if kind == "b":
                return {"0": "False", "1": "True"}.get(text, text)
            if kind != "n" or not text:
                return text
            number = float(text) if re.search("[.eE]", text) else int(text)
            style = int(cell.get("s") or 0)
            is_date, sign = formats[style] if style < len(formats) else (False, "")
            return _moment(number, from_1904) if is_date else f"{sign}{number}"

        sheets = [e for e in book.iter() if _local(e) == "sheet"]
        for sheet_no, sheet in enumerate(sheets):
            target = relations.get(next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id" and "}" in k), ""), "")
            name = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            if "worksheet" not in name:
                continue  # a sheet that is a chart has no rows
            raw, row_no = archive.read(name), 0
            merged, place, line = Merged(raw), (0, 0), []
            for _, element in ElementTree.iterparse(io.BytesIO(raw)):
                if _local(element) == "c":
                    m = _CELL.match(element.get("r") or "")
                    place = (int(m[2]), _column(m[1])) if m else (place[0], place[1] + 1)
                    if not merged.hides(*place) and (text := value(element).strip()):
                        line.append(text)
                elif _local(element) == "row":
                    if line:
                        yield sheet_no, sheet.get("name") or "", row_no, line
                        row_no += 1
                    place, line = (place[0] + 1, 0), []
                    element.clear()


def delimited(data: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """The rows of delimited text as ``workbook`` gives them; the delimiter is the first that parts the first line with a value."""
    text = decoded(data)[0]
    for delimiter in DELIMITERS:
        rows = ([c.strip() for c in row if c.strip()] for row in csv.reader(io.StringIO(text), delimiter=delimiter))
        if len(next((r for r in rows if r), [])) > 1:
            break
    else:
        delimiter = DELIMITERS[0]
    rows = ([c.strip() for c in row if c.strip()] for row in csv.reader(io.StringIO(text), delimiter=delimiter))
    yield from ((0, "csv", k, row) for k, row in enumerate(r for r in rows if r))


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of ``files`` (path, content), as ``spark.read.format("binaryFile")`` gives them.

    XLSX and CSV by the ending of the path; a file that can't be read has one row
    with sheet_no -1, and what is wrong with it as its sheet. Null contents have no rows.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []  # rows of many files are given out together
            for path, data in zip(batch["path"], batch["content"], strict=True):
                kind = str(path).rpartition(".")[2].lower()
                try:
                    rows = iter(()) if data is None else workbook(data) if kind == "xlsx" else delimited(data) if kind == "csv" else None
                    if rows is None:
                        raise ValueError(f"no reader for {kind}")
                    for row in rows:
                        held.append((path, *row))
                        if len(held) >= 10_000:
                            yield pd.DataFrame(held, columns=["path", "sheet_no", "sheet", "row_no", "cells"])
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, csv.Error) as e:
                    held.append((path, -1, str(e)[:200], 0, []))
            yield pd.DataFrame(held, columns=["path", "sheet_no", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(read, ROWS)


def sheet_texts(rows: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, chunk, chunk_no, n_rows, text): sheets in chunks of thirty rows below their two head rows, as Markdown tables.

    ``chunk`` counts in a sheet from 1, ``chunk_no`` in a file. A sheet of no more than its head is one chunk.
    """
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    # heads, bodies and numbers are asked of the same rows, which are read from their files once
    given = cut_lineage(rows.where("sheet_no >= 0").select("path", "sheet_no", "sheet", "row_no", line.alias("line"), F.size("cells").alias("width")))
    of_sheet = ["path", "sheet_no", "sheet"]
    heads = given.where(F.col("row_no") < HEAD_ROWS).groupBy(*of_sheet).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("head"), F.max("width").alias("width"))
    ruled = heads.select(*of_sheet, F.concat(F.lit("### Sheet: "), "sheet", F.lit(" ###\n"), "head", F.lit("\n| "), F.array_join(
        F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |")).alias("head"))
    number = F.floor((F.col("row_no") - HEAD_ROWS) / CHUNK_ROWS).cast("int") + 1
    bodies = given.where(F.col("row_no") >= HEAD_ROWS).groupBy(*of_sheet, number.alias("chunk")).agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"), F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("b"))
    chunks = ruled.join(bodies, of_sheet, "left").select(
        *of_sheet, F.coalesce("chunk", F.lit(1)).alias("chunk"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.concat_ws("\n", "head", F.array_join(F.transform("b", lambda r: r["line"]), "\n")).alias("text"))
    # a file's sheets are few, so numbers in a file come from one row for each sheet
    sheets = chunks.groupBy("path", "sheet_no").agg(F.max("chunk").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("sheet_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sheets.select("path", "sheet_no", before.alias("_before"))
    return chunks.join(starts, ["path", "sheet_no"]).select(*of_sheet, "chunk", (F.col("_before") + F.col("chunk")).cast("int").alias("chunk_no"), "n_rows", "text")
