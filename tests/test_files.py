from __future__ import annotations

import io
import struct
import zipfile

import pytest

from gristmill.plans.office_queries import compound_file, made_hwp, made_workbook
from gristmill.sources import hwp
from gristmill.sources import sheets as S
from gristmill.sources.files import plain_text, plain_texts


def book(sheet: str, styles: str = "", extra: str = "", shared: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="http://x/r">{extra}<sheets><sheet name="A" r:id="r1"/><sheet name="Chart" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/s.xml"/><Relationship Id="r2" Target="chartsheets/c.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet>{sheet}</worksheet>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet>{styles}</styleSheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst>{shared}</sst>")
    return out.getvalue()


def rows(data: bytes) -> list[list[str]]:
    return [r[3] for r in S.workbook(data)]


STYLES = ('<numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="&quot;day&quot; 0"/><numFmt numFmtId="172" formatCode="₩#,##0"/></numFmts>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs>')


@pytest.mark.parametrize(("cells", "found"), [
    ('<c r="A1"><v>1</v></c><c r="B1"><v>1.0</v></c><c r="C1"><v>1e3</v></c>', ["1", "1.0", "1000.0"]),
    ('<c r="A1" t="b"><v>0</v></c><c r="B1" t="e"><v>#N/A</v></c><c r="C1" t="str"><v> x </v></c>', ["False", "#N/A", "x"]),
    ('<c r="A1" s="1"><v>45292</v></c><c r="B1" s="1"><v>45292.5</v></c><c r="C1" s="1"><v>59</v></c><c r="D1" s="1"><v>61</v></c>',
     ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00"]),
    ('<c r="A1" s="2"><v>0.75</v></c><c r="B1" s="3"><v>7</v></c><c r="C1" s="4"><v>500</v></c><c r="D1" s="99"><v>5</v></c>', ["18:00:00", "7", "₩500", "5"]),
    ('<c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"/>', ["two parts", "one"]),
    ('<c><v>1</v></c><c/><c><v>3</v></c>', ["1", "3"])])
def test_cells(cells, found):
    shared = "<si><t>one</t><rPh><t>skipped</t></rPh></si><si><r><t>two </t></r><r><t>parts</t></r></si>"
    assert rows(book(f'<sheetData><row r="1">{cells}</row></sheetData>', STYLES, shared=shared)) == [found]


def test_merged_cells_and_dates_from_1904():
    cell = lambda r: f'<c r="{r}"><v>{r[1:]}{ord(r[0]) - 64}</v></c>'
    data = "".join(f'<row r="{r}">{"".join(cell(f"{c}{r}") for c in "ABC")}</row>' for r in range(1, 5))
    merged = '<mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="$C$3:$XFD$1048576"/></mergeCells>'
    assert rows(book(f"<sheetData>{data}</sheetData>{merged}")) == [["11", "13"], ["23"], ["31", "32", "33"], ["41", "42"]]
    one = '<sheetData><row><c s="1"><v>1</v></c></row></sheetData>'
    assert rows(book(one, STYLES, '<workbookPr date1904="1"/>')) == [["1904-01-02 00:00:00"]]


def test_delimited():
    assert [r[3] for r in S.delimited(b'\n"a;1";b\n;;\nc; d ;\n')] == [["a;1", "b"], ["c", "d"]]
    assert [r[3] for r in S.delimited("이름,값\n가,\"x\ny\"".encode("cp949"))] == [["이름", "값"], ["가", "x\ny"]]
    assert list(S.delimited(b"")) == [] and [r[3] for r in S.delimited(b"alone")] == [["alone"]]


def test_sheet_rows_and_texts(spark):
    data = made_workbook([(k, 45292.0, 1.5, "n") for k in range(61)])
    files = spark.createDataFrame([("a.xlsx", data), ("b.csv", b"h1,h2\n"), ("c.xlsx", b"PK broken"), ("d.ods", b"x"), ("e.csv", None)], "path string, content binary")
    found = S.sheet_rows(files)
    bad = {r["path"]: r["sheet"] for r in found.where("sheet_no < 0").collect()}
    assert set(bad) == {"c.xlsx", "d.ods"} and bad["d.ods"] == "no reader for ods"
    texts = sorted((r["path"], r["sheet_no"], r["chunk"], r["chunk_no"], r["n_rows"], r["text"].count("\n")) for r in S.sheet_texts(found).collect())
    assert texts == [("a.xlsx", 0, 1, 1, 30, 33), ("a.xlsx", 0, 2, 2, 30, 33), ("a.xlsx", 0, 3, 3, 1, 4), ("a.xlsx", 2, 1, 4, 0, 3), ("b.csv", 0, 1, 1, 0, 2)]


def test_hwp():
    long = "가" * 3000 + " " + "b" * 9000
    for packed in (True, False):
        assert hwp.hwp_text(made_hwp(["첫째\t줄", "", long, "끝"], packed)) == f"첫째\t줄\n{long}\n끝"
    assert hwp.hwp_text(made_hwp([], True)) == "preview"
    assert plain_text("x.hwp", made_hwp(["t"], True, 2)) == (None, None, "the file is encrypted")
    assert plain_text("x.hwp", compound_file({"Other": b"x" * 5000}))[2] == "not an HWP 5 file"
    units = struct.pack("<20H", ord("a"), 11, *[0x6162] * 7, ord("b"), 10, ord("c"), 4, *[0] * 7)
    assert hwp.paragraph(units) == "ab\nc"


def test_compound_file():
    streams = {"Big": bytes(range(256)) * 300, "Small": b"abc", "None": b"", "F/One": b"1" * 64, "F/Two": b"2" * 4096, "G/S": b"s"}
    file = hwp.CompoundFile(compound_file(streams))
    assert {n: file.read(n) for n in file.streams} == streams
    whole = compound_file(streams)
    for wrong in (b"", whole[:700], whole[:-600], whole[:48] + b"\xff\x00\x00\x00" + whole[52:]):
        assert plain_text("x.hwp", hwp.MAGIC[:0] + wrong)[0] is None


def test_other_files(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", "<s><p><t>one</t></p><p><t>two</t></p></s>")
    files = spark.createDataFrame([("a.hwp", out.getvalue()), ("b.txt", "글".encode("euc-kr")), ("c.pdf", b"%PDF"), ("d.txt", None)], "path string, content binary")
    found = {r["path"]: (r["size"] > 0, r["text"], r["error"]) for r in plain_texts(files).collect()}
    assert found == {"a.hwp": (True, "one\ntwo", None), "b.txt": (True, "글", None), "c.pdf": (True, None, "no reader for pdf"), "d.txt": (False, None, None)}


def test_texts_of_a_batch_are_read_in_parts():
    from gristmill.sources import files

    assert list(files._parts([1, 2, 3])) == [(0, 3)] and list(files._parts([])) == []
    assert list(files._parts([files.AT_ONCE_BYTES, 1, files.AT_ONCE_BYTES + 5, 2])) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert list(files._parts([0] * (files.AT_ONCE + 1))) == [(0, files.AT_ONCE), (files.AT_ONCE, files.AT_ONCE + 1)]


def test_dear_rows_are_spread(spark, sf_dir):
    from gristmill.plans.decision_queries import metadata_timestamps
    from gristmill.plans.office_queries import _files
    from gristmill.plans.url_queries import order_urls

    for found in (_files(spark, sf_dir), order_urls(spark, sf_dir), metadata_timestamps(spark, sf_dir)):
        assert found.rdd.getNumPartitions() >= 4  # each table is one file
