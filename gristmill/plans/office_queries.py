"""Queries over office files, which Spark makes from the orders: workbooks and HWP 5 documents."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.registry import query
from gristmill.sources import hwp
from gristmill.sources.files import plain_texts
from gristmill.sources.sheets import sheet_rows, sheet_texts
from gristmill.sources.tables import spread, table

_STYLES = ('<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;$&quot;#,##0.00"/></numFmts>'
           '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')


def made_workbook(rows: list[tuple[int, float, float, str]]) -> bytes:
    """A workbook of (key, serial day, price, note) rows: a merged title, a head, an empty sheet and one of inline strings."""
    notes = list(dict.fromkeys(r[3] for r in rows if r[3]))
    lines = ['<row r="1"><c r="A1" t="inlineStr"><is><t>Orders</t></is></c><c r="B1"><v>99</v></c></row>', '<row r="2"/>',
             '<row r="3"><c r="A3" t="str"><v>Key</v></c><c r="B3" t="str"><v>Date</v></c><c r="C3" t="str"><v>Price</v></c><c r="D3" t="str"><v>Note</v></c></row>']
    for k, (key, day, price, note) in enumerate(rows, 4):
        last = f'<c r="D{k}" t="s"><v>{notes.index(note)}</v></c>' if note else f'<c r="D{k}" s="1"/>'
        lines.append(f'<row r="{k}"><c r="A{k}"><v>{key}</v></c><c r="B{k}" s="1"><v>{day!r}</v></c><c r="C{k}" s="2"><v>{price!r}</v></c>{last}</row>')
    sheets = [f'<worksheet><sheetData>{"".join(lines)}</sheetData><mergeCells count="1"><mergeCell ref="A1:C2"/></mergeCells></worksheet>',
              "<worksheet><sheetData/></worksheet>",
              f'<worksheet><sheetData><row><c t="inlineStr"><is><t>Codes</t></is></c><c t="b"><v>1</v></c></row><row><c><v>{len(rows)}</v></c></row></sheetData></worksheet>']
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        names = "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(["Orders", "Empty", "Codes"]))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(3)) + "</Relationships>")
        archive.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>{escape(n[:2])}</t></r><r><t>{escape(n[2:])}</t></r></si>" for n in notes) + "</sst>")
        archive.writestr("xl/styles.xml", _STYLES)
        for k, sheet in enumerate(sheets):
            archive.writestr(f"xl/worksheets/sheet{k}.xml", sheet)
    return out.getvalue()


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams by path, at most one folder deep; those below 4096 bytes in the mini stream."""
    def padded(data: bytes, size: int) -> bytes:
        return data + b"\0" * (-len(data) % size)

    fat: list[int] = []
    sectors: list[bytes] = []

    def put(data: bytes) -> int:
        """Appends sectors; the first of them."""
        data = padded(data, 512)
        n, start = len(data) // 512, len(fat)
        if not n:
            return 0xFFFFFFFE
        sectors.extend(data[k * 512:(k + 1) * 512] for k in range(n))
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        return start

    mini, mini_fat, places = b"", [], {}
    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = put(data)
        else:
            start, n = len(mini) // 64, -(-len(data) // 64)
            mini, places[name] = mini + padded(data, 64), start if n else 0xFFFFFFFE
            mini_fat.extend([*range(start + 1, start + n), 0xFFFFFFFE] if n else [])
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    names = ["Root Entry", *folders, *streams]

    def siblings(members: list[str]) -> dict[str, int]:
        """Each member's right sibling: a tree that leans to one side."""
        return {m: names.index(n) for m, n in zip(members, members[1:], strict=False)}

    tops = [*folders, *(n for n in streams if "/" not in n)]
    right = siblings(tops)
    for f in folders:
        right |= siblings([n for n in streams if n.startswith(f + "/")])
    mini_start, mini_table = put(mini), put(b"".join(struct.pack("<I", x) for x in mini_fat + [0xFFFFFFFF] * (-len(mini_fat) % 128)))
    entries = []
    for name in names:
        kind = 5 if name == "Root Entry" else 1 if name in folders else 2
        child = names.index(tops[0]) if kind == 5 and tops else names.index(next(n for n in streams if n.startswith(name + "/"))) if kind == 1 else 0xFFFFFFFF
        start, size = (mini_start, len(mini)) if kind == 5 else (0, 0) if kind == 1 else (places[name], len(streams[name]))
        said = name.rpartition("/")[2].encode("utf-16-le") + b"\0\0"
        entries.append(said.ljust(64, b"\0") + struct.pack("<HBB3I", len(said), kind, 1, 0xFFFFFFFF, right.get(name, 0xFFFFFFFF), child) + b"\0" * 36 + struct.pack("<III", start, size, 0))
    directory = put(padded(b"".join(entries), 512))
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    tables = list(range(len(fat), len(fat) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    fat += [0xFFFFFFFF] * (-len(fat) % 128)
    head = hwp.MAGIC + b"\0" * 16 + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6) + struct.pack(
        "<9I", 0, n_fat, directory, 0, 4096, mini_table, len(mini_fat) // 128 + 1 if mini_fat else 0, 0xFFFFFFFE, 0)
    head += b"".join(struct.pack("<I", x) for x in tables + [0xFFFFFFFF] * (109 - len(tables)))
    return head + b"".join(sectors) + b"".join(struct.pack("<I", x) for x in fat)


def made_hwp(paragraphs: list[str], compressed: bool, flags: int = 0) -> bytes:
    """An HWP 5 file of one section with a paragraph for each text; a column control stands before each, and records of another kind between."""
    control = struct.pack("<8H", 2, 0x6C64, 0x7365, 0, 0, 0, 0, 2)
    records = b""
    for text in paragraphs:
        body = control + text.replace("\t", "\t" + "\0" * 7).encode("utf-16-le") + struct.pack("<H", 13)  # a tab takes eight units
        size = len(body)
        records += struct.pack("<I", 66 | 22 << 20) + b"\x07" * 22
        records += struct.pack("<I", hwp.PARAGRAPH_TEXT | 1 << 10 | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + body
    if compressed:
        packer = zlib.compressobj(wbits=-15)
        records = packer.compress(records) + packer.flush()
    head = hwp.SIGNATURE.ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(compressed) | flags) + b"\0" * 216
    return compound_file({"FileHeader": head, "PrvText": "preview".encode("utf-16-le"), "BodyText/Section0": records})


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a workbook for each eight customers; a group of orders is as large at any scale."""
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")) + (F.unix_timestamp("o_orderdate") % 86_400) / 86_400.0
    rows = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 8).alias("g"), "o_orderkey", serial.alias("day"), "o_totalprice",
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise("").alias("note"))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("o_orderkey")
        return pd.DataFrame([(f"/files/{key[0]}.xlsx", made_workbook(list(own[["o_orderkey", "day", "o_totalprice", "note"]].itertuples(index=False, name=None))))], columns=["path", "content"])

    return spread(rows, "g").groupBy("g").applyInPandas(write, "path string, content binary")


_SHEETS = """
    o as (select o_custkey // 8 as g, *, row_number() over (partition by o_custkey // 8 order by o_orderkey) as r from orders),
    s as (select '/files/' || g || '.xlsx' as path, 0 as sheet_no, 'Orders' as sheet, (r + 1)::int as row_no, list_filter([o_orderkey::varchar, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
        '$' || o_totalprice::varchar, case when o_orderkey % 3 > 0 then o_orderpriority end], lambda x: x is not null) as cells from o
      union all select distinct '/files/' || g || '.xlsx', 0, 'Orders', 0, ['Orders'] from o union all select distinct '/files/' || g || '.xlsx', 0, 'Orders', 1, ['Key', 'Date', 'Price', 'Note'] from o
      union all select distinct '/files/' || g || '.xlsx', 2, 'Codes', 0, ['Codes', 'True'] from o union all select '/files/' || g || '.xlsx', 2, 'Codes', 1, [count(*)::varchar] from o group by g)"""


@query("workbook_rows", f"with {_SHEETS} select path, sheet_no, sheet, row_no, array_to_string(cells, ' | ') as cells from s")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all sheets of the workbooks."""
    return sheet_rows(_files(spark, sf_dir)).withColumn("cells", F.array_join("cells", " | "))


@query("workbook_chunks", f"""
    with {_SHEETS},
    d as (select path, sheet_no, sheet, (row_no - 2) // 30 + 1 as chunk, count(*) as n, string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) order by row_no) as body
      from s where row_no >= 2 group by all)
    select path, 0 as sheet_no, 'Orders' as sheet, chunk::int as chunk, chunk::int as chunk_no, n::int as n_rows, md5('### Sheet: Orders ###' || chr(10) || '| Orders |' || chr(10) ||
      '| Key | Date | Price | Note |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || body) as text_md5 from d
    union all select path, 2, 'Codes', 1, (select max(chunk) from d where d.path = s.path)::int + 1, 0, md5('### Sheet: Codes ###' || chr(10) || '| Codes | True |' || chr(10) || '| ' || cells[1] || ' |' ||
      chr(10) || '| --- | --- |') from s where sheet_no = 2 and row_no = 1""")
def workbook_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of the workbooks in chunks of thirty rows with their head."""
    return sheet_texts(sheet_rows(_files(spark, sf_dir))).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query("hwp_texts", """
    select '/files/' || o_orderkey || '.hwp' as path, case when o_orderkey % 7 = 3 then 'the file is encrypted' end as error,
      case when o_orderkey % 7 <> 3 then md5('주문 ' || o_orderkey || ' 😀' || chr(10) || repeat(o_orderpriority || ' ', (o_orderkey % 400)::int) || 'end') end as text_md5 from orders""")
def hwp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of HWP documents, one for each order: packed and plain, short and long, some with a password."""
    def made(keys: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([made_hwp([f"주문 {k} 😀", f"{w} " * (k % 400) + "end"], k % 2 == 0, 2 * (k % 7 == 3)) for k, w in zip(keys, words, strict=True)])

    write = F.pandas_udf(made, "binary")
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")  # few bytes make large files
    files = orders.select(F.concat(F.lit("/files/"), F.col("o_orderkey").cast("string"), F.lit(".hwp")).alias("path"),
                                                  write("o_orderkey", "o_orderpriority").alias("content"))
    return plain_texts(files).select("path", "error", F.md5("text").alias("text_md5"))
