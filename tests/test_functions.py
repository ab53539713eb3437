from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.functions import chunks as C
from gristmill.functions import dates as D
from gristmill.functions import texts as X
from gristmill.functions import urls as U
from gristmill.functions.columns import is_blank, select_existing, where_if_present
from gristmill.operators import duplicates as O
from gristmill.operators import history as Y
from gristmill.operators import merges as M
from gristmill.operators.rules import categorized
from gristmill.sources import files, tables


def values(spark, make, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_crawl_keys(spark):
    assert values(spark, U.canonical_crawl_url, "http://WWW.a.kr:80/x//y/?utm_source=q&b=2&a=1#f", "//host/p", "javascript:void(0)", "mailto:x", "  ",
                  "https://a.kr/p;jsessionid=1?x=", "a.kr/A/../B/%41", None, "https://a.kr/?page=2") == [
        "http://a.kr/x/y?a=1&b=2", "https://host/p", "", "", "", "https://a.kr/p", "https://a.kr/b/a", "", "https://a.kr"]


def test_dedup_keys_keep_case(spark):
    assert values(spark, U.canonical_dedup_url, "https://a.kr/Path/?B=Val&B=Val&searchText=x&sort=1&id=7", "http://a.kr") == [
        "https://a.kr/Path?b=Val&id=7", "http://a.kr/"]


def test_structure_and_classes(spark):
    assert values(spark, U.structure_key, "https://a.kr/bbs/12/34?z=1&id=2", "") == ["https://a.kr/bbs/{num}/{num}?id&z", ""]
    assert values(spark, U.is_list_page, "https://a.kr/list.do", "https://a.kr/list.do?nttId=3", "https://a.kr/notice/") == [True, False, True]
    assert values(spark, U.is_detail_page, "https://a.kr/view.do?nttId=3", "https://a.kr/x?nttId=3", "https://a.kr/x") == [True, True, False]
    assert values(spark, U.normalized_url, "https://A.kr/x?a=1&a=2&b=3#t") == ["https://a.kr/x?a=1&b=3"]
    assert values(spark, lambda c: U.top_domain(U.host(c)), "https://x.y.go.kr/", "https://a.b.com", "https://b.com") == ["y.go.kr", "b.com", "b.com"]
    assert values(spark, U.extension, "https://a.kr/b/c.PDF?x=1", "https://a.kr/b") == ["pdf", ""]


def test_texts(spark):
    assert values(spark, X.without_emoji, "a\U0001F600b") == ["ab"]
    assert values(spark, X.without_controls, "a\x01\tb\x0bc") == ["a\tbc"]
    assert values(spark, X.mask_rrn, "id 900101-1234567.", "1900101-1234567", "900101–1234567", None) == ["id [RRN_MASKED].", "1900101-1234567", "[RRN_MASKED]", ""]
    assert values(spark, X.looks_like_markdown, "# a", "a\n| b |\n| c |", "- a\n- b\n- c", "- a", "") == [True, True, True, False, False]
    assert values(spark, X.is_failure, "save failed", "success after error", "", None, "hello") == [True, False, True, True, False]
    assert values(spark, lambda c: X.trimmed_to_bytes(c, 5), "éééé", "abcdef") == ["éé", "abcde"]
    assert values(spark, X.snippet, "a " * 200)[0].endswith("a...")


def test_dates(spark):
    day = lambda *a: dt.datetime(*a)
    assert values(spark, D.parse_date, "20240101", "2024.1.5", "24-1-5", "2024년 3월 4일", "20249999", "2024-01-05 10:11:12", "x", None) == [
        day(2024, 1, 1), day(2024, 1, 5), day(2024, 1, 5), day(2024, 3, 4), None, day(2024, 1, 5, 10, 11, 12), None, None]
    now = F.to_timestamp(F.lit("2024-06-01"))
    assert values(spark, lambda c: D.latest_date(c, now), "from 2023-01-02 to 2024.5.6, due 2024-12-31", "no") == [dt.date(2024, 5, 6), None]


def test_chunks(spark):
    sizes = [0, 999, 1000, 1001, 1950, 1951]
    cut = values(spark, C.fixed_chunks, *["x" * n for n in sizes])
    assert [len(c) for c in cut] == [0, 1, 1, 2, 2, 3]
    text = "".join(chr(97 + k % 26) for k in range(5000))
    parts = values(spark, C.fixed_chunks, text)[0]
    assert parts[0] + "".join(p[50:] for p in parts[1:]) == text
    assert C.semantic_chunks("# A\n\npara one\n\n# B\n\npara two") == ["# A\n\npara one", "# B\n\npara two"]
    assert C.semantic_chunks("") == []
    long = C.semantic_chunks("# H\n\n" + "y" * 2500)
    assert all(c.startswith("# H") for c in long) and len(long) >= 3
    assert C.segment_chunks(["a" * 600, "b" * 600, "c" * 600]) == [" ".join([x * 600 for x in "abc"])]


def test_duplicates_and_history(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, "a")], "id int, k string")
    assert [tuple(r) for r in O.duplicate_groups(df, "k", "id").collect()] == [("a", 3, 1, [2, 6])]
    assert sorted(r["id"] for r in O.duplicate_rows(df, "k", "id").collect()) == [2, 6]
    known = spark.createDataFrame([("b",)], "k string")
    assert sorted(r["id"] for r in O.unknown_starts(df, known, "k", "id").collect()) == [1, 4, 5]
    blocks = spark.createDataFrame([(["long block", "block", "a long block here", "tiny", "other text"],)], "b array<string>")
    assert blocks.select(O.contained_blocks_dropped(F.col("b"))).first()[0] == ["a long block here", "other text"]
    seen = spark.createDataFrame([(1, k, t) for k, t in enumerate([0, 100, 299, 300, 301, 601])], "u int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["ts"].minute for r in Y.outside_ttl(seen, ["u"], "ts", 300).collect()) == [0, 5, 10]


def test_merges(spark):
    target = spark.createDataFrame([(1, "", 5), (2, "b", 6)], "id int, name string, n int")
    source = spark.createDataFrame([(1, "x", 7), (2, "y", 8), (3, "z", 9)], "id int, name string, n int")
    got = sorted(tuple(r) for r in M.upsert(target, source, ["id"], only_blank=("name",)).collect())
    assert got == [(1, "x", 7), (2, "b", 8), (3, "z", 9)]
    again = M.upsert(M.upsert(target, source, ["id"], only_blank=("name",)), source, ["id"], only_blank=("name",))
    assert sorted(tuple(r) for r in again.collect()) == got
    rules = spark.createDataFrame([(1, "/a", [], "first", None), (2, "/a", ["k=1"], "second", "full")], "pos int, url string, query array<string>, cate1 string, cate2 string")
    urls = spark.createDataFrame([("h/a?k=1",), ("h/A",), ("h/b",), (None,)], "url string")
    # rows have no order
    assert {r["url"]: r["cate1"] for r in categorized(urls, "url", rules).collect()} == {"h/a?k=1": "second", "h/A": "first", "h/b": None, None: None}


def test_columns(spark):
    df = spark.createDataFrame([("",), (" ",), (None,), ("x",)], "a string")
    assert [r[0] for r in df.select(is_blank("a")).collect()] == [True, True, True, False]
    assert select_existing(df, ["a", "zz"]).columns == ["a"]
    assert where_if_present(df, "zz", F.lit(False)).count() == 4


def test_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:body><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tr><w:tc><w:t>a</w:t></w:tc><w:tc><w:t>b|c</w:t></w:tc></w:tr><w:tr><w:tc><w:t>1</w:t></w:tc></w:tr></w:tbl></w:body></w:d>')
        z.writestr("docProps/core.xml", '<c><dcterms:created xsi:type="x">2024-01-02T03:04:05Z</dcterms:created></c>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_bytes("안녕하세요".encode("cp949"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Hello\n| a | b\\|c |\n| --- | --- |\n| 1 |  |" and got["a.docx"]["created"] == "2024-01-02T03:04:05Z"
    assert got["b.txt"]["text"] == "안녕하세요"
    assert got["c.docx"]["error"] and got["d.pdf"]["error"]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"detail_url": "u", "title": "t", "files": [{"url": "f.pdf"}]}\nbad\n{"detail_url": "v", "title": "w"}\n')
    details = tables.json_lines(spark, str(lines), "detail_url string, title string, files array<struct<url:string,name:string,extension:string,queued_at:string>>")
    assert sorted(tuple(r)[:5] for r in tables.attachments(details).collect()) == [("u", "t", "f.pdf", "t", "pdf"), ("v", "w", "", "w", "")]
