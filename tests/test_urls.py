from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import urls as U
from gristmill.functions.punycode import ascii_host, encoded_label
from gristmill.operators.components import components, connected_rows
from gristmill.operators.ordering import with_place
from gristmill.operators.rules import categorized


def made(spark, expression, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_punycode_against_the_codec(spark):
    r = random.Random(1)
    labels = ["한국", "bücher", "日本語", "ü", "aü", "üa", "münchen-ost", "a" * 40 + "é", "é" * 30, "😀", "x😀y", "ascii", "пример", "ไทย", "ß"[:0] or "ñandú"]
    letters = "abcdef-0éüñ한국어日本語пример"
    labels += ["a" + "".join(r.choice(letters) for _ in range(r.randrange(1, 24))) + "é" for _ in range(60)]
    expected = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    assert made(spark, encoded_label, *labels) == expected


def test_hosts(spark):
    hosts = ["한국.KR", "BÜCHER.de:8080", "a..é", "plain.com", "日本語。jp", "é" * 70 + ".kr", "", None]
    assert made(spark, ascii_host, *hosts) == ["xn--3e0b707e.kr", "xn--bcher-kva.de:8080", "a..é", "plain.com", "xn--wgv71a119e.jp", "é" * 70 + ".kr", "", None]
    # such a key may be grouped by, as it is the same each time
    rows = spark.createDataFrame([("http://한국.kr/a",), ("http://xn--3e0b707e.kr/a",)], "u string")
    assert rows.groupBy(U.canonical_dedup_url("u").alias("k")).count().collect() == [("http://xn--3e0b707e.kr/a", 2)]


@pytest.mark.parametrize(("url", "canonical"), [
    ("https://a.kr/x/BD_selectBbs.do?q_bbsCode=1&q_bbscttSn=2&q_currPage=3&other=4", "https://a.kr/__bbs_detail__/BD_selectBbs.do?q_bbscode=1&q_bbscttsn=2"),
    ("https://a.kr/x/bd_selectnftcbbsdetail.do?q_nftcBbsCode=1&q_nftcBbsMgtNo=2&z=1", "https://a.kr/__bbs_detail__/BD_selectNftcBbsDetail.do?q_nftcbbscode=1&q_nftcbbsmgtno=2"),
    ("https://a.kr/x/selectBoardDetail.do?bbsId=1&nttId=2&menuNo=9", "https://a.kr/__bbs_detail__/selectBoardDetail.do?bbsid=1&nttid=2"),
    ("https://a.kr/bbs/view.do?nttId=2&bbsId=1&menuNo=9", "https://a.kr/bbs/view.do?bbsid=1&nttid=2"),
    ("https://a.kr/bbs/view.do?nttId=2&menuNo=9", "https://a.kr/bbs/view.do?nttid=2"),
    ("https://a.kr/board/read.php?postSeq=5&bizId=6&searchWord=x&page=2", "https://a.kr/board/read.php?bizid=6&postseq=5"),
    ("https://a.kr/board/read.php?postSeq=5&bizId=6&color=x&page=2", "https://a.kr/board/read.php?bizid=6&color=x&postseq=5"),
    ("https://a.kr/p?search_id=3&q_page=2&q_x=1&search=y", "https://a.kr/p?q_x=1&search_id=3"), ("HTTP://WWW.A.kr:80//b/../C/?utm_source=1#f", "http://a.kr/C"),
    ("javascript:void(0)", ""), (" ", ""), (None, "")])
def test_identity(spark, url, canonical):
    assert made(spark, U.canonical_dedup_url, url) == [canonical]


def test_keys_and_terms(spark):
    keys, terms = (made(spark, f, "https://www.a.kr/x/selectBoardDetail.do?nttId=2&bbsId=1&menuNo=9", "https://www.a.kr/b/c?no=7", "") for f in (U.dedup_keys, U.candidate_terms))
    assert keys[0] == ["https://a.kr/__bbs_detail__/selectBoardDetail.do?bbsid=1&nttid=2", "a.kr|bbsid=1|nttid=2|selectboarddetail.do", "a.kr|bbs_detail|bbsid=1|nttid=2",
                       "nttid=2", "bbsid=1", "a.kr|nttid=2", "a.kr|bbsid=1"]
    assert keys[1] == ["https://a.kr/b/c?no=7", "a.kr|c|no=7", "no=7", "a.kr|no=7"] and keys[2] == [] == terms[2]
    assert terms[:2] == [["nttid=2", "bbsid=1"], ["/b/c", "no=7"]]


def test_components_against_plain(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2400)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    expected = {x: top(x) for pair in edges for x in pair}
    found = {r["u"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(x, x) == c for x, c in expected.items()) and set(found) <= set(expected)


def test_connected_rows_with_a_hot_key(spark):
    rows = [(k, ["hot", f"own{k}"]) for k in range(500)] + [(1000, ["a", "b"]), (1001, ["b", "c"]), (1002, ["c"]), (1003, []), (1004, None), (None, ["a"])]
    found = [(r["i"], r["component"]) for r in connected_rows(spark.createDataFrame(rows, "i long, k array<string>"), "i", "k").collect()]
    assert sorted(found, key=repr) == sorted([(k, 0) for k in range(500)] + [(1000, 1000), (1001, 1000), (1002, 1000), (1003, 1003), (1004, 1004), (None, None)], key=repr)


def test_rules_against_plain(spark):
    r = random.Random(9)
    parts = ["/en/", "/EN", "page=2", "x", "", "blog.", "/a/b/c", "utm_source=feed", "a=1&"]
    rules = [(k, r.choice(parts), [r.choice(parts) for _ in range(r.randrange(3))], f"c{k}", r.choice([None, " ", f"s{k}"])) for k in range(60)]
    rules = [x for x in rules if x[1] or any(x[2]) or x[0] > 50]
    urls = [f"https://{r.choice(['blog.', 'm.'])}h.kr/{r.choice(['en', 'fr', 'a/b/c'])}/{k}?{r.choice(['page=2', 'a=1&x=2', 'utm_source=feed', ''])}" for k in range(80)] + [None, "", "HTTP://BLOG.h/EN/?PAGE=2"]

    def plain(url):
        if url is None:
            return None, None
        hits = [x for x in rules if x[1].lower() in url.lower() and all(t.lower() in url.lower() for t in x[2])]
        best = min(hits, key=lambda x: (not (x[4] or "").strip(), x[0]), default=None)
        return (best[3], best[4]) if best else (None, None)

    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    table = spark.createDataFrame(rules, "pos int, url string, query array<string>, cate1 string, cate2 string")
    found = {x["i"]: (x["cate1"], x["cate2"]) for x in categorized(rows, "url", table).collect()}
    assert found == {k: plain(u) for k, u in enumerate(urls)} and len(set(found.values())) > 5
    none = categorized(rows, "url", table.limit(0)).select("cate1").distinct().collect()
    assert [x["cate1"] for x in none] == [None]


def test_many_rules(spark):
    rules = spark.range(100_000).selectExpr("cast(id as int) as pos", "concat('/item-', id, '/') as url", "array('k=1') as query", "concat('c', id) as cate1", "'s' as cate2")
    rows = spark.createDataFrame([(1, "http://a/ITEM-77777/?k=1"), (2, "http://a/item-5/?k=2"), (3, "http://a/item-5/?k=1")], "i int, url string")
    assert sorted((r["i"], r["cate1"]) for r in categorized(rows, "url", rules).collect()) == [(1, "c77777"), (2, None), (3, "c5")]


def test_rules_of_the_same_parts_are_one(spark):
    from gristmill.operators.rules import rule_index

    rules = spark.range(5000).selectExpr("id as pos", "if(id % 2 = 0, '/EN/', '/fr/') as url", "array('b=1', if(id % 3 = 0, 'b=1', 'a=1')) as query",
                                         "concat('c', id) as cate1", "if(id < 100, null, concat('s', id)) as cate2")
    texts = spark.createDataFrame([("h/en/?a=1&b=1",)], "low string")
    index, _ = rule_index(rules, texts)
    assert sorted((r["pos"], sorted(r["parts"])) for r in index.collect()) == [
        (100, ["/en/", "a=1", "b=1"]), (101, ["/fr/", "a=1", "b=1"]), (102, ["/en/", "b=1"]), (105, ["/fr/", "b=1"])]


def test_no_growing_table_of_urls_is_broadcast(spark, sf_dir):
    from gristmill.plans.url_queries import post_url_plan

    found = post_url_plan(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= plan.count("Scan ExistingRDD")  # only the index of the rules, which is bounded


def test_places(spark):
    rows = spark.range(0, 1000, 1, 7).withColumn("v", (F.col("id") * 7919) % 101)
    found = with_place(rows, "place", F.col("v"), F.desc("id")).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(1000)) and [r["id"] for r in found] == [r["id"] for r in sorted(found, key=lambda r: (r["v"], -r["id"]))]
    assert with_place(rows.limit(0), "place", F.col("v")).count() == 0
