from __future__ import annotations

import pytest

from gristmill.functions import html as H
from gristmill.functions import page_parts as P
from gristmill.functions.dom import Tree, compiled
from gristmill.functions.script_calls import arguments, calls, script_download

PAGE = """<html><head><title>My long title here</title><meta property="og:title" content="Other title"></head><body><nav><a href="/n">nav</a></nav>
<article><h1>My long title here</h1><p>One &amp; two<script>x</script></p><p>Three <a href="mailto:a@b">m</a></p></article></body></html>"""


def test_tree():
    tree = Tree("<div id=a class='x y'><p>one<br>two<ul><li>3</ul><p class=y>four</div><span>five</div>")
    assert [tree.tag[k] for k in range(len(tree))] == ["", "div", "p", "br", "ul", "li", "p", "span"]
    assert tree.text(1) == "one two 3 four" and tree.text(0) == "one two 3 four five"
    assert [tree.parent[k] for k in tree.select(".y")] == [0, 2]  # tags left open hold what follows
    assert [row[2] for row in tree.flat()] == [1, 2, 3, 3, 4, 3, 1] and tree.flat()[0][4:6] == ("a", ["x", "y"])


@pytest.mark.parametrize(("selector", "found"), [
    ("p", [2, 4]), ("#a > p", [2]), ("#a p", [2, 4]), ("div.x.y", [1]), (".y, em", [1, 5]), ("[data-u]", [4]), ("[data-u='v w']", [4]), ("[data-u~=w]", [4]),
    ("[data-u*=' ']", [4]), ("[data-u^=v]", [4]), ("[data-u$=v]", []), ("*[id=a] b em", [5]), ("p + b", [3]), ("b + p", []), ("b > em", []), ("b > p > em.y", [5])])
def test_selectors(selector, found):
    tree = Tree("<div id=a class='x y'><p>1</p><b><p data-u='v w'><em class=y>2</em></p></b></div>")
    assert tree.select(selector) == found


def test_selectors_that_are_none():
    for wrong in ("!", "a >> b", "p:first-child"):
        with pytest.raises(ValueError, match="selector"):
            compiled(wrong)


def test_content_and_titles():
    tree = Tree(PAGE)
    assert P.content(tree) == "My long title here One & two Three m"
    assert P.title(tree) == ("My long title here", "heading") and P.title(tree, "p") == ("One & two", "block")
    assert P.title(tree, "none") == P.title(tree, "a >> b") == P.title(tree)
    assert [(t, s) for t, _, s, _ in P.scored_titles(tree)] == [("My long title here", 70), ("Other title", 55)]
    assert P.links(tree, "https://a.kr/x/") == [("https://a.kr/n", "nav", True)]
    assert H.blocks(tree) == ["My long title here", "One & two", "Three"]
    empty = Tree("")
    assert P.content(empty) == "" and P.title(empty) == ("", "") and P.scored_titles(empty) == [] == P.attachments(empty, "")
    assert H.blocks(Tree("<p>open <b>tags")) == ["open tags"] and not P.fast_parse(empty, "")["ok"]


@pytest.mark.parametrize(("html", "title"), [
    ("<div class=board_view><h4>접수중 (D-3) Course 담당부서 x 등록일 2024-01-02</h4></div>", ("Course", "place")),
    ("<header><h1>Not this one</h1></header><h2 class=title>This one</h2>", ("This one", "heading_class")),
    ("<div class=menu><h1>Menu</h1></div><div class='sub-title'>By class</div>", ("By class", "class")),
    ("<article><div class=gnb></div><h9>x</h9></article><meta name=description content='short words'>", ("short words", "meta")),
    ("<title>Only the tag</title>", ("Only the tag", "tag")),
    ("<h2>Value 조회</h2>", ("Value 조회", "heading")),
    ("<div class=tit><span class=badge><strong>New</strong></span><strong>The real one</strong></div>", ("The real one", "place"))])
def test_title_stages(html, title):
    assert P.title(Tree(html)) == title


def test_scores():
    rows = "<div class=board_view><div class='title'>Site &gt; Board &gt; Post</div></div><table class=table><tr class=tr><th>제목</th><td>Named by a row</td></tr></table><h1>홈</h1>"
    found = {t: (s, r) for t, _, s, r in P.scored_titles(Tree(rows))}
    assert found["Named by a row"] == (35, ["label_value_row"])
    assert found["Site > Board > Post"] == (40 + 30 + 25 - 10 - 20, ["inside_post_area", "heading_or_title", "semantic_class_or_id", "same_as_body_first_sentence", "breadcrumb"])
    assert found["홈"][0] == 30 - 20 - 30


def test_attachments():
    html = """<nav><a href="/guide.pdf">Guide</a></nav><ul class="file_list"><li><p>Report.hwp (1,2 MB)</p><a href="/f/filedown.do?fileId=1">download</a></li>
      <li><a href="/f/filedown.do?fileId=1">again</a></li><li><a href="/viewer?f=a.hwp">a.hwp</a></li></ul><dl><dt>첨부파일</dt><dd><a href="/x/2.zip">Data set</a></dd></dl>
      <div><a href="/get/plan+b.pdf"></a><button onclick="fileDown('FILE_7','1')">File</button><a href="#" data-url="/d/download.do?x=1&user_file_nm=%EA%B0%80.xlsx">받기</a></div>"""
    assert P.attachments(Tree(html), "https://a.kr/b/") == [
        ("https://a.kr/f/filedown.do?fileId=1", "Report.hwp", "href", False), ("https://a.kr/x/2.zip", "Data set.zip", "href", False),
        ("https://a.kr/get/plan+b.pdf", "plan b.pdf", "href", False), ("https://a.kr/common/cmm/fms/FileDown.do?atchFileId=FILE_7&fileSn=1", "attachment", "onclick", True)]
    assert P.attachments(Tree("<a data-url='/x/y.pdf'>zz</a>"), "https://a.kr/") == [("https://a.kr/x/y.pdf", "zz.pdf", "href", False)]


def test_lists_trails_menus():
    tree = Tree("""<header><ul><li><a href="/a">A</a><ul><li><a href="b">B</a><ul><li><a href="c">C</a></li></ul></li></ul></li><li><span>none</span></li></ul></header>
      <div class="location"><span>홈</span><span>News</span><span>Notice</span></div>
      <table><tr><td><a href="v?1">Post</a></td><td>2024년 3월 4일</td></tr><tr><td><a href="f.pdf">File</a></td><td>2024.1.1</td></tr><tr><td><a href="v?2">Undated</a></td></tr></table>
      <dl><dt>Who :</dt><dd>me</dd></dl>""")
    assert P.menu(tree, "http://h/") == [(0, "A", "http://h/a"), (1, "B", "http://h/b"), (2, "C", "http://h/c")]
    assert P.menu_markdown(P.menu(tree, "http://h/")) == "- [A](http://h/a)\n  - [B](http://h/b)\n    - [C](http://h/c)"
    assert P.trail(tree) == ["News", "Notice"] and P.posts(tree, "http://h/l") == [("http://h/v?1", "Post", "2024-03-04")]
    assert P.labelled_pairs(tree) == [("Post", "2024년 3월 4일"), ("File", "2024.1.1"), ("Who", "me")]
    trails = ["<ul class=path><li><a>Home</a></li><li><span>A</span><ul><li>x</li></ul></li><li>B 소개</li><li>C</li></ul>", "<p class=location>Main &gt; A &gt; A / B</p>",
              "<ol class=breadcrumb><li><a>A/B</a><a>C</a></li></ol>", "<title>구로구청 &gt; A &gt; B</title>", "<div class=path>Only</div><title>One</title>"]
    assert [P.trail(Tree(t)) for t in trails] == [["A", "B 소개", "C"], ["A", "B"], ["A/B", "C"], ["A", "B"], []]
    assert [P.category_of(P.trail(Tree(t))) for t in trails] == ["A", "A", "A/B", "A", ""]
    assert P.menu(Tree("<nav><a href=/x>x</a></nav>"), "") == [] == P.trail(Tree("<div class=location>Home</div>"))


def test_calls():
    assert arguments("'a, b', \"c\\\"d\", 3 , f(1,2), [x, 'y'])z", 0) == (["a, b", 'c"d', "3", None, None], 37)
    assert arguments(")", 0) == ([], 1) and arguments("'open", 0)[0] == ["open"]
    assert list(calls("a.b('x', g(1))")) == [("b", ["x", None]), ("g", ["1"])]
    assert script_download(None) == script_download(" ") == script_download("javascript:x()") == ""
    assert script_download("javascript:downloadFile('it\\'s.pdf')", "http://h/a/") == "http://h/a/it's.pdf"
    assert script_download("fileDownNow('s.hwp','u v.hwp','/p/q')") == "https://eminwon.gm.go.kr/emwp/jsp/ofr/FileDownNew.jsp?user_file_nm=u%20v.hwp&sys_file_nm=s.hwp&file_path=/p/q"


def test_facts(spark):
    rows = spark.createDataFrame([(1, "https://a.kr/x/", PAGE), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in H.facts(rows, "title", "links", "content", "fast", "attachments").collect()}
    assert found[1]["title"]["stage"] == "heading" and found[1]["links"][0]["url"] == "https://a.kr/n" and not found[1]["attachments"]
    assert found[2]["content"] == "" == found[3]["content"] and not found[2]["fast"]["ok"] and found[3]["links"] == []


def test_plain_tags_are_read_as_by_the_parser():
    import random

    from gristmill.functions.dom import Tree

    class Parsed(Tree):
        def _read_plain(self, html):
            return False

    bits = ["<p>", "</p>", '<P Class="a b">', "<br>", "<br/>", "<img src='&lt;'>", '<a href="/x?a=1&amp;b&copy=3">', "</a>", "text", "&amp", "&nbsp;x", " ", '<div id="i" disabled>', "</div >",
            "<script>", "</script>", "a<b", "<!-- c -->", "<title>", "</title>", "<li/>", "<td x=1>", "<style>p{}", "</style>", "&", '<a b="1" b="2">', "<é>", "</br>", '<a href="x"href="y">']
    r = random.Random(3)
    plain = 0
    for _ in range(3000):
        html = "".join(r.choice(bits) for _ in range(r.randrange(1, 7)))
        one, other = Tree(html), Parsed(html)
        for name in ("parent", "tag", "attrs", "last", "first_text", "last_text", "pieces", "owner", "by_tag", "by_class", "by_id"):
            assert getattr(one, name) == getattr(other, name), html
        plain += one.plain
    assert plain > 500


def test_pages_are_spread_and_given_out_in_parts(spark, sf_dir):
    from gristmill.functions import html as H
    from gristmill.plans.page_queries import parsed, site_pages

    assert site_pages(spark, sf_dir).rdd.getNumPartitions() >= 4 and parsed(spark, sf_dir).rdd.getNumPartitions() >= 4  # one file each
    made = spark.range(1, 1001, 1, 1).selectExpr("id as page_id", "'u' as url", "'<p>x</p>' as html")
    assert H.facts(made, "nodes").count() == 1000


def test_sql_reads_entities_as_pages_do():
    from html import unescape

    import duckdb

    from gristmill.plans.sql import unescaped

    texts = ["a &amp", "a &amp; b", "&lt;b&gt", "&copy&middot;&quot", "&amp;lt;", "&am", "x&&&amp", "&", ""]
    found = duckdb.execute(f"select t, {unescaped('t')} from (select unnest(?) as t)", [texts]).fetchall()
    assert all(said == unescape(t) for t, said in found) and len(found) == len(texts)


def test_each_order_has_a_dated_post(spark, sf_dir):
    from gristmill.plans.page_queries import page_post_dates

    assert page_post_dates(spark, sf_dir).where("day is not null").count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_list_posts_follow_scripts_and_keep_undated():
    """Addresses in scripts and data are made out, lists come before menus, posts without a day stay, and a range of days parts the others."""
    from gristmill.functions.list_posts import list_posts

    html = """<body><div id=content><p>Some introduction of the board.</p><a href="/x/view.do?nttId=99">outside of the list</a><table class="bbsList a"><tbody>
      <tr><td><a href="#none" onclick="go('/b/view.do?nttId=1', 7); return false">One</a></td><td>2024.3.4</td></tr>
      <tr><td><a href="javascript:show('view.do?nttId=2')">Two</a></td><td>2023-01-09</td></tr>
      <tr><td><a data-url="/b/view.do?nttId=3&amp;q=(x)"> </a><a href="/b/view.do?nttId=3&amp;q=(x)">Three</a></td><td>-</td></tr>
      <tr><td><a href="http://other/b/view.do?nttId=4">Elsewhere</a><a href="list.do?page=2">2</a><a href="f.pdf">f</a></td><td>2024.3.4</td></tr>
      <tr><td><a href="view.do?nttId=5">Five</a></td><td>2025/12/31</td></tr><tr><td><a href="view.do?nttId=6">Six</a></td><td>2024.13.40</td></tr></table></div>"""
    tree, base = Tree(html), "http://h/b/list.do"
    one, two, three = ("http://h/b/view.do?nttId=1", "One", "2024-03-04"), ("http://h/b/view.do?nttId=2", "Two", "2023-01-09"), ("http://h/b/view.do?nttId=3&q=(x)", "Three", "")
    five, six = ("http://h/b/view.do?nttId=5", "Five", "2025-12-31"), ("http://h/b/view.do?nttId=6", "Six", "")
    assert list_posts(tree, base) == {"posts": [one, two, three, five, six], "old": [], "new": [], "stopped": False}
    assert list_posts(tree, base, "2024-01-01", "2024-12-31", 1) == {"posts": [one, three, six], "old": [two], "new": [five], "stopped": True}
    assert not list_posts(tree, base, "2024-01-01")["stopped"]
    numbers = "https://h/BD_selectBbsList.do?q_bbsCode=1001"
    assert list_posts(Tree("<a href='#' onclick=\"opView('20240001')\">x</a>"), numbers)["posts"] == [("https://h/BD_selectBbs.do?q_bbsCode=1001&q_bbscttSn=20240001", "x", "")]
    contracts = "https://www.gm.go.kr/pt/bidContractInfo/contractInfo/contractList.do?menu=1"
    assert list_posts(Tree("<a onclick=\"opView('C-7')\">x</a>"), contracts)["posts"][0][0] == "https://www.gm.go.kr/pt/bidContractInfo/contractInfo/contractView.do?menu=1&ctrtAcctBookMngNo=C-7"
    assert list_posts(Tree("<script>var u = '/b/boardView.do?seq=8';</script>"), base)["posts"] == [("http://h/b/boardView.do?seq=8", "", "")]
    assert list_posts(Tree("<tr><td><a href=v?1>Post</a></td><td>2024년 3월 4일</td></tr>"), base)["posts"] == [("http://h/b/v?1", "Post", "2024-03-04")]
    assert list_posts(Tree(""), "")["posts"] == list_posts(Tree("<li><a href='http://[x/view.do?no=1'>x</a> 2024.1.1</li>"), base)["posts"] == []
    assert list_posts(Tree("<a href='/view.do?no=1'>x</a>"), "http://[h/BD_selectBbsList.do")["posts"] == [("/view.do?no=1", "x", "")]


def test_board_lists_part_days(spark):
    page = "<tr><td><a href='view.do?no={0}'>P{0}</a></td><td>20{0}-01-02</td></tr>"
    rows = [(1, "https://a.kr/bbs/list.do", "<table class=bbsList>" + "".join(page.format(k) for k in range(20, 26)) + "</table>"), (2, None, None)]
    found = {r["page_id"]: r for r in H.board_lists(spark.createDataFrame(rows, "page_id long, url string, html string"), "2023-01-01", "2024-12-31").collect()}
    assert [p["title"] for p in found[1]["posts"]] == ["P23", "P24"] and [p["date"] for p in found[1]["new"]] == ["2025-01-02"]
    assert len(found[1]["old"]) == 3 and found[1]["stopped"] and not found[2]["posts"] and not found[2]["stopped"]
