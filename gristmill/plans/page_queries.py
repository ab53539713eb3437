"""Queries over the HTML of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import html as H
from gristmill.functions import urls as U
from gristmill.functions.columns import as_column
from gristmill.functions.detail_evidence import LEAST_MARKS
from gristmill.plans.registry import query
from gristmill.plans.sql import unescaped
from gristmill.sources.tables import spread, table

#: Pages of a site, by the priority of an order: what each kind of page looks like. {k}, {c}, {d}, {e} and {s} stand for
#: key, customer, day (two forms) and status of the order.
_MENU = ('<header><ul class="gnb"><li><a href="/a">Sector A</a><ul><li><a href="/a/b">Sector B</a></li></ul></li><li><a href="/guide.pdf">Guide</a></li></ul></header>'
         '<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/b">Board {s}</a> &gt; <span>Orders</span></div>')
SITE = {
    "1": '<div id="contents" class="board_view"><h4>Order {k} notice 작성자 c{c} 작성일 {e}</h4><table><tr><th>Author :</th><td>c{c}</td><th>Date</th><td>{d}</td></tr>'
         '<tr><th>첨부파일</th><td><a href="/cmm/fms/FileDown.do?atchFileId=F{k}&amp;fileSn=0">plan{k}.hwp [29.0 KB]</a></td></tr></table></div>',
    "2": '<div id="content"><h3 class="Subject">[{s}] Order {k}</h3><p>Text of {c}.</p><ul class="file_list"><li><a href="javascript:fn_egov_downFile(\'F{k}\', \'1\')">b{k}.pdf</a></li></ul></div>',
    "3": '<main><h2>Plain order {k}</h2><p>Sent on {d}.</p><button onclick="fileDown(\'FILE_{k}\',\'2\'); return false">c.xlsx download</button><a href="/b/list.do">List</a></main>',
    "4": '<div class="article"><p>No heading, customer {c}.</p><a href="/preview.jsp?file=x{k}.hwp">x{k}.hwp</a></div>',
    "5": '<table><tr><td><a href="view.do?id={k}">Post {k}</a></td><td>{d}</td></tr><tr><td><a href="view.do?id=0">No date</a></td><td>-</td></tr></table>',
}


def _filled(template: str) -> F.Column:
    date = F.add_months("o_orderdate", 240)  # pages are read for days of this century
    given = {"k": F.col("o_orderkey").cast("string"), "c": F.col("o_custkey").cast("string"), "d": F.date_format(date, "yyyy.MM.dd"),
             "e": F.date_format(date, "yyyy-MM-dd"), "s": F.col("o_orderstatus")}
    html = F.lit(template)
    for name, value in given.items():
        html = F.replace(html, F.lit("{" + name + "}"), value)
    return html


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages are made of, spread before they are made: few bytes of it are many pages to parse."""
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"), "o_orderkey")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a site for each order, as (page_id, url, html): three kinds of detail pages with files, one with a preview only, one list."""
    kind = F.substring("o_orderpriority", 1, 1)
    body = F.coalesce(*[F.when(kind == name, _filled(_MENU + template)) for name, template in SITE.items()], F.lit(""))
    head = F.concat(F.lit("<html><head><title>Site</title>"), F.when(kind == "4", _filled('<meta property="og:title" content="Shared order {k}">')).otherwise(""))
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://a.kr/bbs/list.do?no="), as_column("o_orderkey").cast("string")).alias("url"),
        F.concat(head, F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, spread before they are parsed."""
    return spread(pages(spark, sf_dir), "page_id")


def _plain(html: str) -> str:
    """SQL: the text of a piece of HTML."""
    bare = unescaped(f"regexp_replace({html}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
_DAY = "strftime(o_orderdate + interval 20 years, '%Y.%m.%d')"
_KIND = "left(o_orderpriority, 1)"


@query("page_nodes", """
    with p as (select page_id, regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g') as html from pages),
    t as (select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) as tag from p)
    select page_id, tag, count(*) as n from t group by 1, 2""")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each tag the tree of a page has."""
    nodes = H.facts(parsed(spark, sf_dir), "nodes").select("page_id", F.explode("nodes.tag").alias("tag"))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("page_main_content", f"select page_id, {_plain(_ARTICLE)} as content, length({_plain(_ARTICLE)})::int as n_chars from pages")
def page_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.facts(parsed(spark, sf_dir), "content").select("page_id", "content", F.length("content").alias("n_chars"))


@query("page_block_texts")
def page_block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of block elements, in order, those over five characters that no other kept block contains."""
    from gristmill.operators.duplicates import contained_blocks_dropped

    blocks = H.facts(parsed(spark, sf_dir), "blocks")
    return blocks.select("page_id", F.posexplode(contained_blocks_dropped(F.col("blocks"))).alias("block_no", "block"))


@query("page_title_candidates", rf"""
    with p as (select page_id, {_plain(_H1)} as t, {_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as tag, {_plain(_ARTICLE)} as body from pages),
    f as (select *, regexp_replace(lower(t), '[\s:：ㆍ·\[\]()-]', '', 'g') as k, regexp_replace(lower(tag), '[\s:：ㆍ·\[\]()-]', '', 'g') as kt,
      left(case when regexp_matches(body, '^.*?[.!?。！？]\s') then trim(regexp_extract(body, '^(.*?[.!?。！？])\s', 1)) else body end, 160) as first from p),
    c as (select page_id, t as title, 'h1' as place, k, 70 as score, ['inside_post_area', 'heading_or_title'] as reasons, first from f union all
      select page_id, tag, 'title', kt, 55, ['heading_or_title', 'semantic_class_or_id'], first from f where kt <> k),
    j as (select *, length(title) not between 4 and 160 as bad, (length(k) <= 3 and not regexp_matches(k, '[0-9]')) as menu,
      regexp_replace(lower(first), '[\s:：ㆍ·\[\]()-]', '', 'g') = k as same, len(string_split(title, '>')) > 2 as crumb from c where k <> ''),
    s as (select *, score - 20 * bad::int - 30 * menu::int - 10 * same::int - 20 * crumb::int as final from j)
    select page_id, (row_number() over (partition by page_id order by final desc, place) - 1)::int as rank, title, place, final::int as score,
      array_to_string(list_concat(reasons, list_filter([case when bad then 'bad_length' end, case when menu then 'site_or_menu_only' end,
        case when same then 'same_as_body_first_sentence' end, case when crumb then 'breadcrumb' end], lambda x: x is not null)), ',') as reasons from s""")
def page_title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a page may have, by score, with the reasons of each."""
    found = H.facts(parsed(spark, sf_dir), "titles").select("page_id", F.posexplode("titles").alias("rank", "t"))
    return found.select("page_id", "rank", "t.title", "t.place", "t.score", F.array_join("t.reasons", ",").alias("reasons"))


@query("page_title_stages", f"""
    select o_orderkey as page_id, case {_KIND} when '1' then 'Order ' || o_orderkey || ' notice' when '2' then '[' || o_orderstatus || '] Order ' || o_orderkey
      when '3' then 'Plain order ' || o_orderkey when '4' then 'Shared order ' || o_orderkey else 'Site' end as title,
      case {_KIND} when '1' then 'place' when '2' then 'heading_class' when '3' then 'heading' when '4' then 'meta' else 'tag' end as stage from orders
    union all select -1 - page_id, {_plain(_H1)}, 'heading' from pages""")
def page_title_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page with the stage that found it; given pages have negative numbers."""
    given = parsed(spark, sf_dir).withColumn("page_id", -1 - F.col("page_id"))
    return H.facts(site_pages(spark, sf_dir).unionByName(given.select("page_id", "url", "html")), "title").select("page_id", "title.*")


@query("page_title_tag", "select page_id, coalesce(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') as title, len(regexp_extract_all(html, '<h1[ >]'))::int as n_h1 from pages")
def page_title_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"),
                                       F.regexp_count("html", F.lit("<h1[ >]")).alias("n_h1"))


@query("page_links", """
    with l as (select page_id, url, unnest(range(0, len(h)))::int as link_no, unnest(h) as href, unnest(t) as anchor from (
      select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as t from pages))
    select page_id, link_no, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href as url, anchor, true as in_menu from l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to other pages, with their texts and whether they stand in a menu."""
    found = H.facts(parsed(spark, sf_dir), "links").select("page_id", F.posexplode("links").alias("link_no", "l"))
    return found.select("page_id", "link_no", "l.*")


@query("page_link_places", f"""
    with n as (select o_orderkey as page_id, 3 as n_menu, 2 + case {_KIND} when '5' then 2 when '2' then 0 else 1 end as n_content from orders)
    select * from n""")
def page_link_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of a page stand in menus, and how many elsewhere."""
    return H.facts(site_pages(spark, sf_dir), "links").select(
        "page_id", F.size(F.filter("links", lambda x: x["in_menu"])).alias("n_menu"), F.size(F.filter("links", lambda x: ~x["in_menu"])).alias("n_content"))


@query("page_href_counts", """
    with l as (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"#][^"]*)"', 1)) as href from pages)
    select href, count(*) as n, count(distinct page_id) as pages from l where not regexp_matches(lower(href), '^(javascript|mailto|tel):') group by href""")
def page_href_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a\\s[^>]*href="([^"#][^"]*)"'), F.lit(1))).alias("href"))
    kept = links.where(~F.lower("href").rlike("^(javascript|mailto|tel):"))
    return kept.groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query("page_fast_parse", f"""
    with p as (select page_id, {_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title, {_plain(_ARTICLE)} as body,
      {_plain("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<script>.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g')")} as whole,
      len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)">', 1))) as n from pages)
    select page_id, title, case when length(body) >= 30 then body else whole end as content, case when length(body) >= 30 then 'article' else 'body' end as place,
      '' as day, n::int as n_links, true as ok from p""")
def page_fast_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, content, first day and links of a page; ok with a title, enough content or a day."""
    return H.facts(parsed(spark, sf_dir), "fast").select("page_id", "fast.title", "fast.content", "fast.place", "fast.day", F.size("fast.links").alias("n_links"), "fast.ok")


@query("page_attachments", f"""
    select o_orderkey as page_id, 'https://a.kr' || case {_KIND} when '1' then '/cmm/fms/FileDown.do?atchFileId=F' || o_orderkey || '&fileSn=0'
        when '2' then '/cmm/fms/FileDown.do?atchFileId=F' || o_orderkey || '&fileSn=1' else '/common/cmm/fms/FileDown.do?atchFileId=FILE_' || o_orderkey || '&fileSn=2' end as url,
      case {_KIND} when '1' then 'plan' || o_orderkey || '.hwp' when '2' then 'b' || o_orderkey || '.pdf' else 'c.xlsx' end as name,
      case {_KIND} when '1' then 'href' when '2' then 'javascript' else 'onclick' end as reason, {_KIND} <> '1' as unsure from orders where {_KIND} < '4'""")
def page_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that pages offer: by links, scripts and click handlers; previews and files in menus are none."""
    given = parsed(spark, sf_dir).select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return H.facts(site_pages(spark, sf_dir).unionByName(given), "attachments").select("page_id", F.inline("attachments"))


@query("page_menu_tree", """
    with i as (select unnest([{'place': 0, 'depth': 0, 'label': 'Sector A', 'url': '/a'}, {'place': 1, 'depth': 1, 'label': 'Sector B', 'url': '/a/b'},
      {'place': 2, 'depth': 0, 'label': 'Guide', 'url': '/guide.pdf'}]) as i),
    nav as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav, regexp_extract(url, '^([a-z]+://[^/]*)', 1) as root from pages),
    l as (select page_id, root, unnest(range(0, len(h)))::int as place, unnest(h) as href, unnest(t) as label from (
      select page_id, root, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) as t from nav))
    select o_orderkey as page_id, i.place, i.depth, i.label, 'https://a.kr' || i.url as url from orders, i
    union all select -1 - page_id, place, 0, label, root || href from l""")
def page_menu_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each page's menu with their depth."""
    given = parsed(spark, sf_dir).select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    found = H.facts(site_pages(spark, sf_dir).unionByName(given), "menu").select("page_id", F.posexplode("menu").alias("place", "m"))
    return found.select("page_id", "place", "m.*")


@query("site_descendants", """
    with recursive e as (select distinct regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as child,
        array_to_string(string_split(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '.')[2:], '.') as parent from pages),
      all_e as (select * from e where parent <> '' union select distinct parent, array_to_string(string_split(parent, '.')[2:], '.') from e where parent like '%.%.%'),
      d as (select 'example.com' as node, 0 as depth union all select a.child, d.depth + 1 from d join all_e a on a.parent = d.node where d.depth < 4)
    select node, min(depth)::int as depth from d group by node""")
def site_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts below a domain by bounded steps over parent and child names."""
    parent = lambda c: F.regexp_replace(c, r"^[^.]*\.?", "")
    hosts = pages(spark, sf_dir).select(U.host("url").alias("child")).distinct().withColumn("parent", parent(F.col("child")))
    inner = hosts.where(F.col("parent").rlike(r"\..*\.")).select(F.col("parent").alias("child"), parent(F.col("parent")).alias("parent"))
    edges = hosts.where("parent != ''").union(inner).distinct()
    found = level = spark.createDataFrame([("example.com", 0)], "node string, depth int")
    for _ in range(4):
        level = edges.join(level, edges.parent == level.node).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"))
        found = found.union(level)
    return found.groupBy("node").agg(F.min("depth").alias("depth"))


@query("page_labelled_pairs", f"""
    select o_orderkey as page_id, unnest(['Author', 'Date', '첨부파일']) as label, unnest(['c' || o_custkey::varchar, {_DAY}, 'plan' || o_orderkey || '.hwp [29.0 KB]']) as value
    from orders where {_KIND} = '1' union all select o_orderkey, 'Post ' || o_orderkey, {_DAY} from orders where {_KIND} = '5'
    union all select o_orderkey, 'No date', '-' from orders where {_KIND} = '5'""")
def page_labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of tables and definition lists with their labels."""
    return H.facts(site_pages(spark, sf_dir), "pairs").select("page_id", F.inline("pairs"))


#: Posts with a labelled day and other labelled values, by the priority of an order; {d} is its day with dots, {e} with hyphens.
POSTS = {
    "1": "<table><tr><th>Author :</th><td>c{c}</td><th>Date</th><td>{d}</td></tr></table>",
    "2": "<table><tr><td>등록일</td><td>{e}</td></tr><tr><td>수정일</td><td>1999-01-01</td></tr></table>",
    "3": "<dl><dt>작성일 :</dt><dd>{d}</dd><dt>조회수</dt><dd>20</dd></dl>",
    "4": "<table><tr><th>게시일</th><th>조회</th></tr></table><table><tr><th>게시일</th><td>{e}</td></tr></table>",
    "5": "<dl><dt>Author</dt><dd>2001-01-01</dd><dt>DATE</dt><dd>{d}</dd></dl>",
}


@query("page_post_dates", "select o_orderkey as page_id, (o_orderdate + interval 20 years)::date as day from orders")
def page_post_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each post, one for each order, by its label."""
    from gristmill.functions.dates import parse_date

    kind = F.substring("o_orderpriority", 1, 1)
    html = F.concat(_filled(_MENU), F.coalesce(*[F.when(kind == k, _filled(post)) for k, post in POSTS.items()]))
    made = orders(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.kr/").alias("url"), html.alias("html"))
    dated = H.facts(made, "pairs").select("page_id", F.inline("pairs")).where(F.lower("label").rlike("^(date|작성일|등록일|게시일)$"))
    return dated.groupBy("page_id").agg(F.min(parse_date("value").cast("date")).alias("day"))


@query("board_posts", f"""
    select o_orderkey as page_id, 'https://a.kr/bbs/view.do?id=' || o_orderkey::varchar as url, 'Post ' || o_orderkey::varchar as title,
      strftime(o_orderdate + interval 20 years, '%Y-%m-%d') as date from orders where {_KIND} = '5'""")
def board_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that list pages name, by links and scripts, of any day; those without a day are left to ``board_lists``."""
    return H.board_lists(site_pages(spark, sf_dir)).select("page_id", F.inline("posts")).where("date != ''")


@query("page_breadcrumbs", "select 'Board ' || o_orderstatus || ' > Orders' as trail, 'Board ' || o_orderstatus as category, count(*) as n from orders group by 1, 2")
def page_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails without their home page and the categories that they name, with the number of pages that have them."""
    trails = H.facts(site_pages(spark, sf_dir), "trail", "category").select(F.array_join("trail", " > ").alias("trail"), "category")
    return trails.groupBy("trail", "category").agg(F.count(F.lit(1)).alias("n"))


#: Pages that name days, by the priority of an order; {d} is its day with dots, {k} in Korean, {b} eight digits, {e} the day of the month nine days on.
DATED = {
    "1": "<dl><dt>수정일</dt><dd>{l}</dd><dt>등록일</dt><dd>{d} 10:00</dd></dl><p>1999-01-01 2019.12.31</p>",
    "2": "<p><span>작성일</span> : <b>{k}</b> 작성일자 {b}</p><p>2019.12.31</p>",
    "3": "<table><tr><th>장소</th><td>2001.1.1</td></tr><tr><th>행사 기간</th><td>{d}(월) 10:00 ~ {n}</td></tr></table>",
    "4": "<p>모집 2018 신청기간 : {d} ~ {e}일, 20명</p><p>2030-01-01</p>",
    "5": "<p>{d}, 2030-01-01, 2011.13.1 and 2012-01-01</p>",
}


@query("page_dates", f"""
    with o as (select *, {_KIND} as kind, (o_orderdate + interval 20 years)::date as d from orders)
    select o_orderkey as page_id, case kind when '4' then make_date(year(d), 1, 1) when '5' then greatest(d, date '2012-01-01') else d end as day,
      case kind when '1' then 'posted' when '2' then 'posted' when '3' then 'event' when '4' then 'application' else 'any' end as source,
      case when kind = '1' then d + 40 end as modified, case when kind = '3' then d end as event_start, case when kind = '3' then d + 9 end as event_end,
      case when kind in ('3', '4') then d end as apply_start, case when kind = '3' then d + 9 when kind = '4' then case when month(d + 9) = month(d) then d + 9 else d end end as apply_end from o""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When pages were posted and changed, and the periods of their events and applications."""
    day = F.add_months("o_orderdate", 240)
    later = F.date_add(day, 9)
    given = {"d": F.date_format(day, "yyyy.M.d"), "k": F.date_format(day, "yyyy년 M월 d일"), "b": F.date_format(day, "yyyyMMdd"), "l": F.date_format(F.date_add(day, 40), "yyyy-MM-dd"),
             "n": F.when(F.year(later) == F.year(day), F.date_format(later, "M.d")).otherwise(F.date_format(later, "yyyy.MM.dd")),
             "e": F.dayofmonth(F.when(F.month(later) == F.month(day), later).otherwise(day)).cast("string")}
    html = F.coalesce(*[F.when(F.substring("o_orderpriority", 1, 1) == kind, F.lit(template)) for kind, template in DATED.items()])
    for name, value in given.items():
        html = F.replace(html, F.lit("{" + name + "}"), value)
    made = orders(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.kr/").alias("url"), html.alias("html"))
    return H.dates(made, "2029-01-01")


@query("page_favicons", """
    with p as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as host,
      regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) || '', '^(.*/)', 1) as folder from pages)
    select page_id, case page_id % 7 when 0 then scheme || '://' || host || folder || 'a/b.png' when 1 then scheme || '://cdn.example/i.ico' when 2 then scheme || '://' || host || '/t.png'
      when 3 then scheme || '://' || host || regexp_replace(folder, '[^/]+/$', '') || 'up.ico' when 4 then 'data:image/png;base64,AA' else scheme || '://' || host || '/favicon.ico' end as favicon from p""")
def page_favicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The icon of each page; most pages get link tags, as the given ones have none."""
    tags = ["""<link rel="preload icon" href="/x.png"><link rel='icon' href="a/b.png">""", '<link href="//cdn.example/i.ico" rel="shortcut icon">',
            "<link rel=mask-icon href=/t.png>", '<link rel="apple-touch-icon" href="../up.ico">', '<link rel="icon" href="data:image/png;base64,AA">',
            '<!-- <link rel="icon" href="/no.ico"> -->', '<link rel="stylesheet" href="/icon.css"><link rel="icon" href="">']
    kind = F.col("page_id") % len(tags)
    html = F.concat(F.coalesce(*[F.when(kind == k, F.lit(tag)) for k, tag in enumerate(tags)]), "html")
    return H.facts(parsed(spark, sf_dir).withColumn("html", html), "favicon").select("page_id", "favicon")


@query("page_detail_marks", f"""
    select o_orderkey as page_id, case {_KIND} when '1' then 'query h1_title date_place day author' when '2' then 'query board_parameter title_link' when '4' then 'article_type' else '' end as marks,
      {_KIND} in ('1', '2') as is_post from orders""")
def page_detail_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for one post on each page, and whether that is enough: posts, lists by paging, by their address, by their entries."""
    forms = {"1": ("https://a.kr/x?y=a{k}", "<h1>Order {k}</h1><span class='reg-date'>{d}</span><p class=writer>c{c}</p>"),
             "2": ("https://a.kr/bbs/view.do?nttId={k}", "<h3 class=title><a href='#'>Order</a></h3><div class=paging-box></div>"),
             "3": ("https://a.kr/bbs/view.do?page=2&q={s}", "<h1>Order {k}</h1><span class=date>{d}</span>"),
             "4": ("https://a.kr/{k}", "<meta property='og:type' content='Article'><h1>Abc</h1><ul class=board_list><li><a>1</a></li><li>y</li><li>x</li></ul>"),
             "5": ("https://a.kr/x?id={k}", "<h1>Order {k}</h1><table><tbody><tr><td>{d}</td></tr><tr><td><a>2</a></td></tr><tr><td>{d}</td></tr></tbody></table>")}
    kind = F.substring("o_orderpriority", 1, 1)
    part = lambda n: F.coalesce(*[F.when(kind == k, _filled(form[n])) for k, form in forms.items()])
    made = orders(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), part(0).alias("url"), part(1).alias("html"))
    return H.facts(made, "marks").select("page_id", F.array_join("marks", " ").alias("marks"), (F.size("marks") >= LEAST_MARKS).alias("is_post"))
