"""Queries for the upkeep of what was collected: files to delete, maps by domain, metadata, boards and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import attachments as A
from gristmill.functions import texts as X
from gristmill.functions import urls as U
from gristmill.operators import merges as M
from gristmill.plans.registry import query
from gristmill.plans.sql import HOST, unescaped
from gristmill.sources.tables import spread, table


def _each(values: list[str | None], key: str) -> F.Column:
    """One of some values, by a number, in turn."""
    return F.coalesce(*[F.when(F.col(key) % len(values) == k, F.lit(v)) for k, v in enumerate(values)])


def _each_sql(values: list[object], key: str) -> str:
    said = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {said(v)}" for k, v in enumerate(values)) + " end"


@query("delete_candidate_groups", """
    with f as (select l_orderkey * 10 + l_linenumber as id, l_shipdate as at, l_quantity as idx, 'http://a.kr/f/' || (l_partkey % 500) || '.hwp' as url,
        case when l_suppkey % 7 = 0 then '' else 'name ' || l_suppkey end as name, case when l_linenumber % 2 = 0 then 'hwp' else 'pdf' end as extension from lineitem),
    m as (select *, unnest(['url', 'name', 'url_name']) as mode from f),
    k as (select *, case mode when 'url' then 'url:' || url when 'name' then 'name:' || name || '|ext:' || extension else 'url:' || url || '|name:' || name || '|ext:' || extension end as key from m)
    select mode, key, count(*) as n, arg_max(id, struct_pack(a := "at", b := idx, c := url, d := id)) as keep from k group by 1, 2 having count(*) > 1""")
def delete_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that repeat by address, by name, and by both, with the most recent of each group, which stays."""
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber")
    files = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("idx"),
        F.concat(F.lit("http://WWW.a.kr/f/"), (F.col("l_partkey") % 500).cast("string"), F.lit(".hwp#x")).alias("url"),
        F.when(F.col("l_suppkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" Name  "), F.col("l_suppkey").cast("string"))).alias("name"),
        F.when(F.col("l_linenumber") % 2 == 0, "HWP").otherwise("pdf").alias("extension"))
    files = files.withColumn("url", U.canonical_dedup_url("url"))
    url, name, ext = F.col("url"), F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))), F.lower(F.trim("extension"))
    keys = {"url": F.concat(F.lit("url:"), url), "name": F.concat(F.lit("name:"), name, F.lit("|ext:"), ext),
            "url_name": F.concat(F.lit("url:"), url, F.lit("|name:"), name, F.lit("|ext:"), ext)}
    moded = files.select("id", F.struct("at", "idx", "url", "id").alias("recency"),
                         F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), k.alias("key")) for m, k in keys.items()])).alias("k"))
    named = moded.where(~F.col("k.key").isin("url:", "name:|ext:", "url:|name:|ext:"))
    return named.groupBy("k.mode", "k.key").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "recency").alias("keep")).where("n > 1")


@query("domain_file_maps", f"""
    with f as (select {HOST} as host, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*\\.([A-Za-z0-9]{{1,5}})$', 1)), ''), 'unknown') as kind from pages),
    c as (select host, kind, count(*) as n from f group by 1, 2)
    select host, sum(n)::bigint as n, string_agg(kind || '=' || n, ',' order by kind) as kinds from c group by 1""")
def domain_file_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each host, with a map of how many there are of each kind."""
    kind = U.extension("url")
    counts = table(spark, sf_dir, "pages").groupBy(U.host("url").alias("host"), F.when(kind == "", "unknown").otherwise(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("host").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("map"))
    return maps.select("host", "n", F.array_join(F.transform(F.map_entries("map"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kinds"))


_POSTS = ["https://a.kr/BBS/View.do?page=2&nttId=1&bbsId=B1&menuNo=5", "https://a.kr/b/read.php?id=7", "https://a.kr/b/detail.jsp?menu_cd=M%201&x=1", "https://a.kr/b/brdDetail.do?seq=1&y=2",
          "https://a.kr/b/list.do?x=1", "https://a.kr/plain", "https://a.kr/b/view.asp"]
_BOARDS = ["https://a.kr/bbs/list.do?bbsId=B1&menuNo=5", "https://a.kr/b/list.php", "https://a.kr/b/list.jsp?menu_cd=M+1", "https://a.kr/b/brdlist.do", None, None, "https://a.kr/b/list.asp"]


@query("parent_board_urls", f"select event_id, {_each_sql(_BOARDS, 'event_id')} as parent from events")
def parent_board_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that the address of each post leads to; null where it is a list itself, or none can be told."""
    return table(spark, sf_dir, "events").select("event_id", U.parent_board(_each(_POSTS, "event_id")).alias("parent"))


@query("sitemap_queries", f"""
    with p as (select page_id, coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '') || '&z=&utm_term=1&a=' || page_id || '&z=b c' as q from pages)
    select page_id, array_to_string(list_sort([replace(x, ' ', '+') for x in string_split(q, '&') if x <> '' and split_part(x, '=', 1) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content')]), '&') as canonical from p""")
def sitemap_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as a site's map compares them: sorted, without campaigns, blank values kept."""
    q = F.concat(U.query("url"), F.lit("&z=&utm_term=1&a="), F.col("page_id").cast("string"), F.lit("&z=b%20c"))
    return table(spark, sf_dir, "pages").select("page_id", U.sitemap_query(q).alias("canonical"))


@query("metadata_aliases", """
    select o_orderkey, case o_orderkey % 4 when 0 then 'create_at=x,name=n' when 1 then 'created_at=' || o_orderstatus || ',name=n' when 2 then 'created_at=old,name=n' else 'created_at=' || o_orderstatus || ',create_at= ,name=n' end as meta from orders""")
def metadata_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with what it lacks: an entry is there if it has a value under any of its names."""
    said = F.create_map(F.lit("name"), F.lit("n"))
    old = (F.when(F.col("o_orderkey") % 4 == 0, F.map_concat(said, F.create_map(F.lit("create_at"), F.lit("x")))).when(F.col("o_orderkey") % 4 == 1, said)
           .when(F.col("o_orderkey") % 4 == 2, F.map_concat(said, F.create_map(F.lit("created_at"), F.lit("old")))).otherwise(F.map_concat(said, F.create_map(F.lit("create_at"), F.lit(" ")))))
    patched = M.patched_metadata(old, F.create_map(F.lit("created_at"), F.col("o_orderstatus"), F.lit("name"), F.lit("other")), {"created_at": ["create_at"]})
    entries = F.transform(F.array_sort(F.map_entries(patched)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    order = F.sort_array(F.transform(entries, lambda e: F.struct((~e.startswith("created_at")).alias("last"), e.alias("said"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(order, lambda x: x["said"]), ",").alias("meta"))


@query("chunk_metadata", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'file' else 'post' end as category, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as created,
      case when o_orderkey % 5 > 0 then o_orderpriority end as extra, coalesce(case when o_orderkey % 7 = 0 then 'weekly' end, '1_day') as frequency from orders""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of chunks: only what has a value, defaults, the day of the content before that of its row."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "file").otherwise("post")
    base = F.create_map(F.lit("content_created_at"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" "),
                        F.lit("update_frequency"), F.when(F.col("o_orderkey") % 7 == 0, "weekly"), F.lit("extra"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")))
    meta = M.chunk_metadata(base, kind, F.lit("https://a.kr/"), F.lit(3), F.lit(100))
    return table(spark, sf_dir, "orders").select("o_orderkey", meta["source_category"].alias("category"), meta["created_at"].alias("created"), meta["extra"].alias("extra"), meta["update_frequency"].alias("frequency"))


@query("url_query_modes", """
    select page_id, mode, contains(url, '?') as has_query from pages, (select unnest(['Q', 'P', 'B', ' ', 'p']) as mode)
    where case upper(trim(mode)) when 'Q' then contains(url, '?') when 'P' then not contains(url, '?') else true end""")
def url_query_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a query, those without, and both, as a mode asks."""
    modes = F.explode(F.array(*map(F.lit, ["Q", "P", "B", " ", "p"])))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", modes.alias("mode"))
    has = U.query("url") != ""
    asked = F.upper(F.trim("mode"))
    return rows.where(F.when(asked == "Q", has).when(asked == "P", ~has).otherwise(True)).select("page_id", "mode", has.alias("has_query"))


@query("urls_of_domain", f"select page_id, {HOST} as host from pages where {HOST} = 'example.net' or {HOST} like '%.example.net'")
def urls_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a domain and the hosts below it."""
    return table(spark, sf_dir, "pages").where(U.of_domain("url", "Example.net")).select("page_id", U.host("url").alias("host"))


@query("literal_contains", """
    select p_partkey, contains(p_name || ' 5%_off!', '5%_o') as with_marks, contains(p_name || ' 5xyoff', '5%_o') as without from part""")
def literal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a part as it is written; marks of patterns mean nothing."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.holds(F.concat("p_name", F.lit(" 5%_off!")), "5%_o").alias("with_marks"), X.holds(F.concat("p_name", F.lit(" 5xyoff")), "5%_o").alias("without"))


@query("unescaped_titles", f"""
    select page_id, trim(regexp_replace(replace({unescaped("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, chr(160), ' ') || ' <' || page_id || '> é', '\\s+', ' ', 'g')) as title from pages""")
def unescaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages with their entities as characters and their white space squeezed."""
    said = F.concat(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("&nbsp;&#32;&lt;"), F.col("page_id").cast("string"), F.lit("&gt;&nbsp; &eacute;\n"))
    return table(spark, sf_dir, "pages").select("page_id", X.unescaped(said).alias("title"))


_NAMES = ["plan.HWP [29.0 KB]", "a.zip (3 MB)", "x.pdf", "y.tar.7z", "photo.JPEG", "noextension", "memo.docx download", "b.hwpx;c.png", "v1.2 sheet.xlsx [1,024 bytes]", "art.ai", None]
_ENDS = ["hwp", "zip", "pdf", "7z", "jpeg", "", "docx", "hwpx", "xlsx", "ai", None]
_MEDIA = ["application/octet-stream", "IMAGE/png", "application/zip", None, "video/mp4", "application/postscript", "text/plain"]
_DOCUMENT = ["hwp", "hwpx", "pdf", "doc", "docx", "ppt", "pptx", "txt", "csv", "xlsx", "xls"]


@query("attachment_blocks", f"""
    with f as (select event_id, {_each_sql(_ENDS, 'event_id')} as ext, event_id % 7 as m from events)
    select event_id, ext as extension, (ext <> '' and not list_contains({_DOCUMENT!r}, ext)) or m in (1, 2, 4, 5) as blocked from f where ext is not null""")
def attachment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of files by their names, and which of them are surely no documents, by name or content type."""
    name, media = _each(_NAMES, "event_id"), _each(_MEDIA, "event_id")
    rows = table(spark, sf_dir, "events").withColumns({"_name": name, "_media": media}).where("_name is not null")
    return rows.select("event_id", A.known_extension("_name").alias("extension"), A.is_blocked(F.col("_name"), F.col("_media")).alias("blocked"))


_WIKI = ["https://w.kr/index.php?title=A&action=edit", "https://w.kr/w/load.php?x=1", "https://w.kr/wiki/A?x=action", "https://w.kr/A?oldid=5", "https://w.kr/a?do=DIFF", "https://w.kr/w/opensearch_desc.php",
         "https://w.kr/resources/x.css", "https://w.kr/wiki/edit", "https://w.kr/x?undo=edit", None]
_WIKI_KINDS = ["edit", "resource", "page", "edit", "edit", "resource", "resource", "page", "page", "page"]


@query("wiki_page_kinds", f"select event_id, {_each_sql(_WIKI_KINDS, 'event_id')} as kind from events")
def wiki_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses of a wiki are pages, and which edit them or are parts of them."""
    return table(spark, sf_dir, "events").select("event_id", A.wiki_page_kind(_each(_WIKI, "event_id")).alias("kind"))


_OCR = ["OCR returned 404", "the ocr step FAILED", "OCR API down", "failed", "ocr 1500 pages", "ocr: error 503.", "An OCR exception", "ocr done", "", None]
_OCR_REASONS = ["ocr_status_404", "ocr_failed", "ocr_api_failed", None, None, "ocr_status_503", "ocr_failed", None, None, None]


@query("ocr_failures", f"select event_id, {_each_sql(_OCR_REASONS, 'event_id')} as reason from events")
def ocr_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why texts are messages of failed calls, if they are."""
    return table(spark, sf_dir, "events").select("event_id", A.ocr_failure(_each(_OCR, "event_id")).alias("reason"))


_FILES = ["보고서 (최종).hwp [29.0 KB]", "a b_c-d.PDF", "x (3 MB).zip", "?*<>", "", "r/é|ü:.txt (1,024 bytes)", "가나다라마바사아자차카타파하.hwpx", "n.averyveryverylongending", "1.2 GB"]
_SAFE = ["보고서 최종.hwp", "a b_c-d.PDF", "x.zip", "downloaded_file", "downloaded_file", "réü.txt", "가나다라마바사아자차카타파하.hwpx", "n.averyveryverylongending", "downloaded_file"]
_SHORT = ["보고서 최종.hwp", "a b_c-d.PDF", "x.zip", "downloaded_file", "downloaded_file", "réü.txt", "가나다라마.hwpx", "n.averyveryverylongen", "downloaded_file"]


@query("safe_file_names", f"select event_id, {_each_sql(_SAFE, 'event_id')} as safe, {_each_sql(_SHORT, 'event_id')} as short from events")
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files as they are stored: without sizes and signs, of 21 bytes at most."""
    safe = A.safe_name(_each(_FILES, "event_id"))
    return table(spark, sf_dir, "events").select("event_id", safe.alias("safe"), A.name_within(safe, 21).alias("short"))
