"""Queries for decisions about files and links, fingerprints, time stamps and table chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import dates as D
from gristmill.functions import urls as U
from gristmill.plans.registry import query
from gristmill.sources.tables import spread, table

# Fixed values that decide about files and links.
STRUCTURED_EXTENSIONS = [".pdf", ".ppt", ".pptx", ".doc", ".docx"]
TABLE_EXTENSIONS = [".pdf", ".ppt", ".pptx"]
LEAST_CHARS = 300
GENERIC_NAMES = ["", "file", "download", "attachment", "첨부", "첨부파일", "다운로드", "붙임"]
CLEAR_WORDS = ["계획", "공고", "고시", "안내", "신청", "서식", "붙임", "첨부", "결과", "보고", "자료", "교육", "모집", "채용", "사업"]
DOCUMENT_ENDING = r"(?i)\.(pdf|hwp|hwpx|doc|docx|ppt|pptx|xls|xlsx|csv)($|[?#])"
#: Tables of more rows are cut into chunks of so many, and have their first rows as header.
WHOLE_TABLE, TABLE_CHUNK, HEADER_ROWS = 10, 20, 5


@query("workflow_fingerprints", """
    with u as (select l_orderkey, lower(split_part('HTTPS://Shop.example/part/' || l_partkey || '#' || l_linenumber, '#', 1)) as url from lineitem),
    p as (select l_orderkey, count(*) as n, '["' || array_to_string(list_sort(list(distinct url)), '","') || '"]' as urls from u group by 1)
    select l_orderkey, sha1('{"chat_bot_id":"' || l_orderkey || '","count":' || n || ',"db_name":"orders","end_date":"","start_date":"","urls":' || urls
      || ',"use_query_links_only":false,"workflow":"order"}') as fingerprint from p""")
def workflow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-1 of each workflow's payload as JSON with sorted keys; a workflow is an order, its start addresses are its parts."""
    start = F.concat(F.lit("HTTPS://Shop.example/part/"), "l_partkey", F.lit("#"), "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lower(F.trim(F.substring_index(start, "#", 1))).alias("url"))
    found = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("url")).alias("urls"))
    payload = F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("chat_bot_id"), "count", F.lit("orders").alias("db_name"), F.lit("").alias("end_date"),
        F.lit("").alias("start_date"), "urls", F.lit(False).alias("use_query_links_only"), F.lit("order").alias("workflow")))
    return found.select("l_orderkey", F.sha1(payload).alias("fingerprint"))


@query("metadata_timestamps", """
    select event_id, case event_id % 9 when 6 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 7 then strftime(ts, '%Y-%m-%d %H:00:00') when 8 then strftime(ts, '%Y-%m-%d %H:%M:00') when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M:00') when 2 then strftime(ts, '%Y-%m-%d 00:00:00')
      when 3 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 4 then 'at ' || strftime(ts, '%H:%M') || ' of 2024-13-41' when 5 then '' end as formatted from events""")
def metadata_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps of metadata in one format, from the several in which they come."""
    form = lambda pattern: F.date_format("ts", pattern)
    kind = F.col("event_id") % 9
    said = (F.when(kind == 6, form("yyyyMMdd'T'HHmmss")).when(kind == 7, F.concat(form("yyyy-MM-dd'T'HH"), F.lit("+09:00"))).when(kind == 8, F.concat(form("yyyyMMdd'T'HHmm"), F.lit("Z"))).when(kind == 0, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(kind == 1, form("yyyy.M.d H:m"))
            .when(kind == 2, F.concat(F.lit("on "), form("yyyy/M/d"))).when(kind == 3, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
            .when(kind == 4, F.concat(F.lit("at "), form("HH:mm"), F.lit(" of 2024-13-41"))))
    return spread(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id").select("event_id", D.metadata_timestamp(said).alias("formatted"))


def wants_structured_fallback(path: Column, text: Column, has_tables: Column) -> Column:
    """Whether a document's plain text is too short, or it has tables that plain text loses."""
    ending = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    short = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) < LEAST_CHARS
    return F.coalesce(ending.isin(STRUCTURED_EXTENSIONS) & (short | (ending.isin(TABLE_EXTENSIONS) & has_tables)), F.lit(False))


@query("structured_fallback", """
    with d as (select doc_id, case when doc_id % 3 = 0 then repeat(chr(10) || chr(9), 400) || left(text, 200) || chr(160) else text end as text from documents)
    select doc_id, doc_id % 4 <> 2 and (coalesce(length(regexp_replace(text, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')), 0) < 300 or (doc_id % 4 <> 1 and contains(text, '|'))) as fallback from d""")
def structured_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a structured conversion should replace; their kinds go round by id."""
    ending = F.element_at(F.array(*map(F.lit, [".pdf", ".DOCX", ".txt", ".pptx"])), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit("files/v1.2/"), "doc_id", ending)
    padded = F.concat(F.repeat(F.lit("\n\t"), 400), F.substring("text", 1, 200), F.lit("\u00a0"))  # many line ends and little text
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, padded).otherwise(F.col("text")))
    tables = F.coalesce(F.contains("text", F.lit("|")), F.lit(False))
    return docs.select("doc_id", wants_structured_fallback(path, F.col("text"), tables).alias("fallback"))


def is_ambiguous(name: Column, href: Column) -> Column:
    """Whether a link's name and address leave open if it is a document: short or generic names, no document's ending, or no clear word."""
    name, href = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(href, F.lit("")))
    low = F.lower(href)
    known = F.contains(low, F.lit("ne.go.kr/component/file/nd_filedownload.do")) | (
        F.contains(low, F.lit("nd_filedownload.do")) & F.contains(low, F.lit("q_filesn=")) & F.contains(low, F.lit("q_fileid=")))
    generic = F.lower(F.regexp_replace(name, r"\s+", "")).isin(GENERIC_NAMES)
    ends = name.rlike(DOCUMENT_ENDING) | href.rlike(DOCUMENT_ENDING)
    clear = name.rlike("|".join(CLEAR_WORDS))
    return ~known & (generic | (F.length(name) <= 4) | ~ends | (~clear & (F.length(name) < 14)))


@query("ambiguous_links", """
    with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as t from pages),
    c as (select page_id, unnest(range(0, len(h)))::int as place, unnest(h) as href, trim(unnest(t)) as name from l
      union all select page_id, -1, url || '.pdf', trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) from pages
      union all select page_id, -2, '/get?no=1', ['계획', '공고', '고시', '안내', '신청', '서식', '붙임', '첨부', '결과', '보고', '자료', '교육', '모집', '채용', '사업', '없는말'][page_id % 16 + 1] || ' a.hwp' from pages)
    select page_id, place, case when place = -2 then page_id % 16 = 15 else lower(regexp_replace(name, '\\s+', '', 'g')) in ('', 'file', 'download', 'attachment') or length(name) <= 4 or length(name) < 14
      or not regexp_matches(name || ' ' || href, '(?i)\\.(pdf|hwp|hwpx|doc|docx|ppt|pptx|xls|xlsx|csv)( |$|[?#])') end as ambiguous from c""")
def ambiguous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, and each page as a document by its title, with whether they are ambiguous."""
    pages = table(spark, sf_dir, "pages")
    part = lambda k: F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    links = pages.select("page_id", F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("name"))).alias("place", "l")).select(
        "page_id", "place", "l.href", "l.name")
    whole = pages.select("page_id", F.lit(-1).alias("place"), F.concat("url", F.lit(".pdf")).alias("href"),
                         F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    words = F.array(*map(F.lit, [*CLEAR_WORDS, "없는말"]))
    worded = pages.select("page_id", F.lit(-2).alias("place"), F.lit("/get?no=1").alias("href"),
                          F.concat(F.element_at(words, (F.col("page_id") % F.size(words) + 1).cast("int")), F.lit(" a.hwp")).alias("name"))
    return links.union(whole).union(worded).select("page_id", "place", is_ambiguous(F.col("name"), F.col("href")).alias("ambiguous"))


@query("table_chunks", """
    with r as (select o_custkey, o_orderkey || ' | ' || o_orderstatus as said, row_number() over w as r, count(*) over (partition by o_custkey) as n from orders
      window w as (partition by o_custkey order by o_orderkey)),
    h as (select o_custkey, string_agg(said, chr(10) order by r) as header from r where n > 10 and r <= 5 group by 1)
    select o_custkey, (case when n > 10 then (r - 1) // 20 else 0 end)::int as chunk_no, count(*) as n_rows, any_value(header) as header, md5(string_agg(said, chr(10) order by r)) as body_md5
    from r left join h using (o_custkey) group by 1, 2""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables (the orders of a customer) whole, or from eleven rows on in chunks under a header of five rows."""
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat_ws(" | ", "o_orderkey", "o_orderstatus").alias("said"), place.alias("r"),
                                                 F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("n"))
    chunk = F.when(F.col("n") > WHOLE_TABLE, F.floor((F.col("r") - 1) / TABLE_CHUNK)).otherwise(0).cast("int")
    chunks = rows.groupBy("o_custkey", "n", chunk.alias("chunk_no")).agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("r", "said"))).alias("b"))
    # the first chunk is longer than the header
    header = F.first(F.array_join(F.slice("b.said", 1, HEADER_ROWS), "\n")).over(W.partitionBy("o_custkey").orderBy("chunk_no"))
    return chunks.select("o_custkey", "chunk_no", "n_rows", F.when(F.col("n") > WHOLE_TABLE, header).alias("header"), F.md5(F.array_join("b.said", "\n")).alias("body_md5"))
