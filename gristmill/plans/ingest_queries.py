"""Queries over crawl rows, attachments and boards that Spark derives from the tables."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import attachments as A
from gristmill.functions import chunks as C
from gristmill.functions import urls as U
from gristmill.functions.columns import is_blank
from gristmill.operators.ordering import with_place
from gristmill.plans.registry import query
from gristmill.plans.sql import CRAWL_KEY, HOST
from gristmill.sources.tables import appended_stage, spread, table


def exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of an exploration table."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("bot"), F.col("o_custkey") % 5).alias("chat_bot_id"),
        F.when(F.col("o_orderstatus") == "F", "post").when(F.col("o_orderstatus") == "O", " ").otherwise("page").alias("type"),
        F.when(F.col("o_orderpriority").startswith("1"), "Delete ").otherwise("done").alias("study_status"),
        F.when(F.col("o_orderpriority").startswith("2"), "duplicate").alias("merge_status"),
        (F.col("o_totalprice") > 1000).cast("int").alias("is_active"), F.col("o_orderdate").alias("created_at"))


@query("exploration_conditions", """
    select chat_bot_id, count(*) as n, min(id) as first_id from (select o_orderkey as id, 'bot' || (o_custkey % 5)::varchar as chat_bot_id, * from orders)
    where o_orderstatus in ('F', 'O') and o_orderpriority not like '1%' and o_orderpriority not like '2%' and o_totalprice > 1000 and o_orderdate >= timestamp '1994-01-01' group by 1""")
def exploration_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post rows that are wanted: not deleted, no duplicate, active, of a date on."""
    e = exploration(spark, sf_dir)
    wanted = ((F.col("type") == "post") | is_blank("type")) & (F.lower(F.trim(F.coalesce("study_status", F.lit("")))) != "delete") & (
        F.lower(F.coalesce("merge_status", F.lit(""))) != "duplicate") & (F.coalesce("is_active", F.lit(0)) == 1) & (F.col("created_at") >= "1994-01-01")
    return e.where(wanted).groupBy("chat_bot_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("board_scope", """
    select event_id, case when k > 90 then k % 3 = 1 when k > 50 then user_id % 5 = 1 else k % 4 = 3 end as same from (select *, (props->>'$.k')::int as k from events)""")
def board_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether links belong to a board, by board parameter, board path or menu number."""
    k = F.get_json_object("props", "$.k").cast("int")
    url = (F.when(k > 90, F.concat(F.lit("https://a.kr/x?bbsId=B"), k % 3)).when(k > 50, F.concat(F.lit("http://www.a.kr/bbs/b"), F.col("user_id") % 5, F.lit("/view.do")))
           .otherwise(F.concat(F.lit("https://a.kr/p.do?menuNo="), k % 4)))
    base = F.lit("https://www.a.kr/bbs/b1/list.do?menuNo=3")
    return table(spark, sf_dir, "events").select("event_id", A.same_board(base, url).alias("same"))


@query("attachment_keys", """
    select key, count(*) as n from (select case when l_returnflag = 'R' then 'https://a.kr/cmm/fms/FileDown.do?atchFileId=F' || l_partkey::varchar || '&fileSn=' || l_linenumber::varchar
      else 'https://a.kr/download/x?id=' || l_suppkey::varchar end as key from lineitem) group by key""")
def attachment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("https://www.a.kr/portal/file/down.do?menuNo=3&atchFileId=F"), F.col("l_partkey"), F.lit("&fileSn="), F.col("l_linenumber"))).otherwise(
        F.concat(F.lit("https://a.kr/web/download/x?id="), F.col("l_suppkey"), F.lit("&mid=a&pageSize=9#top")))
    counted = table(spark, sf_dir, "lineitem").groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n"))  # each address is taken apart once
    return spread(counted, "url").groupBy(A.attachment_key("url").alias("key")).agg(F.sum("n").alias("n"))


@query("file_identity_groups", """
    select lower(p_brand) as stem, 'hwp' as ext, p_size::bigint as size, count(*) as n, min(p_partkey) as keep from part group by all""")
def file_identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the same stem, kind and size, hwpx as hwp."""
    name = F.concat(F.lit("dir/"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ".hwp").otherwise(".HWPX"))
    rows = table(spark, sf_dir, "part").select("p_partkey", A.file_identity(name, "p_size", hwpx_as_hwp=True).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("keep")).select("k.*", "n", "keep")


@query("delete_candidates", """
    select l_orderkey, l_partkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc) as r from lineitem) where r > 1""")
def delete_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the most recent file of a name, by a recency of several parts."""
    recency = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]
    number = F.row_number().over(W.partitionBy("l_partkey").orderBy(*recency))
    return table(spark, sf_dir, "lineitem").withColumn("r", number).where("r > 1").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("placeholder_titles", """
    select page_id, title = '' or lower(title) in ('error', 'err', '404', '500') as placeholder from (select page_id, coalesce(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') as title from pages)""")
def placeholder_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", A.is_placeholder_title(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("placeholder"))


@query("url_parameter_dates", "select o_orderkey, case when o_orderstatus <> 'P' then o_orderdate::date end as day from orders")
def url_parameter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://a.kr/list.do?x=1&reqYmd="), F.when(F.col("o_orderstatus") == "P", "20249999").otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    value = A.parameter(url, ["reqymd"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(value.rlike("^[0-9]{8}$"), F.try_to_date(value, "yyyyMMdd")).alias("day"))


@query("scored_duplicate_rule", f"""
    select page_id, row_number() over (partition by {CRAWL_KEY} order by page_id) > 1 as duplicate from pages""")
def scored_duplicate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by raw or canonical URL, the first of each stays; other scores never reach the threshold."""
    keyed = table(spark, sf_dir, "pages").select("page_id", U.canonical_crawl_url("url").alias("key"))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"))
    return keyed.join(first, "key").select("page_id", (F.col("page_id") != F.col("first")).alias("duplicate"))


@query("smoothed_progress", """
    select user_id, event_id, (case when k - p <= 0 then k else p + least(greatest(1, floor((k - p) * 0.25)::int), 50, k - p) end)::int as shown from (
      select *, coalesce(lag(k) over (partition by user_id order by event_id), 0) as p from (select user_id, event_id, (props->>'$.k')::int as k from events))""")
def smoothed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    previous = F.coalesce(F.lag("k").over(W.partitionBy("user_id").orderBy("event_id")), F.lit(0))
    return rows.withColumn("p", previous).select("user_id", "event_id", A.smoothed(F.col("p"), F.col("k")).alias("shown"))


@query("category_by_source_pages", f"""
    with p as (select regexp_replace({CRAWL_KEY}, '^https?://', '') as key, min(regexp_extract(url, '/([a-z][a-z])/', 1)) as cate from pages where starts_with(url, 'https:') group by 1)
    select page_id, case when p.cate is null then 'none' else p.cate end as cate1 from (select page_id, regexp_replace({CRAWL_KEY}, '^https?://', '') as key from pages where starts_with(url, 'http:')) h
    left join p using (key)""")
def category_by_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of http rows filled from https rows of the same page."""
    keyed = table(spark, sf_dir, "pages").select("page_id", "url", U.without_scheme(U.canonical_crawl_url("url")).alias("key"))
    source = keyed.where(F.col("url").startswith("https:")).groupBy("key").agg(F.min(F.regexp_extract("url", "/([a-z][a-z])/", 1)).alias("cate"))
    rows = keyed.where(F.col("url").startswith("http:")).join(source, "key", "left")
    return rows.select("page_id", F.when(is_blank("cate"), "none").otherwise(F.col("cate")).alias("cate1"))


@query("file_exists_probe", f"""
    select page_id, ({CRAWL_KEY} in (select {CRAWL_KEY} from pages where starts_with(url, 'https:')) or url in (select url from pages where starts_with(url, 'https:'))) as known from pages""")
def file_exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the raw or the canonical URL of a row is in the catalog."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.canonical_crawl_url("url").alias("key"))
    catalog = rows.where(F.col("url").startswith("https:")).select(F.explode(F.array("url", "key")).alias("candidate")).distinct()
    probes = rows.select("page_id", F.explode(F.array_distinct(F.array("url", "key"))).alias("candidate"))
    hits = probes.join(catalog, "candidate", "left_semi").select("page_id").distinct().withColumn("known", F.lit(True))
    return rows.select("page_id").join(hits, "page_id", "left").select("page_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("article_domain_count", "select count(*) as n from pages where contains(url, 'blog.') or contains(url, '.example.org')")
def article_domain_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").contains("blog.") | F.col("url").contains(".example.org")).agg(F.count(F.lit(1)).alias("n"))


@query("unique_saved_files", """
    select l_returnflag as stage, count(distinct case when l_linestatus = 'O' then 'p' || l_partkey::varchar else 'u' || l_suppkey::varchar end) as files, sum(l_linenumber)::bigint as counter from lineitem group by 1""")
def unique_saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files of each stage, by path where there is one, else by URL; and a counter that only adds."""
    path = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("p"), F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(
        F.countDistinct(F.coalesce(path, F.concat(F.lit("u"), F.col("l_suppkey")))).alias("files"), F.sum("l_linenumber").alias("counter"))


@query("best_title_scores", """
    select flat, title, score from (select lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '', 'g')) as flat, p_type || ' ' || p_partkey::varchar as title, p_size as score,
      row_number() over (partition by lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '', 'g')) order by p_size desc, p_partkey) as r from part) where r = 1 order by score desc, flat limit 20""")
def best_title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored of candidates with one flat text, the top twenty."""
    rows = table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "")).alias("flat"), F.concat_ws(" ", "p_type", "p_partkey").alias("title"), F.col("p_size").alias("score"), "p_partkey")
    best = rows.groupBy("flat").agg(F.max_by(F.struct("title", "score"), F.struct("score", -F.col("p_partkey"))).alias("b"))
    return best.select("flat", "b.*").orderBy(F.desc("score"), "flat").limit(20)


@query("seeded_start_order", """
    select page_id, row_number() over (order by page_id) - 1 as forward, row_number() over (order by page_id desc) - 1 as reverse,
      row_number() over (order by md5('7:' || page_id::varchar), page_id) - 1 as shuffled from pages""")
def seeded_start_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each start URL forwards, backwards and in a seeded shuffle."""
    key = F.md5(F.concat(F.lit("7:"), F.col("page_id").cast("string")))
    rows = with_place(table(spark, sf_dir, "pages").select("page_id"), "forward", F.col("page_id"))
    n = rows.count()
    return with_place(rows.withColumn("reverse", n - 1 - F.col("forward")).withColumn("_key", key), "shuffled", F.col("_key"), F.col("page_id")).drop("_key")


@query("priority_lanes", f"""
    select page_id, row_number() over (partition by {HOST} order by contains(url, '?') desc, page_id)::int as place from pages""")
def priority_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a query before others of their host."""
    order = W.partitionBy("host").orderBy(F.desc("first"), "page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", U.host("url").alias("host"), F.col("url").contains("?").alias("first"))
    return rows.select("page_id", F.row_number().over(order).alias("place"))


@query("missing_parameter_reasons", """
    select reason, count(*) as n from (select case when contains(url, '.html') then null when not contains(url, 'page=') then 'missing page' when not contains(url, 'ref=') then 'missing ref' end as reason from pages) group by 1""")
def missing_parameter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required parameter a URL lacks, by rules on its path."""
    has = lambda name: A.parameter("url", [name]).isNotNull()
    reason = F.when(U.extension("url") == "html", None).when(~has("page"), "missing page").when(~has("ref"), "missing ref")
    return table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("stage_append", """
    select event_type as url, min(event_id) filter (where user_id < 75) is not null as from_old, coalesce(min(event_id) filter (where user_id < 75), min(event_id)) as ord from events group by 1""")
def stage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stage with new ones appended, the first of each URL kept."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("url"), F.col("event_id").alias("ord"), (F.col("user_id") < 75).alias("from_old"))
    return appended_stage(rows.where("from_old"), rows.where("not from_old")).select("url", "from_old", "ord")


@query("sitemap_lines", f"""
    select {HOST} as host, count(*) as n, md5(string_agg('- ' || url, chr(10) order by url, page_id)) as body_md5 from pages group by 1""")
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a sitemap for each host."""
    rows = table(spark, sf_dir, "pages").groupBy(U.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("url", "page_id"))).alias("p"))
    return rows.select("host", "n", F.md5(F.array_join(F.transform("p.url", lambda u: F.concat(F.lit("- "), u)), "\n")).alias("body_md5"))


@query("fuzzy_category_titles")
def fuzzy_category_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types that nearly equal the first type of their brand, by matching blocks."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower("p_type").alias("title"))
    first = parts.groupBy("p_brand").agg(F.min("title").alias("category"))
    joined = parts.join(first, "p_brand")
    return joined.withColumn("ratio", F.round(ratio("title", "category"), 4)).where("ratio >= 0.92").select("p_partkey", "title", "category", "ratio")


@query("footers_cut", r"""
    select doc_id, length(t)::int as n_kept, t <> text as cut from (select doc_id, text, regexp_replace(text, '(?is)(^|\n)[^\n]*(license|copyright|all rights)[^\n]*.*$', '') as t from documents)""")
def footers_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts up to the first line that tells of rights."""
    kept = F.regexp_replace("text", r"(?is)(^|\n)[^\n]*(license|copyright|all rights)[^\n]*.*$", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(kept).alias("n_kept"), (kept != F.col("text")).alias("cut"))


@query("attached_texts", """
    with t as (select o_custkey as c, l_partkey as part, min(o_orderkey) as first_id from orders join lineitem on l_orderkey = o_orderkey group by all)
    select c_custkey, md5(coalesce(string_agg(part::varchar, chr(10) order by first_id, part), '')) as joined_md5, count(part) as n from customer left join t on c = c_custkey group by 1""")
def attached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of each file row, in the order in which they came first."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    texts = lines.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("first_id"))
    joined = texts.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("first_id", "l_partkey"))).alias("t"))
    rows = table(spark, sf_dir, "customer").join(joined, F.col("c_custkey") == F.col("o_custkey"), "left")
    said = F.coalesce(F.array_join(F.transform("t.l_partkey", lambda x: x.cast("string")), "\n"), F.lit(""))
    return rows.select("c_custkey", F.md5(said).alias("joined_md5"), F.coalesce(F.size(F.col("t")), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("updated_and_deleted", """
    select o_orderkey, case when o_orderstatus = 'O' and o_orderpriority like '3%' then 'done' else o_orderstatus end as state from orders where not (o_orderstatus = 'F' and o_totalprice < 5000)""")
def updated_and_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an update and a delete by conditions."""
    rows = table(spark, sf_dir, "orders").where(~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 5000)))
    state = F.when((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("3"), "done").otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", state.alias("state"))


@query("segment_chunks")
def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation gathered to chunks like segments of a transcript."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, k, c) for i, texts in zip(batch["conv_id"], batch["texts"], strict=True) for k, c in enumerate(C.segment_chunks(list(texts)))]
            yield pd.DataFrame(out, columns=["conv_id", "chunk_no", "chunk"])

    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.col("t.text").alias("texts")).mapInPandas(cut, "conv_id long, chunk_no int, chunk string")


@query("flush_batches", """
    select user_id, batch, count(*) as n, min(event_id) as first_event from (select user_id, event_id, ((row_number() over (partition by user_id order by event_id) - 1) // 20)::int as batch from events) group by all""")
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in batches of twenty."""
    number = F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1) / 20).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", number.alias("batch"))
    return rows.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("callbacks_once", """
    select user_id as batch_id, min(event_id) as event_id from events where event_type = 'purchase' and user_id not in (select user_id from events where event_type = 'signup' and value > 90) group by 1""")
def callbacks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first callback of each batch that wasn't cancelled."""
    events = table(spark, sf_dir, "events")
    cancelled = events.where("event_type = 'signup' and value > 90").select("user_id").distinct()
    done = events.where("event_type = 'purchase'").join(cancelled, "user_id", "left_anti")
    return done.groupBy(F.col("user_id").alias("batch_id")).agg(F.min("event_id").alias("event_id"))


@query("query_token_lists", """
    select user_id, array_to_string(list_sort(list_distinct(list(event_type || '=' || ((props->>'$.k')::int % 10)::varchar))), '&') as tokens from events group by 1""")
def query_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of each rule."""
    token = F.concat_ws("=", "event_type", F.get_json_object("props", "$.k").cast("int") % 10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(token)), "&").alias("tokens"))


@query("list_page_urls", """
    select page_id, n, case when contains(url, 'page=2') then regexp_replace(url, 'page=2', 'page=' || n::varchar)
      else regexp_replace(url, '#.*$', '') || case when contains(url, '?') then '&' else '?' end || 'page=' || n::varchar end as next_url from pages, (select unnest([3, 4])::int as n)""")
def list_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third and fourth page of each list."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.lit(3), F.lit(4))).alias("n"))
    return rows.select("page_id", "n", A.page_url(F.col("url"), F.col("n")).alias("next_url"))


#: Forms of scripts that a link may hold, with what each downloads; {u} is a user, {e} an event.
SCRIPT_FORMS = [
    ("javascript:downloadFile('/attach/{u} a.pdf', 'name', 'pdf');", "https://a.kr/attach/{u}%20a.pdf"),
    ("javascript:fn_egov_downFile('F{u}', '{e}')", "https://a.kr/cmm/fms/FileDown.do?atchFileId=F{u}&fileSn={e}"),
    ("cfBrctFileDownload('BRCT','{u} 1')", "https://a.kr/nsbms/comn/fileMng/fileDownload.do?bizDvCd=BRCT&fileNo=0&fileSeq={u}%201"),
    ("cfComnFileDownload('B', '{u}', '{e}')", "https://a.kr/nsbms/comn/fileMng/fileDownload.do?bizDvCd=B&fileNo={u}&fileSeq={e}"),
    ("javascript:goDownload('n{u}.hwp','s{e}.hwp','/data/f')", "https://a.kr/emwp/jsp/ofr/FileDownNew.jsp?user_file_nm=n{u}.hwp&sys_file_nm=s{e}.hwp&file_path=/data/f"),
    ("javascript:downItem('12^o{u}.hwp^{e}.hwp^2018')",
     "https://a.kr/fileDownload.do?fileGubun=BBS&gubun=BBS&fileSize=12&orgfilename=o{u}.hwp&fileName={e}.hwp&filePath=2018&type="),
    ("fileDown('FILE_{u}', '{e}', 'B1'); return false;", "https://a.kr/common/cmm/fms/FileDown.do?atchFileId=FILE_{u}&fileSn={e}&bbsId=B1"),
    ("location.href = '/download/{u}.do?fileId={e}'", "https://a.kr/download/{u}.do?fileId={e}"),
    ("javascript:go(check('x'), \"/bbs/file/{u}.hwp\")", "https://a.kr/bbs/file/{u}.hwp"),
    ("javascript:fileDown('{e}')", ""), ("javascript:void(0)", ""), ("alert('a.pdf')", ""), ("files/{u}.pdf", ""), ("./files/{u}.pdf", "https://a.kr/b/files/{u}.pdf"),
]


def _script_cases(which: int) -> str:
    return " ".join(f"when {k} then '" + form[which].replace("'", "''").replace("{u}", "' || user_id::varchar || '").replace("{e}", "' || event_id::varchar || '") + "'"
                    for k, form in enumerate(SCRIPT_FORMS))


@query("script_links", f"select event_id, case event_id % {len(SCRIPT_FORMS)} {_script_cases(1)} end as target from events")
def script_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripts of links download, each form of call in turn."""
    script = F.coalesce(*[F.when(F.col("event_id") % len(SCRIPT_FORMS) == k, F.replace(F.replace(F.lit(form), F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{e}"), F.col("event_id").cast("string")))
                          for k, (form, _) in enumerate(SCRIPT_FORMS)])
    return table(spark, sf_dir, "events").select("event_id", A.script_download_of(script, F.lit("https://a.kr/b/c.do")).alias("target"))
