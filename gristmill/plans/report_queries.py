"""Queries for reports, standard fields and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import fields as S
from gristmill.functions import urls as U
from gristmill.operators.merges import patched_metadata
from gristmill.plans.registry import query
from gristmill.plans.sql import CRAWL_KEY
from gristmill.sources.tables import limited, table


@query("page_menu_links", """
    with n as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav from pages),
    l as (select page_id, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) as t from n)
    select page_id, unnest(range(0, len(h)))::int as place, unnest(h) as href, unnest(t) as title from l""")
def page_menu_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a page's menu, in order."""
    nav = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1).alias("nav"))
    part = lambda k: F.regexp_extract_all("nav", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    links = nav.select("page_id", F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("title"))).alias("place", "l"))
    return links.select("page_id", "place", "l.href", "l.title")


@query("menu_title_counts", """
    with l as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">([^<]*)</a>', 2)) as title from pages)
    select title, count(*) as n, count(distinct page_id) as pages from l group by 1 having count(*) > 1""")
def menu_title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu titles that occur more than once."""
    return page_menu_links(spark, sf_dir).groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages")).where("n > 1")


@query("auto_stop", """
    select event_id, so_far > 30 or spent > 1000 as stopped from (select event_id, count(*) over w as so_far, coalesce(sum(round(value * 100)::bigint) over w, 0) / 100 as spent from events
      window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))""")
def auto_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a user come after a count or a sum has passed its limit."""
    so_far = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum(F.round(F.col("value") * 100).cast("long")).over(so_far) / 100
    return table(spark, sf_dir, "events").select("event_id", ((F.count(F.lit(1)).over(so_far) > 30) | (F.coalesce(spent, F.lit(0)) > 1000)).alias("stopped"))


@query("limited_with_flag", """
    select c_custkey, (select count(*) from customer) > 100 as truncated from (select c_custkey from customer order by c_custkey limit 100)""")
def limited_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows, with whether there are more."""
    return limited(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, most=500)


@query("standard_fields", """
    select o_orderkey, case when o_orderstatus = 'F' then 'Kim' when o_orderstatus = 'O' then '' else 'Lee' end as author,
      case when o_totalprice > 5000 then 'O' else 'X' end as attached, strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def standard_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author, attachment mark and day in their standard forms."""
    author = F.when(F.col("o_orderstatus") == "F", "작성자 : Kim").when(F.col("o_orderstatus") == "O", " - ").otherwise("writer: Lee ")
    attached = F.when(F.col("o_totalprice") > 5000, "첨부파일 2").otherwise("없음")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.author(author).alias("author"), S.attached(attached).alias("attached"),
                                                 S.day(F.date_format("o_orderdate", "yyyy.M.d")).alias("day"))


@query("cleaned_titles", """
    select p_partkey, p_name as title from part""")
def cleaned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose tail of labels and dates is cut."""
    tail = F.when(F.col("p_size") > 25, "  등록일 2024-01-02 조회수 17").when(F.col("p_size") > 10, " 2024.05.06").otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", S.title(F.concat("p_name", tail)).alias("title"))


@query("normalized_rules", """
    select n_nationkey, case when n_regionkey = 0 then 'a=1|b=2' when n_regionkey = 1 then 'c=3' else 'k=' || n_nationkey::varchar end as tokens from nation""")
def normalized_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule tokens from JSON that is a list, a text with bars, or one token."""
    said = (F.when(F.col("n_regionkey") == 0, '["a=1", "b=2", "a=1", " "]').when(F.col("n_regionkey") == 1, '"c=3"')
            .otherwise(F.concat(F.lit('" k='), F.col("n_nationkey"), F.lit(' | "'))))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(S.rule_tokens(said), "|").alias("tokens"))


@query("chunk_counts_by_source", """
    select (props->>'$.k')::int % 7 as k, event_type as subject, count(*) as chunks from events group by all""")
def chunk_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a field of their metadata and their subject."""
    k = F.get_json_object("props", "$.k").cast("int") % 7
    return table(spark, sf_dir, "events").groupBy(k.alias("k"), F.col("event_type").alias("subject")).agg(F.count(F.lit(1)).alias("chunks"))


@query("metadata_repair", f"""
    with c as (select {CRAWL_KEY} as key, max(page_id) as page, min(regexp_extract(url, '/([a-z][a-z])/', 1)) as lang from pages group by 1)
    select page_id, 'lang=' || lang || ',page=' || page::varchar || case when page_id % 2 = 0 then ',url=own' else '' end as meta
    from (select page_id, {CRAWL_KEY} as key from pages) p join c using (key)""")
def metadata_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk metadata with the missing entries of the catalog row of the same page."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.canonical_crawl_url("url").alias("key"))
    catalog = rows.groupBy("key").agg(F.max("page_id").alias("page"), F.min(F.regexp_extract("url", "/([a-z][a-z])/", 1)).alias("lang"))
    joined = rows.join(catalog, "key")
    old = F.create_map(F.lit("url"), F.when(F.col("page_id") % 2 == 0, "own").otherwise(""))
    new = F.create_map(F.lit("page"), F.col("page").cast("string"), F.lit("lang"), F.col("lang"))
    entries = F.array_sort(F.transform(F.map_entries(patched_metadata(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return joined.select("page_id", F.array_join(entries, ",").alias("meta"))
