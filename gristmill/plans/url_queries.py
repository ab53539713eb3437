"""Queries over the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import urls as U
from gristmill.functions.urls import DEDUP_PAGE_KEYS, DEDUP_VOLATILE_KEYS, TRACKING_KEYS
from gristmill.operators.components import connected_rows
from gristmill.operators.duplicates import duplicate_groups, duplicate_rows, start_reasons, unknown_starts
from gristmill.operators.patterns import frequent_tokens, seed_groups, suggested_rules
from gristmill.operators.rules import categorized, holds_any, matching_any
from gristmill.plans.registry import query
from gristmill.plans.sql import BARE, CRAWL_KEY, DEDUP_KEY, HOST, PATH, QUERY, pairs, segments
from gristmill.sources.tables import spread, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query("url_canonical_key", f"""
    select page_id, {CRAWL_KEY} as crawl_key, {DEDUP_KEY} as dedup_key, regexp_replace({CRAWL_KEY}, '^https?://', '') as bare_key
    from pages""")
def url_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = U.canonical_crawl_url("url")
    return pages(spark, sf_dir).select("page_id", crawl.alias("crawl_key"), U.canonical_dedup_url("url").alias("dedup_key"),
                                       U.without_scheme(crawl).alias("bare_key"))


@query("url_duplicate_groups", f"""
    with k as (select page_id, {CRAWL_KEY} as key from pages)
    select key, count(*) as n, min(page_id) as keep, array_to_string(list_sort(list(page_id))[2:], ',') as rest
    from k where key <> '' group by key having count(*) > 1""")
def url_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = pages(spark, sf_dir).select("page_id", U.canonical_crawl_url("url").alias("key"))
    groups = duplicate_groups(keyed, "key", "page_id")
    return groups.select("key", "n", "keep", F.array_join(F.transform("rest", lambda x: x.cast("string")), ",").alias("rest"))


@query("url_duplicate_rows", f"""
    with k as (select page_id, {DEDUP_KEY} as key from pages),
    g as (select key, min(page_id) as keep from k group by key having count(*) > 1)
    select key, page_id, keep from k join g using (key) where page_id <> keep""")
def url_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = pages(spark, sf_dir).select("page_id", U.canonical_dedup_url("url").alias("key"))
    return duplicate_rows(keyed, "key", "page_id")


@query("url_duplicate_summary", f"""
    with g as (select {CRAWL_KEY} as key, count(*) as n from pages group by 1 having count(*) > 1)
    select count(*) as group_count, coalesce(sum(n), 0)::bigint as duplicate_row_count,
           (coalesce(sum(n), 0) - count(*))::bigint as extra_duplicate_count from g""")
def url_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pages(spark, sf_dir).groupBy(U.canonical_crawl_url("url").alias("key")).count().where("count > 1")
    total = F.coalesce(F.sum("count"), F.lit(0)).cast("long")
    return counts.agg(F.count(F.lit(1)).alias("group_count"), total.alias("duplicate_row_count"),
                      (total - F.count(F.lit(1))).alias("extra_duplicate_count"))


_STRUCTURE = f"""regexp_replace(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {BARE} || '/' ||
    array_to_string([case when regexp_full_match(s, '[0-9]+') then '{{num}}' else s end for s in {segments(f'lower({PATH})')}], '/'), '/+$', '')"""


@query("url_structure_groups", f"""
    with k as (select page_id, {CRAWL_KEY} as url from pages)
    select {_STRUCTURE} as structure, count(*) as n, min(page_id) as first_page, contains({_STRUCTURE}, '{{num}}') as has_variable
    from k group by 1""")
def url_structure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = pages(spark, sf_dir).select("page_id", U.canonical_crawl_url("url").alias("key"))
    keyed = keyed.select("page_id", U.structure_of(F.col("key")).alias("structure"))
    return keyed.groupBy("structure").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).withColumn(
        "has_variable", F.col("structure").contains("{num}"))


_TEMPLATE = (f"'/' || array_to_string([case when regexp_full_match(lower(s), '[0-9]+|[0-9a-f]{{8,}}|[0-9a-f-]{{16,}}') "
             f"then ':var' else lower(s) end for s in {segments(PATH)}], '/')")


@query("url_pattern_analysis", f"""
    with k as (select page_id, {HOST} || '|' || {_TEMPLATE} || '|' || case when contains(url, 'utm_source=feed') then 'utm_source=feed'
                 when contains(url, 'ref=x') then 'ref=x' else '' end as signature, {segments(PATH)} as words from pages),
    g as (select signature, count(*) as n, min(page_id) as sample from k group by 1 having count(*) >= 2),
    t as (select signature, word, count(*) as times from (select signature, unnest(list_distinct(words)) as word from k) group by all)
    select g.signature, g.n, g.sample,
      coalesce(string_agg(word, ',' order by word) filter (where times >= greatest(1, n // 2)), '') as frequent
    from g left join t on g.signature = t.signature group by all""")
def url_pattern_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of two pages or more, with the path parts that at least half of them have."""
    keyed = pages(spark, sf_dir).select("page_id", U.pattern_signature("url").alias("signature"), F.filter(
        F.split(U.path("url"), "/"), lambda s: s != "").alias("words"))
    groups = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("sample")).where("n >= 2")
    words = keyed.select("signature", F.explode(F.array_distinct("words")).alias("word")).groupBy("signature", "word").agg(
        F.count(F.lit(1)).alias("times"))
    frequent = F.collect_list(F.when(F.col("times") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("word")))
    return groups.join(words, "signature", "left").groupBy("signature", "n", "sample").agg(
        F.array_join(F.array_sort(frequent), ",").alias("frequent"))


_TOP = f"array_to_string(list_reverse(list_reverse(string_split({HOST}, '.'))[1:2]), '.')"


_BOARD_WORDS = ["board", "bbs", "notice", "ntt", "list", "view", "article", "portal", "news", "announcement", "gosi", "gonggo"]


@query("url_seed_groups", f"""
    with p as (select page_id, url, lower(url) as low, {_TOP} as domain, {_TEMPLATE} as template, case when contains(url, 'utm_source=feed') then 'utm_source=feed'
        when contains(url, 'ref=x') then 'ref=x' else '' end as query_signature, {HOST} as host, len({segments(PATH)}) as depth, case when page_id % 3 = 0 then ' ' else 'b' || page_id % 2 end as bot from pages),
    s as (select *, {' + '.join(f"2 * contains(low, '{w}')::int" for w in _BOARD_WORDS)} + 3 * (contains(low, 'board') or contains(low, 'list.do'))::int as score from p)
    select domain, template, query_signature, count(*) as n, count(distinct host) as hosts, count(distinct nullif(trim(bot), '')) as bots,
      case when count(distinct nullif(trim(bot), '')) = 1 then min(nullif(trim(bot), '')) end as only_bot,
      arg_max(url, struct_pack(a := score, b := -depth, c := -length(url), d := page_id)) as representative from s group by 1, 2, 3""")
def url_seed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages by domain, path template and stable parameters; each page belongs to a bot, or to none."""
    bot = F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("b"), (F.col("page_id") % 2).cast("string")))
    return seed_groups(pages(spark, sf_dir).withColumn("bot", bot), "page_id", "url", "bot")


@query("url_scope_filter", f"select page_id, url from pages where regexp_matches(url, '^https?://(www\\.)?spam-farm\\.example\\.org/en/')")
def url_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(U.in_scope("url", "www.spam-farm.example.org", "/en/"))


@query("url_scope_prefix", f"""
    select page_id, case when len({segments(PATH)}) = 0 or (len({segments(PATH)}) = 1 and contains({segments(PATH)}[1], '.')) then '/'
      else '/' || {segments(PATH)}[1] || '/' end as prefix,
      regexp_extract(case when {PATH} = '' then '/' else {PATH} end, '^(.*/)', 1) as directory from pages""")
def url_scope_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.scope_prefix("url").alias("prefix"), U.directory("url").alias("directory"))


@query("url_class_flags", f"""
    select page_id, {QUERY} <> '' as has_query, false as is_list, false as is_detail,
      regexp_matches(lower(url), '\\.({'|'.join(U.DOWNLOAD_EXTENSIONS)})$') or contains(lower(url), 'file') or contains(lower(url), 'download') as downloadable,
      coalesce(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*\\.([A-Za-z0-9]{{1,5}})$', 1)), '') as extension
    from pages""")
def url_class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(
        "page_id", U.passes_query_filter("url", "Q").alias("has_query"), U.is_list_page("url").alias("is_list"),
        U.is_detail_page("url").alias("is_detail"), U.is_downloadable("url").alias("downloadable"),
        U.extension("url").alias("extension"))


@query("url_query_pair_filter", "select page_id from pages where regexp_matches(url, '[?&]utm_source=feed(&|#|$)')")
def url_query_pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(F.col("url").rlike("[?&]utm_source=feed(&|#|$)")).select("page_id")


@query("host_stats", f"""
    select {HOST} as host, coalesce(nullif(lower(regexp_extract(url, '\\.([A-Za-z0-9]{{1,5}})$', 1)), ''), 'unknown') as kind, count(*) as n,
      count(*) filter (where starts_with(url, 'https')) as n_secure from (select regexp_replace(url, '[?#].*$', '') as url from pages) group by 1, 2""")
def host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = U.extension("url")
    rows = pages(spark, sf_dir).withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    return rows.groupBy(U.host("url").alias("host"), F.when(kind == "", "unknown").otherwise(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").startswith("https")).alias("n_secure"))


@query("distinct_domains", f"select distinct {BARE} as domain from pages")
def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(U.bare_host("url").alias("domain")).distinct()


_PLAIN_HOST = f"regexp_replace({HOST}, '^www\\.', '')"
_TOKENS = f"""array_to_string(list_sort(list_distinct([x for x in list_concat([{_PLAIN_HOST}, lower(coalesce({segments(PATH)}[-1], ''))],
      {pairs(QUERY, [*DEDUP_PAGE_KEYS, *TRACKING_KEYS, *DEDUP_VOLATILE_KEYS])}) if x <> ''])), '|')"""


@query("url_tokens", f"select page_id, {_TOKENS} as tokens from pages")
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.tokens("url").alias("tokens"))


@query("url_board_score", """
    select page_id, (2 * (contains(u, 'board')::int + contains(u, 'bbs')::int + contains(u, 'notice')::int + contains(u, 'ntt')::int
      + contains(u, 'list')::int + contains(u, 'view')::int + contains(u, 'article')::int + contains(u, 'portal')::int + contains(u, 'news')::int
      + contains(u, 'announcement')::int + contains(u, 'gosi')::int + contains(u, 'gonggo')::int) + 3 * contains(u, 'board')::int)::int as score
    from (select page_id, lower(url) as u from pages)""")
def url_board_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.board_score("url").alias("score"))


@query("url_normalized", f"""
    select page_id, {HOST} as host, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://)[^/?#]*', '\\1' || {HOST}) as normalized from pages""")
def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.host("url").alias("host"), U.normalized_url("url").alias("normalized"))


@query("start_url_anti_join", f"""
    with k as (select page_id, url, regexp_replace({CRAWL_KEY}, '^https?://', '') as key from pages),
    s as (select key, min(page_id) as page_id from k where starts_with(url, 'http:') group by key)
    select s.page_id, s.key from s where s.key not in (select key from k where starts_with(url, 'https:'))""")
def start_url_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain http start URLs that are not known under https, each key once."""
    keyed = pages(spark, sf_dir).select("page_id", U.scheme("url").alias("scheme"),
                                        U.without_scheme(U.canonical_crawl_url("url")).alias("key"))
    starts = keyed.where("scheme = 'http'").select("page_id", "key")
    return unknown_starts(starts, keyed.where("scheme = 'https'"), "key", "page_id")


def order_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, url): addresses of articles by seven patterns; those of the first pattern, half of all rows, share one id."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")  # few bytes, but each address is taken apart
    kind = F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.floor(F.col("o_orderkey") / 2) % 6 + 1)
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")

    def said(*parts: object) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    forms = [said("http://www.a.kr/p/", key, "?id=1&x=", key), said("https://b.kr/bbs/view.do?nttId=c", customer, "&bbsId=b1&page=", key),
             said("https://b.kr/x/", key, ".html?nttid=c", customer, "&docId=d", customer), said("http://other.kr/q.php?docid=d", customer, "&utm_source=q"),
             said("https://한국.kr/site/BD_selectBbs.do?q_bbsCode=1&q_bbscttSn=", customer, "&q_currPage=", key),
             said("https://한국.kr/else/BD_selectBeffatInfoOtHbcBbs.do?q_bbscttSn=", customer, "&q_bbsCode=1"), said("https://c.kr/alone/", key)]
    return orders.select("o_orderkey", F.coalesce(*[F.when(kind == k, form) for k, form in enumerate(forms)]).alias("url"))


_KINDS = "with o as (select o_orderkey as k, o_custkey as c, case when o_orderkey % 2 = 0 then 0 else (o_orderkey // 2) % 6 + 1 end as kind from orders)"


@query("url_identity", f"""{_KINDS},
    t as (select k, c, kind, case kind when 0 then ['/p/' || k, k::varchar, 'id=1', 'x=' || k] when 1 then ['nttid=c' || c, 'bbsid=b1']
        when 2 then ['/x/' || k || '.html', k || '.html', 'nttid=c' || c, 'docid=d' || c]
        when 3 then ['/q.php', 'q.php', 'docid=d' || c] when 4 then ['q_bbscode=1', 'q_bbscttsn=' || c] when 5 then ['q_bbscttsn=' || c, 'q_bbscode=1']
        else ['/alone/' || k, k::varchar] end as terms from o)
    select k as o_orderkey, case kind when 0 then 'http://a.kr/p/' || k || '?id=1&x=' || k when 1 then 'https://b.kr/bbs/view.do?bbsid=b1&nttid=c' || c
      when 2 then 'https://b.kr/x/' || k || '.html?docid=d' || c || '&nttid=c' || c when 3 then 'http://other.kr/q.php?docid=d' || c
      when 6 then 'https://c.kr/alone/' || k else 'https://xn--3e0b707e.kr/__bbs_detail__/BD_selectBbs.do?q_bbscode=1&q_bbscttsn=' || c end as canonical,
      array_to_string([x for x in terms if length(x) >= case when contains(x, '=') then 4 else 3 end], ' ') as terms from t""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each address, and the parts that addresses of the same document are likely to hold."""
    return order_urls(spark, sf_dir).select("o_orderkey", U.canonical_dedup_url("url").alias("canonical"), F.array_join(U.candidate_terms("url"), " ").alias("terms"))


@query("url_connected", f"""{_KINDS},
    g as (select *, bool_or(kind = 2) over (partition by c) as bridged from o),
    b as (select *, bool_or(kind = 1) over (partition by c) as boarded from g),
    p as (select *, case when kind = 0 then 'id' when kind = 6 then 'k' || k when kind in (4, 5) then 'b' || c when kind = 1 or (bridged and boarded) then 'board'
      else 'd' || c end as part from b)
    select k as o_orderkey, min(k) over (partition by part) as component from p""")
def url_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest order whose address shares a key, or a chain of keys, with that of each order."""
    keyed = order_urls(spark, sf_dir).select("o_orderkey", U.dedup_keys("url").alias("keys"))
    return connected_rows(keyed, "o_orderkey", "keys").select("o_orderkey", "component")


@query("start_url_reasons", f"""
    with k as (select page_id, case when page_id % 9 = 4 then '' else regexp_replace({CRAWL_KEY}, '^https?://', '') end as key, url from pages),
    s as (select *, row_number() over (partition by key order by page_id) as r from k where starts_with(url, 'http:') or key = ''),
    m as (select case when key = '' then 'blank' when key in (select key from k where starts_with(url, 'https:')) then 'known' when r > 1 then 'repeated' else 'new' end as reason from s)
    select reason, count(*) as n from m group by 1""")
def start_url_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many start URLs are new, and why the others aren't taken; those without a key pass."""
    keyed = pages(spark, sf_dir).select("page_id", "url", F.when(F.col("page_id") % 9 == 4, "").otherwise(U.without_scheme(U.canonical_crawl_url("url"))).alias("key"))
    starts = keyed.where(F.col("url").startswith("http:") | (F.col("key") == "")).select("page_id", "key")
    return start_reasons(starts, keyed.where(F.col("url").startswith("https:")), "key", "page_id").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("post_url_plan", f"""
    with k as (select page_id, url, {CRAWL_KEY} as key from pages where not contains(url, 'spam-farm')),
    c as (select *, case when contains(lower(url), '/en/') then 'english' when contains(lower(url), 'blog.') then 'blog' end as cate1 from k),
    r as (select *, row_number() over (partition by regexp_replace(key, '^https?://', '') order by page_id) as r from c where cate1 is not null)
    select page_id, cate1, key from r where r = 1 and regexp_replace(key, '^https?://', '') not in (select regexp_replace({CRAWL_KEY}, '^https?://', '') from pages where page_id % 5 = 0)""")
def post_url_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of posts in one plan: filtered, given a category by rules, the first of each key, and not known yet."""
    rules = spark.createDataFrame([(1, "/en/", [], "english", "page"), (2, "blog.", [], "blog", "page")], "pos int, url string, query array<string>, cate1 string, cate2 string")
    given = pages(spark, sf_dir)
    known = given.where("page_id % 5 = 0").select(U.without_scheme(U.canonical_crawl_url("url")).alias("bare"))
    kept = categorized(matching_any(given, "url", [["spam-farm"]], keep=False), "url", rules).where("cate1 is not null")
    keyed = kept.select("page_id", "cate1", U.canonical_crawl_url("url").alias("key")).withColumn("bare", U.without_scheme("key"))
    return unknown_starts(keyed, known, "bare", "page_id").select("page_id", "cate1", "key")


@query("url_pattern_rules", f"""{_KINDS},
    u as (select k, c, kind, case kind when 1 then 'b.kr|/bbs/view.do|' when 3 then 'other.kr|/q.php|utm_source=q' when 4 then '한국.kr|/site/bd_selectbbs.do|q_bbscode=1&q_bbscttsn=' || c
        when 5 then '한국.kr|/else/bd_selectbeffatinfoothbcbbs.do|q_bbscode=1&q_bbscttsn=' || c when 6 then 'c.kr|/alone/:var|'
        when 0 then 'www.a.kr|/p/:var|x=' || k else 'b.kr|/x/' || k || '.html|' end as signature from o where kind <> 3 or c % 2 = 0),
    g as (select signature, any_value(kind) as kind, any_value(c) as c, count(*) as n, count(distinct k) as keys, min(k::varchar) as k1 from u group by 1),
    r as (select *, case kind when 1 then 'https://b.kr/bbs/view.do' when 3 then 'http://other.kr/q.php?utm_source=q' when 4 then 'https://한국.kr/site/BD_selectBbs.do?q_bbsCode=1&q_bbscttSn=' || c
      when 5 then 'https://한국.kr/else/BD_selectBeffatInfoOtHbcBbs.do?q_bbsCode=1&q_bbscttSn=' || c else 'https://c.kr/alone' end as rule_url,
      case kind when 3 then 'utm_source=q' when 4 then 'q_bbsCode=1 q_bbscttSn=' || c when 5 then 'q_bbsCode=1 q_bbscttSn=' || c else '' end as rule_query,
      case kind when 6 then 'constant alone, ' || case when keys = 1 then 'constant ' || k1 when keys <= 8 then 'bounded' else 'free' end when 1 then 'constant bbs, constant view.do' when 3 then 'constant q.php'
        when 4 then 'constant site, constant BD_selectBbs.do' else 'constant else, constant BD_selectBeffatInfoOtHbcBbs.do' end as positions from g where n >= 3)
    select signature, n, least(n, 8)::int as n_sample, rule_url, rule_query, positions from r union all select null, count(*), null, null, null, null from g where n < 3""")
def url_pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that groups of three addresses or more suggest; those with an odd document at other.kr are known already."""
    found = suggested_rules(order_urls(spark, sf_dir), "url", 3, [["other.kr", f"{x}&utm"] for x in (1, 3, 5, 7, 9)])
    said = F.array_join(F.transform("positions", lambda p: F.concat_ws(" ", p["kind"], F.when(p["kind"] == "constant", p["parts"][0]))), ", ")
    return found.select("signature", "n", F.when(F.col("sample").isNotNull(), F.size("sample")).alias("n_sample"), "rule_url", F.array_join("rule_query", " ").alias("rule_query"), said.alias("positions"))


@query("url_frequent_tokens", f"""
    with p as (select {HOST} || '|' || {_TEMPLATE} as signature, coalesce({segments(PATH)}[-1], '') as script, {QUERY} as q from pages),
    t as (select signature, script as token from p where regexp_matches(script, '\\.[A-Za-z0-9]{{1,6}}$') union all
      select signature, unnest([x for x in string_split(q, '&') if regexp_matches(x, '^(utm_source|ref)=.')]) from p),
    c as (select signature, token, count(*) as n from t group by 1, 2 having count(*) >= 2),
    r as (select *, row_number() over (partition by signature order by n desc, token) as r from c)
    select signature, r::int as rank, token, n from r where r <= 8""")
def url_frequent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight scripts and parameters of each path template that occur most, twice or more."""
    return frequent_tokens(pages(spark, sf_dir).select(F.concat_ws("|", U.host("url"), U.path_template("url")).alias("signature"), "url"))


@query("url_shared_keys", f"""
    with k as (select page_id, unnest(list_distinct([{DEDUP_KEY}, {_TOKENS}])) as key from pages)
    select key, count(*) as n, min(page_id) as first_page from k group by key having count(*) > 1""")
def url_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by which two pages or more count as the same."""
    return pages(spark, sf_dir).select("page_id", F.explode(U.dedup_keys("url")).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query("url_category_rules", f"""
    select page_id, case when contains(lower(url), 'spam-farm') then 'junk' when contains(lower(url), '/en/') and contains(lower(url), 'utm_source=feed') then 'feed'
      when contains(lower(url), '/en/') then 'english' when contains(lower(url), 'blog.') then 'blog' end as cate1,
      case when contains(lower(url), 'spam-farm') then 'farm' when contains(lower(url), '/en/') and contains(lower(url), 'utm_source=feed') then 'english'
      when contains(lower(url), '/en/') then 'page' end as cate2 from pages""")
def url_category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([
        (1, "blog.", [], "blog", None), (2, "spam-farm", [], "junk", "farm"), (3, "/en/", ["utm_source=feed"], "feed", "english"),
        (4, "/en/", [], "english", "page")], "pos int, url string, query array<string>, cate1 string, cate2 string")
    return categorized(pages(spark, sf_dir), "url", rules).select("page_id", "cate1", "cate2")


@query("url_pattern_filter", """
    select page_id, contains(lower(url), '.example.net') and contains(lower(url), '/de/') or contains(lower(url), 'blog.') as known from pages
    where not (contains(lower(url), 'cheap-pills') or contains(lower(url), 'spam-farm') and contains(lower(url), 'page='))""")
def url_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no refused pattern matches, with whether an accepted one does."""
    kept = matching_any(pages(spark, sf_dir), "url", [["cheap-pills"], ["spam-farm", "page="]], keep=False)
    return kept.select("page_id", holds_any(F.col("url"), [[".example.net", "/de/"], ["blog."]]).alias("known"))


@query("url_rule_index", """
    with r as (select o_orderkey as pos, case o_orderkey % 7 when 0 then '' else '/' || ['en', 'fr', 'de', 'es'][o_orderkey % 4 + 1] || '/' || (o_custkey % 1000)::varchar end as url,
      case o_orderkey % 3 when 0 then ['utm_source=feed'] when 1 then ['page=2', 'ref=' || chr(97 + (o_orderkey % 26)::int)] else [] end as query,
      'c' || o_custkey::varchar as cate1, case when o_orderkey % 5 > 0 then 's' || o_orderkey::varchar end as cate2 from orders where o_orderkey > 40),
    m as (select page_id, pos, cate1, cate2 from pages join r on contains(lower(pages.url), r.url) and len([t for t in r.query if not contains(lower(pages.url), t)]) = 0),
    b as (select page_id, arg_min(cate1, (cate2 is null, pos)) as cate1, arg_min(coalesce(cate2, ''), (cate2 is null, pos)) as cate2 from m group by page_id)
    select page_id, b.cate1, nullif(b.cate2, '') as cate2 from pages left join b using (page_id)""")
def url_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of pages by one rule for each order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    place = F.concat(F.lit("/"), F.element_at(F.array(*map(F.lit, ["EN", "fr", "de", "es"])), (key % 4 + 1).cast("int")), F.lit("/"), (customer % 1000).cast("string"))
    tokens = F.when(key % 3 == 0, F.array(F.lit("utm_source=feed"))).when(
        key % 3 == 1, F.array(F.lit("page=2"), F.concat(F.lit("ref="), F.char(97 + key % 26)))).otherwise(F.array().cast("array<string>"))
    rules = table(spark, sf_dir, "orders").where("o_orderkey > 40").select(
        key.alias("pos"), F.when(key % 7 == 0, "").otherwise(place).alias("url"), tokens.alias("query"),
        F.concat(F.lit("c"), customer.cast("string")).alias("cate1"), F.when(key % 5 > 0, F.concat(F.lit("s"), key.cast("string"))).alias("cate2"))
    return categorized(pages(spark, sf_dir), "url", rules).select("page_id", "cate1", "cate2")


@query("url_common_prefix", f"""
    with p as (select {HOST} as host, {segments(PATH)} as s from pages),
    l as (select host, min(len(s)) as least, count(*) as n from p group by host),
    d as (select p.host, i, count(distinct s[i]) as kinds, any_value(s[i]) as word, l.least from p join l on p.host = l.host,
          lateral (select unnest(range(1, l.least + 1)) as i) group by all),
    f as (select host, min(i) as stop from d where kinds > 1 group by host)
    select l.host, l.n, '/' || coalesce((select string_agg(word, '/' order by i) from d where d.host = l.host and i < coalesce(
      (select stop from f where f.host = l.host), l.least + 1)), '') as prefix from l""")
def url_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading path parts that all pages of a host share."""
    parts = pages(spark, sf_dir).select(U.host("url").alias("host"), F.filter(F.split(U.path("url"), "/"), lambda s: s != "").alias("s"))
    # of sorted lists the first and the last differ as early as any two do
    ends = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
    common = F.aggregate(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                         F.struct(F.lit(True).alias("on"), F.lit("").alias("said")),
                         lambda d, p: F.struct((d["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on"),
                                               F.when(d["on"] & F.coalesce(p["x"] == p["y"], F.lit(False)), F.concat(d["said"], F.lit("/"), p["x"])).otherwise(d["said"]).alias("said")),
                         lambda d: d["said"])
    return ends.select("host", "n", F.when(common == "", "/").otherwise(common).alias("prefix"))
