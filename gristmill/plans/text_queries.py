"""Queries over document texts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import chunks as C
from gristmill.functions import dates as D
from gristmill.functions import texts as X
from gristmill.operators.duplicates import contained_blocks_dropped, duplicate_rows, first_by
from gristmill.plans.registry import query
from gristmill.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_CHUNKS = """
    from (select *, case when length(text) = 0 then 0 when length(text) <= 1000 then 1 else ceil((length(text) - 50) / 950)::int end as n_chunks from documents)"""


@query("fixed_chunks", f"""
    select doc_id, (k)::int as chunk_no, substring(text, (k * 950 + 1)::int, 1000) as chunk from (select *, unnest(range(0, n_chunks)) as k {_CHUNKS})""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(C.fixed_chunks("text")).alias("chunk_no", "chunk"))


@query("chunk_counts", f"select source, lang, count(*) as docs, sum(n_chunks)::bigint as chunks, max(n_chunks)::int as most {_CHUNKS} group by source, lang")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = documents(spark, sf_dir).select("source", "lang", F.size(C.fixed_chunks("text")).alias("n"))
    return counted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chunks"), F.max("n").alias("most"))


@query("envelope_chunks", """
    with e as (select doc_id, 'Title: ' || source || chr(10) || chr(10) || 'Content: ' || trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from documents),
    n as (select *, case when length(t) <= 1000 then 1 else ceil((length(t) - 50) / 950)::int end as n_chunks from e)
    select doc_id, n_chunks::int as n_chunks, length(t)::int as n_chars, md5(substring(t, 1, 1000)) as first_md5 from n""")
def envelope_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = documents(spark, sf_dir).select("doc_id", C.envelope("source", "text").alias("t"))
    cut = C.fixed_chunks("t")
    return whole.select("doc_id", F.size(cut).alias("n_chunks"), F.length("t").alias("n_chars"), F.md5(F.get(cut, F.lit(0))).alias("first_md5"))


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded_semantic_chunks(documents(spark, sf_dir), "doc_id", "text")


@query("sanitize_text", r"""
    select doc_id, md5(regexp_replace(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) as clean_md5,
      md5(lower(regexp_replace(text, '[^\pL\pM\pN]+', '', 'g'))) as flat_md5, octet_length(encode(text))::int as n_bytes from documents""")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(X.clean_utf8(X.without_emoji("text"))).alias("clean_md5"),
                                           F.md5(F.lower(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}]+", ""))).alias("flat_md5"),
                                           F.octet_length("text").alias("n_bytes"))


@query("text_flags", r"""
    select doc_id, regexp_matches(text, '(^|[^0-9])[0-9]{6}\s*[-－‐‑‒–—]\s*[0-9]{7}([^0-9]|$)') as rrn,
      length(regexp_replace(text, '\s', '', 'g')) >= 10 as has_body,
      len(regexp_extract_all(text, '(?m)^#{1,3}\s+\S')) >= 1 or len(regexp_extract_all(text, '(?m)^[ \t\r]*\|.+\|[ \t\r]*$')) >= 2
        or len(regexp_extract_all(text, '(?m)^[ \t\r]*(?:[-*+]|[0-9]+[.)])\s+\S')) >= 3 as markdown,
      false as cid from documents""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.has_rrn("text").alias("rrn"), X.has_body("text").alias("has_body"),
                                           X.looks_like_markdown("text").alias("markdown"), X.is_cid_text("text").alias("cid"))


@query("rrn_masked_documents", r"""
    select source, count(*) as docs, count(*) filter (where regexp_matches(text, '(^|[^0-9])[0-9]{6}\s*[-－‐‑‒–—]\s*[0-9]{7}([^0-9]|$)')) as blocked from documents group by source""")
def rrn_masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = documents(spark, sf_dir).select("source", X.mask_rrn("text").contains("[RRN_MASKED]").alias("hit"))
    return masked.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("hit").alias("blocked"))


@query("text_snippets", r"""
    with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as t from documents)
    select doc_id, case when length(t) <= 200 then t else regexp_replace(substring(t, 1, 200), '\s+\S*$', '') || '...' end as snippet from t""")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.snippet("text").alias("snippet"))


@query("masked_terms", """
    select doc_id, md5(replace(replace(text, 'clown', '***'), 'stupid', '***')) as masked_md5,
      ((length(text) - length(replace(text, 'clown', ''))) // 5 + (length(text) - length(replace(text, 'stupid', ''))) // 6)::bigint as n_masked from documents""")
def masked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, count = X.masked_terms("text", ["clown", "stupid"])
    return documents(spark, sf_dir).select("doc_id", F.md5(text).alias("masked_md5"), count.alias("n_masked"))


@query("file_identity", "select doc_id, sha256(source || lang || n_chars::varchar) as file_key, sha256(text) as content_hash from documents")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.unique_key("source", "lang", "n_chars").alias("file_key"), X.hashed("text").alias("content_hash"))


@query("byte_bounded_titles", """
    select doc_id, list_max([n for n in range(0, least(60, length(text)) + 1) if octet_length(encode(substring(text, 1, n::int))) <= 60])::int as n_kept from documents""")
def byte_bounded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.length(X.trimmed_to_bytes("text", 60)).alias("n_kept"))


@query("exact_duplicate_documents", """
    with g as (select md5(text) as key, min(doc_id) as keep from documents group by 1 having count(*) > 1)
    select key, doc_id, keep from (select md5(text) as key, doc_id from documents) join g using (key) where doc_id <> keep""")
def exact_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(documents(spark, sf_dir).select("doc_id", F.md5("text").alias("key")), "key", "doc_id")


@query("keep_oldest_document", "select md5(text) as key, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by 1")
def keep_oldest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(documents(spark, sf_dir).select(F.md5("text").alias("key"), "doc_id", "source"), ["key"], F.col("doc_id"))


@query("keep_newest_document", """
    select key, doc_id, source from (select md5(text) as key, doc_id, source, row_number() over (partition by md5(text) order by n_chars desc, source desc, doc_id desc) as r
    from documents) where r = 1""")
def keep_newest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent by a key of several parts: largest size, source and id."""
    rows = documents(spark, sf_dir).select(F.md5("text").alias("key"), "doc_id", "source", "n_chars")
    return rows.groupBy("key").agg(F.max_by(F.struct("doc_id", "source"), F.struct("n_chars", "source", "doc_id")).alias("r")).select("key", "r.*")


@query("contained_lines_dropped")
def contained_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = contained_blocks_dropped(F.split("text", "\n"))
    return documents(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


@query("parsed_dates", """
    select o_orderkey, date_trunc('day', o_orderdate)::timestamp as parsed from orders""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in a form for each priority, and read again."""
    form = F.element_at(F.array(*[F.date_format("o_orderdate", p) for p in ("yyyyMMdd", "yyyy.M.d", "yyyy/MM/dd", "yyyy년 M월 d일", "yy-M-d")]),
                        F.ascii("o_orderpriority") % 5 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(form).alias("parsed"))


@query("latest_date_in_text", """
    select o_orderkey, case when o_orderdate < timestamp '1998-01-01' then o_orderdate::date else date '1997-01-02' end as latest from orders""")
def latest_date_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date that is not in the future, among a date of 1902, the order's and 1997-01-02."""
    now = F.to_timestamp(F.lit("1997-12-31"))
    text = F.concat(F.lit("since 1902-03-04, on "), F.date_format("o_orderdate", "yyyy. M. d"), F.lit(" or "),
                    F.when(F.col("o_orderdate") < "1998-01-01", "1902/5/6").otherwise("1997년 1월 2일"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.latest_date(text, now).alias("latest"))


@query("text_dates", """
    select o_orderkey, case o_orderkey % 8 when 0 then o_orderdate::date::timestamp when 1 then greatest(o_orderdate::date, date '1995-02-03')::timestamp when 2 then o_orderdate::date::timestamp
      when 3 then make_date(year(o_orderdate), 1, 1)::timestamp when 4 then timestamp '2003-01-01 10:00:00' - to_hours(3) when 5 then make_date(1998, 1, 1)::timestamp when 6 then null
      else timestamp '2002-12-31' end as at from orders""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that names of files speak of."""
    form = lambda pattern: F.date_format("o_orderdate", pattern)
    forms = [F.concat(F.lit("plan_"), form("yyyyMMdd"), F.lit("_v2.hwp")), F.concat(form("yyyy.M.d"), F.lit(" and 1995-2-3, not 2004-01-01 or 1995.13.1")), F.concat(F.lit("x"), form("yyyy년 M월d일")),
             F.concat(form("yyyy"), F.lit(" report 2001")), F.lit("3시간 전"), F.lit("a1998 1998 (2003)"), F.lit("no 12345678901 v19981"), F.lit("어제")]
    name = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.text_date(name, F.to_timestamp(F.lit("2003-01-01 10:00:00"))).alias("at"))


@query("relative_dates", """
    select event_id, case event_type when 'signup' then timestamp '2024-03-01 12:00:00' when 'error' then timestamp '2024-03-01 00:00:00' when 'click' then timestamp '2024-02-29 00:00:00'
      when 'view' then timestamp '2024-03-01 12:00:00' - to_hours((event_id % 20)::int) else timestamp '2024-03-01 00:00:00' - to_days((event_id % 20)::int) end as at from events""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 20).cast("string")
    said = (F.when(F.col("event_type") == "signup", "방금 전").when(F.col("event_type") == "error", "오늘").when(F.col("event_type") == "click", "어제")
            .when(F.col("event_type") == "view", F.concat(number, F.lit("시간 전"))).otherwise(F.concat(number, F.lit("일 전"))))
    return table(spark, sf_dir, "events").select("event_id", D.relative_date(said, F.to_timestamp(F.lit("2024-03-01 12:00:00"))).alias("at"))


@query("date_range_filter", """
    select o_orderkey from orders where o_orderdate::date between date '1995-01-01' and date '1996-06-30'""")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(D.in_range("o_orderdate", "1995-01-01", "1996-06-30")).select("o_orderkey")


@query("date_text_range_filter", """
    select o_orderkey from orders where o_orderdate::date between date '1995-01-01' and date '1996-06-30'""")
def date_text_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(D.text_in_range(F.date_format("o_orderdate", "yyyy.MM.dd HH:mm"), "1995-01-01", "1996-06-30")).select("o_orderkey")


@query("office_hour_events", """
    select event_type, count(*) filter (where isodow(ts + interval 9 hour) <= 5 and hour(ts + interval 9 hour) between 9 and 17) as in_hours, count(*) as n from events group by 1""")
def office_hour_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(D.is_office_hour("ts")).alias("in_hours"), F.count(F.lit(1)).alias("n"))
