"""Queries over files and what is written: text files in several encodings, documents, JSON lines, sinks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import chunks as C
from gristmill.functions import dates as D
from gristmill.functions import texts as X
from gristmill.functions.columns import select_existing, where_if_present
from gristmill.plans.registry import query
from gristmill.sources.files import plain_texts
from gristmill.sources.tables import attachments, json_lines, table
from gristmill.streaming.stateful import shared_folder


@query("json_line_rows", "select event_id, user_id, event_type from events where event_id % 11 <> 3")
def json_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read again; lines that are cut, or no objects, are left out."""
    folder = shared_folder(spark)
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.when(F.col("event_id") % 2 == 0, F.substring(line, 1, 9)).otherwise(F.lit("[1, 2]"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 3, broken).otherwise(line).alias("value")).write.text(folder)
    return json_lines(spark, folder, "event_id long, user_id long, event_type string").where("event_id is not null")


@query("stage_attachments", """
    select 'https://a.kr/' || l_orderkey as detail_url, 'Order ' || l_orderkey as title, case when l_linenumber % 3 = 0 then '' else 'https://a.kr/f/' || l_partkey || '.HWP' end as url,
      case when l_linenumber % 2 = 0 then 'part ' || l_partkey else 'Order ' || l_orderkey end as name, case when l_linenumber % 3 = 0 then 'pdf' else 'hwp' end as extension, count(*) as n from lineitem group by all""")
def stage_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of nested records, one row each, with defaults for what is missing; an order has seven at most."""
    file = F.struct(F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("https://a.kr/f/"), F.col("l_partkey").cast("string"), F.lit(".HWP"))).alias("url"),
                    F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("name"),
                    F.when(F.col("l_linenumber") % 3 == 0, "PDF").alias("extension"), F.lit(None).cast("string").alias("queued_at"))
    details = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(file).alias("files")).select(
        F.concat(F.lit("https://a.kr/"), F.col("l_orderkey").cast("string")).alias("detail_url"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("title"), "files")
    return attachments(details).groupBy("detail_url", "title", "url", "name", "extension").agg(F.count(F.lit(1)).alias("n"))


@query("encoded_texts", """
    select doc_id, case doc_id % 5 when 4 then 'no reader for bin' end as error, case when doc_id % 5 < 4 then md5(case doc_id % 5 when 3 then '제목 ' || doc_id else text end) end as text_md5 from documents""")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read from files in UTF-8 with and without a mark, UTF-16 and CP949."""
    kind, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    said = F.concat(F.unhex(F.lit("제목 ".encode("cp949").hex())), F.col("doc_id").cast("string").cast("binary"))
    written = (F.when(kind == 3, said).when(kind == 0, text.cast("binary")).when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
               .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))))
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 4, ".bin").otherwise(".txt")).alias("path"), written.alias("content"))
    return plain_texts(files).select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("doc_id"), "error", F.md5("text").alias("text_md5"))


@query("document_texts", """
    select o_orderkey, 'Order ' || o_orderkey || chr(10) || '| Key | Status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | a\\|' || o_orderstatus || ' |' || chr(10) || 'End' as text,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as created from orders""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of word documents, tables as Markdown, with the time that they say they were made."""
    def written(keys: pd.Series, states: pd.Series, days: pd.Series) -> pd.Series:
        out = []
        for k, s, day in zip(keys, states, days, strict=True):
            p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
            row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://w"><w:body>{p(f"Order {k}")}<w:tbl>{row("Key", "Status")}{row(k, f"a|{s}")}</w:tbl>{p("")}{p("End")}</w:body></w:document>')
                z.writestr("docProps/core.xml", f'<c xmlns:dcterms="http://d"><dcterms:created>{day}</dcterms:created></c>')
            out.append(held.getvalue())
        return pd.Series(out)

    write = F.pandas_udf(written, "binary")
    files = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".docx")).alias("path"), write(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("content"))
    return plain_texts(files).select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("o_orderkey"), "text", "created")


@query("written_chunks", """
    select lang, count(*) as n, sum(length(left(text, 100)))::bigint as n_chars, sum(doc_id)::bigint as ids from documents where n_chars > 50 group by 1""")
def written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by language with the columns that there are, and read again."""
    folder = shared_folder(spark)
    rows = where_if_present(where_if_present(table(spark, sf_dir, "documents"), "n_chars", F.col("n_chars") > 50), "not_there", F.lit(False))
    kept = select_existing(rows.withColumn("text", F.substring("text", 1, 100)), ["doc_id", "lang", "text", "embedding", "content_metadata"])
    kept.write.partitionBy("lang").parquet(folder)
    return spark.read.schema("doc_id long, text string, lang string").parquet(folder).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum("doc_id").alias("ids"))


@query("created_bounds", """
    select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d 00:00:00') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M:00') end as lower,
      case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d 23:59:59') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M:00') end as upper from events""")
def created_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of times from days and times; what is neither has none."""
    form = lambda pattern: F.date_format("ts", pattern)
    said = F.element_at(F.array(form("yyyy-MM-dd"), form("yyyy-MM-dd'T'HH:mm:ss"), form(" yyyy-MM-dd HH:mm"), form("yyyy/MM/dd")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", D.created_bound(said, False).alias("lower"), D.created_bound(said, True).alias("upper"))


@query("text_bodies", """
    with t as (select doc_id, case when doc_id % 7 = 0 then 'a' || chr(10) || 'b' else coalesce(text, '') end as text from documents)
    select doc_id, md5(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) as body_md5, length(regexp_replace(text, '\\s', '', 'g')) >= 10 as has_body from t""")
def text_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines in front that describe them, and whether there is anything left."""
    text = F.when(F.col("doc_id") % 7 == 0, "a\nb").otherwise(F.coalesce("text", F.lit("")))
    body = X.body_of(F.concat(F.lit("Title: x y\nURL: https://a.kr\n"), text))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(body).alias("body_md5"), X.has_body(body).alias("has_body"))


@query("chunk_dispatch", """
    select doc_id, doc_id % 3 = 0 as by_blocks, case when doc_id % 3 = 0 then 2 when length(text) = 0 then 0 when length(text) <= 1000 then 1 else ceil((length(text) - 50) / 950)::int end as n_chunks
    from (select doc_id, coalesce(text, '') as text from documents)""")
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown is cut at its headings, other text in windows; every third text is a short one with two headings."""
    marked = F.concat(F.lit("# One\n\n"), F.substring("source", 1, 50), F.lit("\n\n## Two\n\nend"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, marked).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return C.dispatched_chunks(docs, "doc_id", "text")
