"""Queries over catalog, session and event tables: joins, aggregates, windows, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import chunks as C
from gristmill.functions import texts as X
from gristmill.functions.columns import is_blank
from gristmill.operators import history as Y
from gristmill.operators import merges as M
from gristmill.operators.duplicates import first_by, last_rows
from gristmill.plans.registry import query
from gristmill.sources.tables import page_after, query as run_query, safe_condition, table


@query("semi_join_labelled", "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(known, "doc_id", "left_semi").select("doc_id", "source")


@query("anti_join_unlabelled", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_join_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("inner_join_counts", "select c_mktsegment, o_orderstatus, count(*) as n from orders join customer on o_custkey = c_custkey group by all")
def inner_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("left_join_order_counts", """
    select c_custkey, coalesce(n, 0)::bigint as n, last_order from customer left join
      (select o_custkey, count(*) as n, max(o_orderdate) as last_order from orders group by 1) on c_custkey = o_custkey""")
def left_join_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_order"))
    joined = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_order")


@query("chunk_reconcile", """
    with c as (select doc_id, case when length(text) = 0 then 0 when length(text) <= 1000 then 1 else ceil((length(text) - 50) / 950)::int end as made from documents where lang in ('en', 'fr')),
    w as (select doc_id, greatest(1, ceil(n_chars / 1000))::int as wanted from documents)
    select doc_id, wanted, coalesce(made, 0)::int as made, case when coalesce(made, 0) = 0 then 'relearn' when made < wanted then 'update' else 'ok' end as status
    from w left join c using (doc_id)""")
def chunk_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows held against the chunks that another store has of them."""
    docs = table(spark, sf_dir, "documents")
    store = docs.where(F.col("lang").isin("en", "fr")).select("doc_id", F.explode(C.fixed_chunks("text")).alias("chunk"))
    made = store.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("made"))
    wanted = docs.select("doc_id", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1000)).cast("int").alias("wanted"))
    joined = wanted.join(made, "doc_id", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("made") == 0, "relearn").when(F.col("made") < F.col("wanted"), "update").otherwise("ok"))


@query("candidate_lookup", """
    with c as (select l_orderkey, arg_min(c_custkey, prio) as found, min(prio)::int as prio from (
      select s_suppkey as l_orderkey, c_custkey, 1 as prio from supplier join customer on c_name = replace(s_name, 'Supplier', 'Customer') union all
      select s_suppkey, c_custkey, 2 from supplier join customer on c_custkey = s_suppkey) group by 1)
    select s_suppkey, found, prio from supplier left join c on s_suppkey = l_orderkey""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidate keys that the other table has."""
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(
        F.regexp_replace("s_name", "Supplier", "Customer"), F.col("s_suppkey").cast("string"))).alias("prio", "candidate"))
    known = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array("c_name", F.col("c_custkey").cast("string"))).alias("candidate"))
    hits = wanted.join(known, "candidate").groupBy("s_suppkey").agg(F.min_by("c_custkey", "prio").alias("found"), (F.min("prio") + 1).cast("int").alias("prio"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(hits, "s_suppkey", "left")


@query("session_files", """
    select o_custkey, count(*) as files, sum(l_quantity)::bigint as bytes, count(*) filter (where l_returnflag = 'R') as failed from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"), F.sum("l_quantity").cast("long").alias("bytes"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))


@query("category_tree", """
    select r_name || '/' || n_name as path, n_nationkey as code, count(c_custkey) as members from region join nation on n_regionkey = r_regionkey
      left join customer on c_nationkey = n_nationkey group by all""")
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a two-level tree as paths, with the rows that carry them."""
    tree = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"))
    return tree.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("n_nationkey").alias("code"), F.coalesce("members", F.lit(0)).alias("members"))


@query("category_counts", """
    select count(*) filter (where p_type like '% %') as both_levels, count(*) filter (where p_type not like '% %') as first_only, count(distinct p_type) as kinds from part""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count_if(F.col("p_type").contains(" ")).alias("both_levels"), F.count_if(~F.col("p_type").contains(" ")).alias("first_only"), F.countDistinct("p_type").alias("kinds"))


@query("text_concat", """
    select conv_id, count(*) as turns, md5(string_agg(trim(text), chr(10) order by turn)) as joined_md5 from conversations where trim(text) <> '' group by conv_id""")
def text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a text in order, blanks left out."""
    rows = table(spark, sf_dir, "conversations").where(~is_blank("text")).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("parts"))
    return rows.select("conv_id", "turns", F.md5(F.array_join(F.col("parts.t"), "\n")).alias("joined_md5"))


@query("history_last_turns", """
    select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4""")
def history_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of both sides of each conversation."""
    return last_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 4, F.desc("turn"))


@query("memory_retention", """
    with m as (select user_id, event_id, min(ts) as first_ts from events group by all),
    f as (select user_id, event_id, row_number() over (partition by user_id order by first_ts desc, event_id desc) as r from m)
    select user_id, event_id, event_type from events where (user_id, event_id) in (select (user_id, event_id) from f where r <= 29)""")
def memory_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 29 newest events of each user; older ones go."""
    return Y.recent_only(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts", 29).select("user_id", "event_id", "event_type")


@query("latest_per_key", """
    select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return rows.select("o_custkey", "r.*")


@query("old_date_break", """
    select o_orderkey, old_so_far, old_so_far >= 3 as stopped from (select o_orderkey, coalesce(sum((o_orderdate < timestamp '1995-01-01')::int) over (
      partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as old_so_far from orders)""")
def old_date_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a scan of a list in order would have stopped: after three rows that are too old."""
    return Y.stopped_after(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], F.col("o_orderdate") < "1995-01-01", 3).select("o_orderkey", "old_so_far", "stopped")


@query("download_stats", """
    select count(*) as total, count(*) filter (where event_type = 'purchase') as downloaded, count(*) filter (where event_type = 'view') as pending,
      count(*) filter (where event_type = 'error') as failed, round(count(*) filter (where event_type = 'purchase') * 100.0 / count(*), 2)::double as rate from events""")
def download_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    total = F.count(F.lit(1))
    return table(spark, sf_dir, "events").agg(total.alias("total"), n("purchase").alias("downloaded"), n("view").alias("pending"), n("error").alias("failed"),
                                              F.when(total > 0, F.round(n("purchase") * 100.0 / total, 2)).alias("rate"))


@query("distinct_parent_counts", """
    select l_returnflag, count(distinct split_part(l_orderkey::varchar || '-' || l_linenumber::varchar, '-', 1)) as parents, count(*) as chunks,
      round(count(*)::double / count(distinct l_orderkey), 2) as mean from lineitem group by 1""")
def distinct_parent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parents of chunk numbers like ``parent-part``, and chunks for each on average."""
    parent = F.substring_index(F.concat_ws("-", "l_orderkey", "l_linenumber"), "-", 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct(parent).alias("parents"), F.count(F.lit(1)).alias("chunks"), F.round(F.count(F.lit(1)) / F.countDistinct(parent), 2).alias("mean"))


@query("query_profile", """
    select upper(event_type) || ' u' || (user_id // 50)::varchar as signature, count(*) as n, count(*) filter (where event_type = 'error') as errors,
      count(*) filter (where value > 50) as slow, round(max(value), 2) as most, round(sum(value), 2) as total from events group by 1 order by total desc, signature limit 20""")
def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by operation and table: the twenty that took most time."""
    said = F.concat(F.col("event_type"), F.lit(" * from u"), F.floor(F.col("user_id") / 50).cast("string"))
    rows = table(spark, sf_dir, "events").withColumn("signature", X.query_signature(said))
    return rows.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("slow"),
        F.round(F.max("value"), 2).alias("most"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("total"), "signature").limit(20)


@query("keyset_page", "select o_orderkey, o_totalprice from orders where o_orderkey > 100 order by o_orderkey limit 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@query("search_files", "select p_partkey, p_name from part where contains(p_name, 'a') order by p_partkey desc limit 40 offset 10")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("a")).select("p_partkey", "p_name").orderBy(F.desc("p_partkey")).offset(10).limit(40)


@query("guarded_query", """
    select c_nationkey, count(*) as n, max(replace(c_mktsegment, 'B', 'b')) as "set" from customer where c_acctbal > 1000 and c_mktsegment = 'BUILDING' group by 1""")
def guarded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked statement with parameters, over a filter that passed its own check."""
    kept = table(spark, sf_dir, "customer").where(safe_condition(spark, "c_acctbal > 1000 and replace(c_mktsegment, ';', '--') is not null"))
    kept.createOrReplaceTempView("guarded_customer")
    return run_query(spark, """
        WITH kept AS (SELECT * FROM guarded_customer WHERE c_mktsegment = :segment)
        SELECT c_nationkey, count(*) AS n, max(replace(c_mktsegment, 'B', 'b')) AS `set` FROM kept GROUP BY c_nationkey;""", segment="BUILDING")


@query("json_prop_lookup", """
    select (props->>'$.k')::int as k, count(*) as n, min(event_id) as first_event from events where (props->>'$.k')::int in (select n_nationkey from nation) group by 1""")
def json_prop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return keyed.join(known, "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("vector_sink_projection", """
    select vec_id, label, len(embedding)::int as dim, round(embedding[1]::double, 4) as head, list_sum([abs(x)::double for x in embedding]) = 0 as is_zero from embeddings""")
def vector_sink_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text, as a store takes them, and read again."""
    said = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    read = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.from_json(said, "array<float>").alias("v"))
    return read.select("vec_id", "label", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("head"), F.forall("v", lambda x: x == 0).alias("is_zero"))


@query("stage_report", """
    select user_id, count(*) as seen, bool_or(event_type = 'purchase') as saved, count(*) filter (where event_type = 'click') as selected,
      arg_min(event_id, struct_pack(a := ts, b := event_id)) filter (where event_type = 'error') as first_failure from events group by 1""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each item: success stays, the first failure is told."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("seen"), F.bool_or(F.col("event_type") == "purchase").alias("saved"), F.count_if(F.col("event_type") == "click").alias("selected"),
        F.min_by(F.when(F.col("event_type") == "error", F.col("event_id")), F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).alias("first_failure"))


@query("failure_dedupe", "select distinct user_id, event_type, date_trunc('hour', ts) as at from events where event_type = 'error'")
def failure_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where(X.is_failure("event_type"))
    return failed.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("at")).dropDuplicates()


@query("attachment_rollup", """
    select l_orderkey, count(*) as files, string_agg(l_linenumber::varchar || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag) as listed from lineitem group by 1""")
def attachment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(":", "l_linenumber", "l_returnflag").alias("said"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), parts.alias("p"))
    return rows.select("l_orderkey", "files", F.array_join("p.said", ",").alias("listed"))


@query("merged_items", """
    select n_chars, count(*) as n, count(*) - 1 as repeats, min(doc_id) as first_seen, string_agg(distinct source, ',' order by source) as sources from documents group by 1""")
def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by key with all sources that had them."""
    return table(spark, sf_dir, "documents").groupBy("n_chars").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("repeats"), F.min("doc_id").alias("first_seen"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("upsert_merge", """
    select coalesce(c_custkey, s_suppkey + 100000) as ident, case when s_suppkey is null then c_name when trim(coalesce(c_name, '')) = '' then s_name else c_name end as name,
      coalesce(s_acctbal, c_acctbal) as balance from customer full join supplier on c_custkey = s_suppkey + (case when s_suppkey > 50 then 100000 else 0 end)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers put into customers by id: balances change, names only where blank; ids over 50 are new."""
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ident"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    ident = F.col("s_suppkey") + F.when(F.col("s_suppkey") > 50, 100000).otherwise(0)
    source = table(spark, sf_dir, "supplier").select(ident.alias("ident"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return M.upsert(target, source, ["ident"], only_blank=("name",))


@query("replace_by_key", """
    select o_orderkey as ident, o_orderstatus as state from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')
    union all select l_orderkey, 'returned' from (select distinct l_orderkey from lineitem where l_returnflag = 'R')""")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ident"), F.col("o_orderstatus").alias("state"))
    source = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ident"), F.lit("returned").alias("state")).distinct()
    return M.replaced_by_key(target, source, ["ident"])


@query("fill_empty_merge", """
    select n_nationkey, case when n_regionkey = 0 then 'region of ' || n_name else r_name end as filled,
      case when n_regionkey = 0 then 'region of ' || n_name else 'region of ' || n_name end as overwritten from nation join region on n_regionkey = r_regionkey""")
def fill_empty_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category filled where blank, and overwritten."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    old, new = F.when(F.col("n_regionkey") == 0, "  ").otherwise(F.col("r_name")), F.concat(F.lit("region of "), F.col("n_name"))
    return rows.select("n_nationkey", M.merged_category(old, new, False).alias("filled"), M.merged_category(old, new, True).alias("overwritten"))


@query("metadata_patch", """
    select c_custkey, 'name=' || c_name || case when s_name is not null then ',origin=' || s_name else '' end || ',segment=' || c_mktsegment as meta
    from customer left join supplier on s_suppkey = c_custkey""")
def metadata_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of one table with the entries that another has and it lacks."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    old = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("origin"), F.lit(""))
    new = F.create_map(F.lit("name"), F.lit("other"), F.lit("origin"), F.col("s_name"))
    entries = F.array_sort(F.transform(F.map_entries(M.patched_metadata(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return joined.select("c_custkey", F.array_join(entries, ",").alias("meta"))


@query("merged_stage_union", """
    with u as (select user_id, max(case when event_type = 'view' then event_id end) as viewed, max(case when event_type = 'click' then event_id end) as clicked from events group by 1)
    select user_id, viewed, clicked from u where viewed is not null or clicked is not null""")
def merged_stage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two stages by user, each column with the last value that is known."""
    events = table(spark, sf_dir, "events")
    part = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias(name))
    return M.merged_union(part("view", "viewed"), part("click", "clicked"), keys=["user_id"])


@query("metadata_builder", """
    select c_custkey, '{"name":' || to_json(c_name)::varchar || case when c_acctbal > 0 then ',"credit":"yes"' else '' end || '}' as meta from customer""")
def metadata_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as JSON with the entries that there are."""
    meta = F.to_json(F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, "yes").alias("credit")))
    return table(spark, sf_dir, "customer").select("c_custkey", meta.alias("meta"))


@query("effective_counts", """
    select user_id, least(count(*) filter (where event_type = 'view'), count(*) filter (where event_type = 'click')) as effective from events group by 1""")
def effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(n("view"), n("click")).alias("effective"))


@query("ranked_groups", """
    select n_nationkey, n, rank() over (order by n desc, n_nationkey)::int as place from (select c_nationkey as n_nationkey, count(*) as n from customer group by 1)""")
def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by falling size; there are as many as nations."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "n_nationkey")))


@query("sheet_chunks", """
    select l_returnflag, (r // 30)::int as chunk_no, count(*) as n_rows, md5(string_agg('| ' || l_orderkey::varchar || ' | ' || l_linenumber::varchar || ' |', chr(10) order by r)) as body_md5
    from (select *, row_number() over (partition by l_returnflag, l_shipdate::date order by l_orderkey, l_linenumber) - 1 as r from lineitem) group by l_returnflag, l_shipdate::date, r // 30""")
def sheet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each sheet (a flag and day) in chunks of thirty, as table text."""
    number = F.row_number().over(W.partitionBy("l_returnflag", F.to_date("l_shipdate")).orderBy("l_orderkey", "l_linenumber")) - 1
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), number.alias("r"), F.concat(
        F.lit("| "), F.col("l_orderkey"), F.lit(" | "), F.col("l_linenumber"), F.lit(" |")).alias("said"))
    chunks = rows.groupBy("l_returnflag", "day", F.floor(F.col("r") / 30).cast("int").alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("r", "said"))).alias("b"))
    return chunks.select("l_returnflag", "chunk_no", "n_rows", F.md5(F.array_join("b.said", "\n")).alias("body_md5"))


@query("first_wins_dedupe", "select user_id, event_type, min(event_id) as event_id from events group by all")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("monotonic_progress", """
    select event_id, user_id, max((props->>'$.k')::int) over w as save_count, round(max(value) over w, 2) as percentage from events
    window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def monotonic_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("save_count"), F.round("value", 2).alias("percentage"))
    return Y.monotonic(rows, ["user_id"], [F.col("ts"), F.col("event_id")], ["save_count", "percentage"]).select("event_id", "user_id", "save_count", "percentage")


@query("sticky_status", """
    select event_id, coalesce(last_value(case when event_type in ('purchase', 'error') then event_type end ignore nulls) over (
      partition by user_id order by ts, event_id rows between unbounded preceding and current row), event_type) as status from events""")
def sticky_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("status"))
    return Y.sticky_status(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "status", ["purchase", "error"]).select("event_id", "status")


@query("throttle_last", """
    select user_id, time_bucket(interval 10 minutes, ts) as interval_start, arg_max(event_id, struct_pack(a := ts, b := event_id)) as event_id from events group by 1, 2""")
def throttle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return Y.last_of_interval(rows, ["user_id"], "ts", "10 minutes", ["ts", "event_id"]).select("user_id", "interval_start", "event_id")


@query("ttl_dedupe", """
    with recursive e as (select user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts) as r from (select distinct user_id, event_type, ts from events)),
    w as (select user_id, event_type, ts, r, ts as last, true as kept from e where r = 1 union all
      select e.user_id, e.event_type, e.ts, e.r, case when e.ts - w.last >= interval 30000 seconds then e.ts else w.last end, e.ts - w.last >= interval 30000 seconds
      from w join e on e.user_id = w.user_id and e.event_type = w.event_type and e.r = w.r + 1)
    select user_id, event_type, ts from w where kept""")
def ttl_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and kind that come 30 000 seconds or more after the last one that counted."""
    return Y.outside_ttl(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 30_000)
