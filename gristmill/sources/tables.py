"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.guard import check_condition, check_query

STARTS = ("select", "with", "explain")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys that tell them apart to as many tasks as a shuffle has, and to all cores at least: for work that costs far more than the bytes read show."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def read_only(spark: SparkSession, statement: str) -> str:
    """The statement without its end mark; an error unless it is one query that only reads. See ``guard.check_query``."""
    text = statement.strip().rstrip(";").strip()
    if not text.lower().startswith(STARTS):
        raise ValueError("a statement must begin with SELECT, WITH or EXPLAIN")
    check_query(spark, text)
    return text


def safe_condition(spark: SparkSession, condition: str) -> str:
    """A filter expression; an error if it could be more than that. See ``guard.check_condition``."""
    check_condition(spark, condition)
    return condition


def query(spark: SparkSession, statement: str, **args: object) -> DataFrame:
    """Run a checked query with named parameters."""
    return spark.sql(read_only(spark, statement), args=args or None)


def page_after(df: DataFrame, key: str, after: int | None, n: int, descending: bool = False) -> DataFrame:
    """The next ``n`` rows by key: a page is asked for by the last key seen, not by an offset."""
    if after is not None:
        df = df.where(F.col(key) < after if descending else F.col(key) > after)
    return df.orderBy(F.col(key).desc() if descending else F.col(key)).limit(n)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; lines that aren't objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def attachments(details: DataFrame) -> DataFrame:
    """One row for each file of (detail_url, title, files array<struct<url,name,extension,queued_at>>), defaults for blanks."""
    rows = details.select("detail_url", "title", F.explode_outer("files").alias("f"))
    return rows.select("detail_url", "title", F.coalesce("f.url", F.lit("")).alias("url"),
                       F.coalesce("f.name", "title", F.lit("")).alias("name"),
                       F.lower(F.coalesce("f.extension", F.regexp_extract(F.coalesce("f.url", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))).alias("extension"),
                       F.col("f.queued_at").alias("queued_at"))


def appended_stage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stage records of both tables by url, the first kept: old ones before new ones, each by its ``ord``."""
    rows = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    names = [c for c in old.columns if c != "url"]
    return rows.groupBy("url").agg(F.min_by(F.struct(*names), F.struct("_part", "ord")).alias("r")).select("url", "r.*")


def limited(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """The first rows by key, ``n`` of them but at least one and at most ``most``, with truncated: whether there are more."""
    n = max(1, min(n, most))
    return df.orderBy(key).limit(n).withColumn("truncated", F.lit(df.limit(n + 1).count() > n))
