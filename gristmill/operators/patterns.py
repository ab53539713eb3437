"""Rules that groups of URLs suggest: which parts of their paths are constant, of a few kinds, or free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import urls as U
from gristmill.operators.rules import holds_any

#: URLs of a group that are shown, kinds that a part may have before it is free, and tokens that are listed.
SAMPLES, KINDS, TOKENS = 8, 8, 8


def stable_tokens(url: Column | str) -> Column:
    """The parameters that name a board rather than an article, as they are written, sorted, each once."""
    dropped = [*U.CRAWL_PAGE_KEYS, *U.PRIMARY_KEYS]
    items = F.filter(F.split(U.query(url), "&"), lambda x: x.rlike("^[^=]+=.") & ~F.lower(F.substring_index(x, "=", 1)).isin(dropped)
                     & (F.length(F.regexp_extract(x, "(?s)=(.*)", 1)) <= 40))
    return F.array_sort(F.array_distinct(items))


def _segments(url: Column | str) -> Column:
    return F.filter(F.split(U.path(url), "/"), lambda s: s != "")


def path_positions(rows: DataFrame) -> DataFrame:
    """(signature, positions): for each place of a group's paths its kind (constant, bounded, free) and the parts, up to ``KINDS`` by count.

    ``rows`` has signature and url; all URLs of a signature have as many parts.
    Parts are counted before they meet, so a group of any size is a few rows for each place.
    """
    parts = rows.select("signature", F.posexplode(_segments("url")).alias("place", "part"))
    counts = parts.groupBy("signature", "place", "part").agg(F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(W.partitionBy("signature", "place").orderBy(F.desc("n"), "part"))
    few = counts.withColumn("_r", number).where(F.col("_r") <= KINDS + 1)
    places = few.groupBy("signature", "place").agg(F.max("_r").alias("_kinds"), F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "part"))), lambda x: x["part"]).alias("parts"))
    kind = F.when(F.col("_kinds") == 1, "constant").when(F.col("_kinds") <= KINDS, "bounded").otherwise("free")
    listed = F.struct("place", kind.alias("kind"), F.when(kind == "free", F.array().cast("array<string>")).otherwise(F.col("parts")).alias("parts"))
    return places.groupBy("signature").agg(F.array_sort(F.collect_list(listed)).alias("positions"))


def suggested_rules(rows: DataFrame, url: str, least: int, known: list[list[str]] | None = None) -> DataFrame:
    """(signature, n, sample, rule_url, rule_query, positions) of the groups of ``least`` URLs or more that no known pattern matches, and one row, with a null signature, that counts the groups below.

    A rule's URL is scheme and host of the group's first URL, the folders that all
    share, its script if it has one, and the parameters that at least half of the
    group have; rule_query lists these. Blank URLs are no URLs.
    """
    given = rows.select(F.trim(F.coalesce(F.col(url), F.lit(""))).alias("url")).where("url != ''")
    if known:
        given = given.where(~holds_any(F.col("url"), known))
    keyed = given.withColumn("signature", U.pattern_signature("url"))
    sizes = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first"))
    groups = sizes.where(F.col("n") >= least)
    own = keyed.join(groups.select("signature"), "signature", "left_semi")
    number = F.row_number().over(W.partitionBy("signature").orderBy("url"))
    samples = own.withColumn("_r", number).where(F.col("_r") <= SAMPLES).groupBy("signature").agg(F.array_sort(F.collect_list("url")).alias("sample"))
    tokens = own.select("signature", F.explode(stable_tokens("url")).alias("token")).groupBy("signature", F.lower("token").alias("_low")).agg(
        F.count(F.lit(1)).alias("times"), F.min("token").alias("token"))
    most = F.array_sort(F.collect_list(F.when(F.col("times") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.struct((-F.col("times")).alias("t"), "token"))))
    frequent = tokens.join(groups.select("signature", "n"), "signature").groupBy("signature").agg(F.transform(most, lambda x: x["token"]).alias("rule_query"))
    found = (groups.join(samples, "signature").join(path_positions(own), "signature", "left").join(frequent, "signature", "left")
             .withColumn("rule_query", F.coalesce("rule_query", F.array().cast("array<string>"))))
    parts = _segments("first")
    script = F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1)
    named = script.rlike(r"\.[A-Za-z0-9]{1,6}$")
    # folders that all share: constant places before the first other one, without the script
    folders = F.slice(F.col("positions"), F.lit(1), F.greatest(F.size("positions") - named.cast("int"), F.lit(0)))
    shared = F.aggregate(folders, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("p")), lambda done, x: F.struct(
        (done["on"] & (x["kind"] == "constant")).alias("on"),
        F.when(done["on"] & (x["kind"] == "constant"), F.array_append(done["p"], x["parts"][0])).otherwise(done["p"]).alias("p")), lambda done: done["p"])
    place = F.array_join(F.concat(F.coalesce(shared, F.array().cast("array<string>")), F.when(named, F.array(script)).otherwise(F.array().cast("array<string>"))), "/")
    rule = F.concat(U.scheme("first"), F.lit("://"), U.host("first"), F.when(place != "", F.concat(F.lit("/"), place)).otherwise(""),
                    F.when(F.size("rule_query") > 0, F.concat(F.lit("?"), F.array_join("rule_query", "&"))).otherwise(""))
    listed = found.select("signature", "n", "sample", rule.alias("rule_url"), "rule_query", "positions")
    left = sizes.where(F.col("n") < least).agg(F.count(F.lit(1)).alias("n"))
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in listed.dtypes if c != "n"}
    return listed.union(left.select(*[F.col("n") if c == "n" else none[c] for c in listed.columns]))


def frequent_tokens(rows: DataFrame) -> DataFrame:
    """(signature, rank, token, n): the ``TOKENS`` scripts and stable parameters of each signature of ``rows`` (signature, url) that occur most, twice or more."""
    script = F.element_at(F.concat(F.array(F.lit("")), _segments("url")), -1)
    own = F.concat(F.filter(F.array(script), lambda x: x.rlike(r"\.[A-Za-z0-9]{1,6}$")), stable_tokens("url"))
    counts = rows.select("signature", F.explode(own).alias("token")).groupBy("signature", "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    number = F.row_number().over(W.partitionBy("signature").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", number).where(F.col("rank") <= TOKENS).select("signature", "rank", "token", "n")


def seed_groups(rows: DataFrame, ident: str, url: str, bot: str) -> DataFrame:
    """(domain, template, query_signature, n, hosts, bots, only_bot, representative) of URLs by what they share.

    The representative looks most like a board, then has the fewest path parts,
    the shortest URL and the largest id; only_bot is the group's bot if it has just one.
    """
    keyed = rows.select(U.top_domain(U.host(url)).alias("domain"), U.path_template(url).alias("template"), U.stable_query(url).alias("query_signature"),
                        F.col(ident).alias("_id"), F.col(url).alias("_url"), U.host(url).alias("_host"), F.nullif(F.trim(F.col(bot)), F.lit("")).alias("_bot"))
    score = F.struct(U.board_score("_url").alias("a"), (-F.size(_segments("_url"))).alias("b"), (-F.length("_url")).alias("c"), F.coalesce("_id", F.lit(0)).alias("d"))
    found = keyed.where("domain != ''").groupBy("domain", "template", "query_signature").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("_host").alias("hosts"), F.countDistinct("_bot").alias("bots"), F.min("_bot").alias("only_bot"),
        F.max_by("_url", score).alias("representative"))
    return found.withColumn("only_bot", F.when(F.col("bots") == 1, F.col("only_bot")))
