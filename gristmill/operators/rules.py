"""Category rules: URL parts and query tokens with categories, first match wins, any number of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import is_blank
from gristmill.operators.components import cut_lineage

#: Letters of the piece by which a rule is found; rules with shorter parts are found by all they have.
PIECE = 6
#: Rows of the index that are sent to every task; a larger one is joined by a shuffle.
MAX_BROADCAST = 1 << 15


def _pieces(text: Column, size: Column | int) -> Column:
    """The distinct pieces of ``size`` letters of a text."""
    n = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def rule_index(rules: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """``rules`` (pos, url, query, cate1, cate2) with parts and last, and the piece and size by which each is found among ``texts`` (low); the sizes there are.

    Rules of the same parts match the same URLs, so only the one that wins over the others is kept.

    A rule's piece is the one that fewest texts hold, weighted by the rules that
    have it; so neither a piece like ``https:`` nor one that many rules share is
    asked for if there is another. Rules without any part have a null piece.
    """
    said = rules.select("pos", "cate1", "cate2", is_blank("cate2").alias("last"), F.array_sort(F.filter(F.array_distinct(F.transform(
        F.concat(F.array(F.coalesce("url", F.lit(""))), F.coalesce("query", F.array().cast("array<string>"))), lambda x: F.lower(x))), lambda x: x != "")).alias("parts"))
    low = cut_lineage(said.groupBy("parts").agg(F.min(F.struct("last", "pos", "cate1", "cate2")).alias("r")).select("parts", "r.*"))
    # the longest part may have the rarest piece
    sized = low.withColumn("size", F.least(F.lit(PIECE), F.array_max(F.transform("parts", F.length))))
    sizes = [r[0] for r in sized.where("size is not null").select("size").distinct().collect()]  # at most PIECE numbers
    long = sized.withColumn("pieces", F.array_distinct(F.flatten(F.transform("parts", lambda p: _pieces(p, F.col("size"))))))
    offered = long.select("pos", "size", F.explode("pieces").alias("piece"))
    shared = offered.groupBy("piece", "size").agg(F.count(F.lit(1)).alias("n_rules"))
    in_texts = _asked(texts, sizes).join(shared.select("piece", "size").hint("merge"), ["piece", "size"]).groupBy("piece", "size").agg(F.count(F.lit(1)).alias("n_texts"))
    cost = shared.join(in_texts, ["piece", "size"], "left").select("piece", "size", ((F.coalesce("n_texts", F.lit(0)) + 1) * F.col("n_rules")).alias("cost"))
    best = offered.join(cost.hint("merge"), ["piece", "size"]).groupBy("pos").agg(F.min_by("piece", F.struct("cost", "piece")).alias("piece"))
    return cut_lineage(long.drop("pieces").join(best.hint("merge"), "pos", "left")), sizes


def _asked(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(low, size, piece): the distinct pieces of each text, of the sizes that rules use."""
    each = F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))
    return texts.select("low", each.alias("size")).select("low", "size", F.explode(_pieces(F.col("low"), F.col("size"))).alias("piece"))


def categorized(rows: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``rows`` with cate1 and cate2 of the first rule that matches and has both; else of the first without cate2.

    A rule matches when its URL part occurs in the URL (case aside) and all of
    its query tokens do; empty parts match all. Without a match, and for a null
    URL, both are null. Rules come in the order of ``pos``, which is unique.

    Each distinct URL asks an index of the rules by its pieces, what answers is
    held against the whole rule, and the smallest place is kept: neither rules nor
    rows are collected, and there may be any number of both. Only the sizes of
    pieces that rules use are asked for. Nothing but an index of at most
    ``MAX_BROADCAST`` rows passes the driver: joins with what grows are by sorting.
    """
    named = F.lower(F.col(url))
    texts = rows.select(named.alias("low")).where("low is not null").distinct()
    index, sizes = rule_index(rules, texts)
    found = F.struct("last", "pos", "cate1", "cate2")
    # of rules without parts only the first with and the first without cate2 can be the answer
    always = index.where("piece is null").agg(F.min(found).alias("r")).first()["r"]
    by_piece = index.where("piece is not null")
    few = by_piece.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    asked = _asked(texts, sizes)
    met = asked.join(F.broadcast(by_piece) if few else by_piece.hint("merge"), ["piece", "size"]).where(F.forall("parts", lambda p: F.col("low").contains(p)))
    best = met.groupBy("low").agg(F.min(found).alias("_best"))
    # one row for each URL on the right, so Spark may split a URL that many rows have
    out = rows.withColumn("_low", named).join(best.withColumnRenamed("low", "_low").hint("merge"), "_low", "left")
    kinds = dict(index.dtypes)
    fixed = F.struct(*[F.lit(always[c]).cast(kinds.get(c, "boolean")).alias(c) for c in ("last", "pos", "cate1", "cate2")]) if always else F.lit(None)
    rule = F.when(F.col("_low").isNotNull(), F.least("_best", fixed) if always else F.col("_best"))
    return out.withColumn("_r", rule).withColumns({"cate1": F.col("_r.cate1"), "cate2": F.col("_r.cate2")}).drop("_low", "_best", "_r")


def matching_any(rows: DataFrame, url: str, patterns: list[list[str]], keep: bool = True) -> DataFrame:
    """Rows whose URL holds all parts of some pattern, or with ``keep=False`` the others."""
    found = holds_any(F.col(url), patterns)
    return rows.where(found if keep else ~found)


def holds_any(url: Column, patterns: list[list[str]]) -> Column:
    """Whether a URL holds all parts of some pattern, case aside."""
    low, found = F.lower(url), F.lit(False)
    for parts in patterns:
        every = F.lit(True)
        for part in parts:
            every = every & low.contains(part.lower())
        found = found | every
    return found
