"""Host names of other letters as the name system has them (RFC 3492), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import let

# Fixed values of the encoding: base, least and most threshold, skew, damping, first bias and code point.
BASE, LEAST, MOST, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits that a number has at most, and times that a bias is divided; a label has 63 letters.
LONGEST, HALVINGS = 8, 6


def _number(n: int | Column) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("long")


def _digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))


def _written(delta: Column, bias: Column) -> Column:
    """A number of variable length, with thresholds that follow the bias."""
    def step(s: Column, k: Column) -> Column:
        def put(t: Column) -> Column:
            left = s["q"] - t
            last = s["q"] < t
            return F.when(s["done"], s).otherwise(F.struct(
                F.when(last, s["q"]).otherwise(F.floor(left / (BASE - t))).cast("long").alias("q"),
                F.concat(s["out"], F.when(last, _digit(s["q"])).otherwise(_digit(t + left % (BASE - t)))).alias("out"), last.alias("done")))

        return let(F.least(F.greatest(_number(k) * BASE - bias, _number(LEAST)), _number(MOST)), put)

    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step, lambda s: s["out"])


def _adapted(delta: Column, handled: Column, first: Column) -> Column:
    halved = F.floor(delta / F.when(first, DAMP).otherwise(2)).cast("long")
    most = (BASE - LEAST) * MOST // 2

    def step(s: Column, _: Column) -> Column:
        return F.when(s["d"] > most, F.struct(F.floor(s["d"] / (BASE - LEAST)).cast("long").alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)

    start = F.struct((halved + F.floor(halved / handled)).cast("long").alias("d"), _number(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda s: (s["k"] + F.floor(BASE * s["d"] / (s["d"] + SKEW))).cast("long"))


def encoded_label(label: Column) -> Column:
    """A label with ``xn--`` in front if it has other than ASCII letters, else as it is."""
    codes = F.transform(F.sequence(F.lit(1), F.length(label)), lambda k: F.ascii(F.substring(label, k, F.lit(1))).cast("long"))

    def made(codes: Column) -> Column:
        plain = F.regexp_replace(label, r"[^\x00-\x7F]", "")
        n_plain = F.length(plain).cast("long")

        def outer(s: Column, m: Column) -> Column:
            def inner(x: Column, c: Column) -> Column:
                hit = F.struct(_number(0).alias("delta"), _adapted(x["delta"], x["h"] + 1, x["h"] == n_plain).alias("bias"), (x["h"] + 1).alias("h"),
                               F.concat(x["out"], _written(x["delta"], x["bias"])).alias("out"))
                return F.when(c < m, F.struct((x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["h"].alias("h"), x["out"].alias("out"))).when(c == m, hit).otherwise(x)

            start = F.struct((s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            return F.aggregate(codes, start, inner, lambda x: F.struct(
                (m + 1).alias("n"), (x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["h"].alias("h"), x["out"].alias("out")))

        others = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST)))
        start = F.struct(_number(FIRST).alias("n"), _number(0).alias("delta"), _number(BIAS).alias("bias"), n_plain.alias("h"),
                         F.concat(plain, F.when(n_plain > 0, "-").otherwise("")).alias("out"))
        return F.concat(F.lit("xn--"), F.aggregate(others, start, outer, lambda s: s["out"]))

    return F.when(label.rlike(r"[^\x00-\x7F]"), let(codes, made)).otherwise(label)


def ascii_host(name: Column) -> Column:
    """A host in lower case with each label as the name system has it; other full stops part labels too. A host whose labels are empty or too long stays as it is."""
    low = F.lower(name)
    labels = F.transform(F.split(low, "[.。．｡]"), encoded_label)
    joined = let(labels, lambda found: F.when(F.forall(found, lambda x: (x != "") & (F.length(x) <= 63)), F.array_join(found, ".")).otherwise(name))
    return F.when(name.rlike(r"[^\x00-\x7F]"), joined).otherwise(name)
