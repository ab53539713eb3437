"""Secret scans with multipart credential linking (operator 2, native).

Single finds (assignments, access identifiers, long hexadecimal runs) are
reported as they stand. Weak parts are not: a bare 40-character key, a key
identifier, a user name or an endpoint says little alone. They are reported
when a part that completes them lies within ``LINK_GAP`` code points in the
same scope, a scope being a run of lines without a blank one.

Positions come from lengths: all matches of a pattern and the pieces between
them alternate, so a running sum of their lengths is where each match starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak parts; each is reported only next to a part that completes it.
WEAK = {
    "endpoint": r"(?i:https?|jdbc:[a-z]{1,20}|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:@/?%&=+-]{4,}",
    "identifier": r"(?i:(?:access_?key_?id|client_?id|account_?id|user(?:_?name)?|login))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}",
    "bare_key": r"[A-Za-z0-9+/=_-]{40,}",
}
#: What the value of a match must be; for assignments that is the text after the sign.
VALUES = {"assign": r"^.{12,}$", "bare_key": r"^[A-Za-z0-9+/]{40}$"}
BARE_KEY_HAS = ["[0-9]", "[A-Z]"]
BLANK_LINE = r"\n[\x20\t\r]*\n"
#: Kinds in the order in which equal starts are listed; a break only separates scopes.
KINDS = ["assign", "access", "hex", *WEAK]
#: What completes what: an identifier or endpoint needs a secret, a bare key needs an identifier or endpoint.
SECRET, ADDRESS = ["assign", "hex", "bare_key"], ["access", "identifier", "endpoint"]
COMPLETED_BY = {"endpoint": SECRET, "identifier": SECRET, "bare_key": ADDRESS}
LINK_GAP = 200


def _matches(text: Column, pattern: str, group: int | None = None, kind: str = "") -> Column:
    """array<struct<gap, size, ok>>: code points before and in each match, and whether its value (or group) will do."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))

    def will_do(value: Column) -> Column:
        ok = value.rlike(VALUES[kind]) if kind in VALUES else F.lit(True)
        for has in BARE_KEY_HAS if kind == "bare_key" else ():
            ok = ok & value.rlike(has)
        return ok

    sizes = F.transform(parts, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), will_do(x["value"]).alias("ok")))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(sizes, lambda x: x["size"].isNotNull()))


def _numbered(kind: str) -> Column:
    """The matches of a kind with the kind and their numbers; none for null."""
    parts = F.coalesce(F.col(kind), F.array().cast("array<struct<gap:int,size:int,ok:boolean>>"))
    return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x.alias("m")))


def scan(docs: DataFrame) -> DataFrame:
    """Findings in ``docs`` (doc_id, text): one row for each row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans),
    spans (all spans as kind:start:end in code points, end exclusive, by start
    and then kind, comma-joined) and n_linked (weak parts that were reported).

    A null text counts as empty and has no spans; a null doc_id is kept. Rows
    that repeat doc_id and text each give their row. Overlapping spans of
    different kinds are all listed. Texts of any length are read whole. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("_h1"), F.crc32(F.col("text").cast("binary")).alias("_h2"), "text",
        _matches(F.col("text"), ASSIGN, 2, "assign").alias("assign"), _matches(F.col("text"), ACCESS).alias("access"),
        _matches(F.col("text"), HEX).alias("hex"),
        *[_matches(F.col("text"), pattern, kind=kind).alias(kind) for kind, pattern in WEAK.items()])
    # breaks matter only where a weak part may link
    weak = F.coalesce(*WEAK)
    rows = rows.withColumn("break", F.when(weak.isNotNull(), _matches(F.col("text"), BLANK_LINE)))
    key = ["doc_id", "_h1", "_h2"]
    rows = rows.select(*key, F.concat(*[_numbered(kind) for kind in [*KINDS, "break"]]).alias("parts"))
    # repeated rows are worked out once and given out again at the end
    rows = rows.groupBy(*key).agg(F.first("parts").alias("parts"), F.count(F.lit(1)).alias("copies"))
    parts = rows.select(*key, "copies", F.explode_outer("parts").alias("p")).select(
        *key, "copies", F.col("p.kind").alias("kind"), F.col("p.number").alias("number"),
        F.col("p.m.gap").alias("gap"), F.col("p.m.size").alias("size"), F.col("p.m.ok").alias("ok"))
    so_far = W.partitionBy(*key, "kind").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    # a match whose value won't do is none; the row stays, as it may be the only one of its document
    parts = parts.withColumn("start", F.col("end") - F.col("size")).withColumn(
        "kind", F.when(F.col("ok"), F.col("kind")))
    order = W.partitionBy(*key).orderBy("start", "end", "kind")
    parts = parts.withColumn("scope", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    # interval join within a scope: the nearest complement on either side tells whether any is near enough
    scope = W.partitionBy(*key, "scope")
    before = scope.orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = scope.orderBy("start", "end", "kind").rowsBetween(1, W.unboundedFollowing)
    near = F.lit(False)
    for kind, wanted in COMPLETED_BY.items():
        is_wanted = F.col("kind").isin(wanted)
        last = F.max(F.when(is_wanted, F.col("end"))).over(before)
        following = F.min(F.when(is_wanted, F.col("start"))).over(after)
        close = (F.col("start") - last <= LINK_GAP) | (following - F.col("end") <= LINK_GAP)
        near = near | ((F.col("kind") == kind) & F.coalesce(close, F.lit(False)))
    parts = parts.withColumn("near", near)
    base = F.col("kind").isin("assign", "access", "hex")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
    done = parts.groupBy(*key).agg(
        F.first("copies").alias("copies"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("near"), span))).alias("all"))
    said = lambda c: F.array_join(F.col(f"{c}.said"), ",")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(said("base").cast("binary"), 256).alias("base_sha256"),
        said("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_linked"))
